"""BM25: inverted index, statistics, scoring and top-k as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
OKAPI_EPSILON = 0.25


@dataclass(frozen=True)
class Index:
    """postings(term, doc_index, tf, dl), terms(term, df, idf), corpus(n, avgdl). repeats: a query's repeated terms count."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    repeats: bool = False

    def scored(self, queries: DataFrame, k: int, k1: float, b: float, text: str = "text") -> DataFrame:
        return scores(queries, self, k1, b, text)


def terms_of(df: DataFrame, text: str = "text") -> Column:
    """A table's column `tokens`, as segmenter.with_terms() adds it; the text's tokens where it has none."""
    return F.coalesce(F.col("tokens"), F.array().cast("array<string>")) if "tokens" in df.columns else tokens(F.col(text))


def tokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_index", terms_of(docs, text).alias("tokens"))


def build_index(docs: DataFrame, text: str = "text", idf: str = "plus_one") -> Index:
    """docs has doc_index and the text column, or a column tokens. idf: plus_one (always positive), robertson (the classic form), or okapi:
    the classic form, of which negative values become a quarter of the mean; a query's repeated terms count there."""
    if idf not in ("plus_one", "robertson", "okapi"):
        raise ValueError(f"unknown idf: {idf}")
    t = tokenized(docs, text)
    corpus = t.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))
    postings = t.select("doc_index", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "doc_index", "dl").agg(F.count("*").alias("tf"))
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weight = F.log1p(odds) if idf == "plus_one" else F.log(odds)
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus)).select("term", "df", weight.alias("idf"))
    if idf == "okapi":
        terms = okapi_terms(terms, corpus)
    return Index(postings, terms, corpus, repeats=idf == "okapi")


def okapi_terms(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """The classic form of idf in the place of the terms' own; negative values become a quarter of the mean."""
    classic = terms.crossJoin(F.broadcast(corpus.select("n"))).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("n")
    mean = classic.agg(F.avg("idf").alias("mean"))
    return classic.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, OKAPI_EPSILON * F.col("mean")).otherwise(F.col("idf"))).drop("mean")


def query_terms(queries: DataFrame, text: str = "text", repeats: bool = False) -> DataFrame:
    """Distinct terms: how often a query repeats one counts only with repeats."""
    if repeats:
        return queries.select("query_id", F.explode(terms_of(queries, text)).alias("term"))
    return queries.select("query_id", F.explode(F.array_distinct(terms_of(queries, text))).alias("term"))


def scores(queries: DataFrame, index: Index, k1: float = K1, b: float = B, text: str = "text") -> DataFrame:
    """query_id, doc_index, bm25_score of every document that shares a term with a query."""
    length = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / length))
    joined = query_terms(queries, text, index.repeats).join(index.terms, "term").join(index.postings, "term").crossJoin(F.broadcast(index.corpus))
    return joined.groupBy("query_id", "doc_index").agg(F.sum(part).alias("bm25_score"))


def rank_key(score: Column) -> Column:
    """Sums differ in their last bits with the order of summation; ranks use eight decimals."""
    return F.round(score, 8)


def top_k(scored: DataFrame, score: str, k: int, rank: str, *ties: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query_id (or by) the k best, ranked from 1; ties by the given columns, doc_index at last."""
    order = Window.partitionBy(*by).orderBy(F.desc("__key"), *ties, "doc_index")
    keyed = scored.withColumn("__key", rank_key(F.col(score))).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= max(k, 0))
    return keyed.withColumn(rank, F.col("__rank").cast("bigint")).drop("__key", "__rank")


def bm25_top_k(queries: DataFrame, docs: DataFrame, index, k: int, pad: bool = True, k1: float = K1, b: float = B, text: str = "text") -> DataFrame:
    """query_id, doc_index, bm25_score, bm25_rank, from an Index or a stored one (postings.StoredIndex).

    pad: where fewer than k documents match, those with the least doc_index follow with score 0. Fewer than k match
    then, so k of the first 2k documents are free, and no more are paired with queries.
    """
    found = top_k(index.scored(queries, k, k1, b, text), "bm25_score", k, "bm25_rank")
    if not pad:
        return found
    first = docs.select("doc_index").orderBy("doc_index").limit(2 * k)
    filler = queries.select("query_id").crossJoin(F.broadcast(first)).select("query_id", "doc_index", F.lit(0.0).alias("bm25_score"), F.lit(0).alias("__m"))
    # what was found is read once: of a found document and its filler the found row counts
    both = found.select("query_id", "doc_index", "bm25_score", F.lit(1).alias("__m")).unionByName(filler)
    return top_k(both.groupBy("query_id", "doc_index").agg(F.max_by("bm25_score", "__m").alias("bm25_score")), "bm25_score", k, "bm25_rank")
