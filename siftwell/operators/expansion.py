"""Query expansion by keywords that several generated passages agree on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..functions.text import CONNECTOR, HAN, MERGE_AFTER, canonical_keyword, casefold, is_invalid_keyword, is_useful_token, normalize_text, parse_keywords

TOP_KEYWORDS = 3


def keyword_frequency(keywords: DataFrame) -> DataFrame:
    """keywords: query_id, pos (order of appearance), passage, keyword. Passages per canonical form; its first spelling."""
    k = keywords.withColumn("canon", canonical_keyword(F.col("keyword"))).where("canon <> ''")
    return k.groupBy("query_id", "canon").agg(F.countDistinct("passage").alias("frequency"), F.min_by("keyword", "pos").alias("keyword"))


def without_overlap(df: DataFrame, queries: DataFrame, fold=casefold) -> DataFrame:
    """Drop keywords that are part of the query, both folded; fold is casefold, or lower for SQL's plain lower case."""
    q = queries.select("query_id", canonical_keyword(F.coalesce(F.col("text"), F.lit("")), fold).alias("__q"))
    return df.join(q, "query_id").where(~F.contains(F.col("__q"), F.col("canon"))).drop("__q")


def select_keywords(frequencies: DataFrame, queries: DataFrame, k: int = TOP_KEYWORDS, fold=casefold) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("frequency"), F.asc("keyword"))
    return without_overlap(frequencies, queries, fold).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).withColumn("keyword_rank", F.col("__n").cast("bigint")).drop("__n")


def expand_queries(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """One row per query and keyword: the query, a space and the keyword; invalid keywords give none."""
    ok = selected.where(~is_invalid_keyword(F.col("keyword")))
    return queries.select("query_id", "text").join(ok, "query_id").select("query_id", "keyword_rank", "keyword", normalize_text(F.concat_ws(" ", "text", "keyword")).alias("expanded_query"))


def segment(keywords: DataFrame, segmenter: Callable[[str], list[str]]) -> DataFrame:
    """Split long Han phrases by a segmenter; useful parts stay, and some second parts join the first, up to 8 signs.

    Of parts with one canonical form the first stays.
    """
    return segmented(keywords, segmenter).withColumn("keyword", F.explode("parts")).drop("parts")


def segmented(keywords: DataFrame, segmenter: Callable[[str], list[str]]) -> DataFrame:
    """keywords with parts: those of segment() in order, the keyword itself where it stays whole."""
    ship_package(keywords.sparkSession)
    long = F.col("keyword").rlike(HAN) & ((F.length("keyword") >= 8) | F.col("keyword").rlike(CONNECTOR))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(parts=[segmenter(k) for k in rows["keyword"]])

    kinds = ", ".join(f"`{n}` {t}" for n, t in keywords.dtypes)
    cut = keywords.where(long).mapInPandas(split, f"{kinds}, parts array<string>")
    useful = F.filter(F.transform("parts", lambda p: normalize_text(p)), is_useful_token)
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def join(acc, p):
        """Left to right; what a part was joined to takes no other one."""
        last = F.try_element_at(acc["out"], F.lit(-1))
        fits = acc["open"] & p.isin(*MERGE_AFTER) & (F.length(last) + F.length(p) <= 8)
        merged = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, p)))
        return F.struct(F.when(fits, merged).otherwise(F.concat(acc["out"], F.array(p))).alias("out"), (~fits).alias("open"))

    joined = F.aggregate(useful, none, join, lambda acc: acc["out"])
    forms = F.transform(joined, lambda p: canonical_keyword(p))
    parts = F.filter(joined, lambda p, i: F.array_position(forms, canonical_keyword(p)) == i + 1)
    cut = cut.withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array("keyword")))
    return keywords.where(~F.coalesce(long, F.lit(False))).withColumn("parts", F.array("keyword")).unionByName(cut)


def parsed_keywords(texts: DataFrame, limit: int, segmenter: Callable[[str], list[str]], raw: str = "raw") -> DataFrame:
    """Rows of texts with keyword and place (from 1): the first `limit` valid keywords of each generated list.

    Long Han phrases count as the parts that segment() gives. A null or invalid list gives no rows. texts needs a column
    text_id that is unique.
    """
    listed = texts.select("text_id", F.posexplode(parse_keywords(F.coalesce(F.col(raw), F.lit("")))).alias("__at", "keyword"))
    parts = segmented(listed, segmenter).select("text_id", "__at", F.posexplode("parts").alias("__part", "keyword")).where(~is_invalid_keyword(F.col("keyword")))
    order = Window.partitionBy("text_id").orderBy("__at", "__part")
    kept = parts.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit).drop("__at", "__part")
    return texts.join(kept, "text_id")


def deduplicated(keywords: DataFrame) -> DataFrame:
    """Of a list's keywords (text_id, place) with one canonical form the first; those without a form go."""
    first = Window.partitionBy("text_id", canonical_keyword(F.col("keyword"))).orderBy("place")
    return keywords.where(canonical_keyword(F.col("keyword")) != "").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
