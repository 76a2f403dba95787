"""Ranking metrics on partly labelled results: unlabelled documents are left out before ranks are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS, THRESHOLD = (10, 30), 2


def masked(results: DataFrame, labels: DataFrame) -> DataFrame:
    """results: query_id, doc_id, rank; labels: query_id, doc_id, relevance. Adds relevance and scored_rank.

    Labels without a query_id hold for every query. Repeated document ids are all counted."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return results.join(labels, [*_query(labels), "doc_id"]).withColumn("scored_rank", F.row_number().over(w).cast("bigint"))


def _query(labels: DataFrame) -> list[str]:
    return ["query_id"] if "query_id" in labels.columns else []


def check_queries(results: DataFrame, labels: DataFrame) -> None:
    """Results for a query without annotations are an error."""
    lost = results.select("query_id").distinct().join(labels.select("query_id").distinct(), "query_id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"no annotations for {[r[0] for r in lost]}")


def evaluate(results: DataFrame, labels: DataFrame, cutoffs=CUTOFFS, threshold: int = THRESHOLD, ideal: str = "retrieved") -> DataFrame:
    """A row per query: counts, MRR, and per cutoff MAP, NDCG, scored hits and scored documents.

    A query whose result list is empty is a row without doc_id, and counts with 0; so does a query whose labels are one
    row without doc_id. A query of results that has no labels is an error. MRR has no cutoff. MAP divides by the lesser of all relevant labels and the cutoff. The ideal order is of the
    retrieved labelled documents, or of all labelled ones for ideal='all'.
    """
    hit = (F.col("relevance") >= threshold).cast("int")
    up = Window.partitionBy("query_id").orderBy("scored_rank").rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "scored_rank")
    m = masked(results, labels).withColumn("hit", hit).withColumn("hits", F.sum("hit").over(up)).withColumn("ideal_rank", F.row_number().over(best))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    log2 = lambda c: F.log2(F.col(c) + 1)
    aggs = [F.count("*").alias("scored_doc_count"), F.min("rank").alias("first_scored_doc_original_rank"), F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("scored_rank"))), F.lit(0.0)).alias("mrr")]
    for k in cutoffs:
        inside = F.col("scored_rank") <= k
        aggs += [
            F.sum(F.when(inside, F.col("hit") * F.col("hits") / F.col("scored_rank")).otherwise(0.0)).alias(f"__ap{k}"),
            F.sum(F.when(inside, gain / log2("scored_rank")).otherwise(0.0)).alias(f"__dcg{k}"),
            F.sum(F.when(F.col("ideal_rank") <= k, gain / log2("ideal_rank")).otherwise(0.0)).alias(f"__ideal{k}"),
            F.sum(F.when(inside, F.col("hit")).otherwise(0)).cast("bigint").alias(f"scored_hits_{k}"),
            F.sum(inside.cast("int")).cast("bigint").alias(f"scored_docs_{k}"),
        ]
    found = m.groupBy("query_id").agg(*aggs)
    retrieved = results.groupBy("query_id").agg(F.count("doc_id").alias("retrieved_doc_count"))
    by = _query(labels)
    known = labels.groupBy(*by).agg(F.count("doc_id").alias("annotated_doc_count"), F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("annotated_relevant_doc_count"))
    beside = lambda left, totals: left.join(totals, by, "left") if by else left.crossJoin(F.broadcast(totals))  # noqa: E731 one row without by
    out = beside(retrieved, known).join(found, "query_id", "left")
    if ideal == "all":
        order = Window.partitionBy(*by).orderBy(F.desc("relevance"))
        every = (labels if by else labels.orderBy(F.desc("relevance")).limit(max(cutoffs))).withColumn("ideal_rank", F.row_number().over(order))
        sums = every.groupBy(*by).agg(*(F.sum(F.when(F.col("ideal_rank") <= k, gain / log2("ideal_rank")).otherwise(0.0)).alias(f"__ideal{k}") for k in cutoffs))
        out = beside(out.drop(*(f"__ideal{k}" for k in cutoffs)), sums)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    unknown = F.raise_error(F.concat(F.lit("no annotations for query "), F.col("query_id").cast("string")))
    known_only = lambda c: F.when(F.col("annotated_doc_count").isNull(), unknown).otherwise(c)
    columns = ["query_id", known_only(F.col("annotated_doc_count")).alias("annotated_doc_count"), "annotated_relevant_doc_count", "retrieved_doc_count", F.coalesce("scored_doc_count", F.lit(0)).alias("scored_doc_count"), "first_scored_doc_original_rank", known_only(zero("mrr")).alias("mrr")]
    for k in cutoffs:
        total = F.least(F.col("annotated_relevant_doc_count"), F.lit(k))
        columns += [
            known_only(F.when(total > 0, zero(f"__ap{k}") / total).otherwise(0.0)).alias(f"map_{k}"),
            known_only(F.when(zero(f"__ideal{k}") > 0, zero(f"__dcg{k}") / F.col(f"__ideal{k}")).otherwise(0.0)).alias(f"ndcg_{k}"),
            F.coalesce(f"scored_hits_{k}", F.lit(0)).alias(f"scored_hits_{k}"),
            F.coalesce(f"scored_docs_{k}", F.lit(0)).alias(f"scored_docs_{k}"),
        ]
    return out.select(*columns)


def aggregate(per_query: DataFrame, *groups: str) -> DataFrame:
    """Plain means over queries; 0 without any."""
    metrics = [c for c in per_query.columns if c == "mrr" or c.startswith(("map_", "ndcg_"))]
    return per_query.groupBy(*groups).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in metrics))
