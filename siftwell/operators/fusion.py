"""Fusion of candidate lists: union, reciprocal ranks, the older merge, and anchor-weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
GFF_K, ORIGINAL_WEIGHT, ORIGINAL = 60, 0.3, "original"


def merged(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    both = bm25.select("query_id", "doc_index", "bm25_score", "bm25_rank").join(dense.select("query_id", "doc_index", "dense_score", "dense_rank"), ["query_id", "doc_index"], "full_outer")
    found = F.array(F.when(F.col("bm25_rank").isNotNull(), F.lit("bm25")), F.when(F.col("dense_rank").isNotNull(), F.lit("dense")))
    return both.withColumn("candidate_sources", F.array_compact(found)).withColumn("seed_rank", F.least("bm25_rank", "dense_rank"))


def _ranked(df: DataFrame, out: str, *order: Column) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))


def fuse_union(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """By the better rank; at equal ranks the dense candidate comes first."""
    return _ranked(merged(bm25, dense), "fusion_rank", F.asc("seed_rank"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc_index"))


def fuse_rrf(bm25: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """By the sum of 1 / (k + rank) over the lists that have the candidate."""
    if k < 0:
        raise ValueError("k must not be negative")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    df = merged(bm25, dense).withColumn("rrf_score", part("bm25_rank") + part("dense_rank"))
    return _ranked(df, "fusion_rank", F.desc(F.round("rrf_score", 12)), F.asc("seed_rank"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc_index"))


def legacy_merge(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """The order of arrival: BM25's list, then what only the dense list has."""
    return _ranked(merged(bm25, dense).drop("seed_rank"), "merge_rank", F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"))


def gff_contributions(lists: DataFrame, k: int = GFF_K, original_weight: float = ORIGINAL_WEIGHT) -> DataFrame:
    """lists: query_id, list_label, doc_index, rank. The list 'original' has a fixed weight; any other 1 / (k + the rank
    it gives to the original list's first document), and none where it lacks that document."""
    k, weight = max(k, 1), max(original_weight, 0.0)
    anchor = lists.where((F.col("list_label") == ORIGINAL) & (F.col("rank") == 1)).select("query_id", F.col("doc_index").alias("anchor"))
    place = lists.where(F.col("list_label") != ORIGINAL).join(anchor, "query_id").where("doc_index = anchor").groupBy("query_id", "list_label").agg(F.min("rank").alias("anchor_rank"))
    others = place.select("query_id", "list_label", (1.0 / (F.lit(float(k)) + F.col("anchor_rank"))).alias("weight"))
    own = lists.select("query_id").distinct().select("query_id", F.lit(ORIGINAL).alias("list_label"), F.lit(weight).alias("weight"))
    weights = others.unionByName(own).where("weight > 0")
    return lists.join(weights, ["query_id", "list_label"]).withColumn("contribution", F.col("weight") / (F.lit(float(k)) + F.col("rank")))


def gff_fuse(lists: DataFrame, k: int = GFF_K, original_weight: float = ORIGINAL_WEIGHT) -> DataFrame:
    """query_id, doc_index, gff_score, gff_rank; ties keep the original list's order."""
    summed = gff_contributions(lists, k, original_weight).groupBy("query_id", "doc_index").agg(F.sum("contribution").alias("gff_score"), F.min(F.when(F.col("list_label") == ORIGINAL, F.col("rank"))).alias("original_rank"))
    return _ranked(summed, "gff_rank", F.desc(F.round("gff_score", 12)), F.asc_nulls_last("original_rank"), F.asc("doc_index"))


def fusion_record(lists: DataFrame, variants: DataFrame, doc_ids: DataFrame, k: int = GFF_K, original_weight: float = ORIGINAL_WEIGHT) -> DataFrame:
    """query_id and fusion: anchor_doc_index, ranked_doc_indices, and each list's label, query_text, list_weight,
    anchor_doc_rank and anchor_doc_id, expansions first. variants: query_id, list_label, query_text; doc_ids: doc_index,
    doc_id. A query's lists are of bounded size."""
    rank_of_anchor = F.col("list_label") == ORIGINAL
    anchor = lists.where(rank_of_anchor & (F.col("rank") == 1)).select("query_id", F.col("doc_index").alias("anchor"))
    at = lists.join(anchor, "query_id").where("doc_index = anchor").select("query_id", "list_label", "anchor", F.col("rank").alias("anchor_rank"))
    named = at.join(variants, ["query_id", "list_label"]).join(doc_ids.select(F.col("doc_index").alias("anchor"), F.col("doc_id").cast("string").alias("anchor_doc_id")), "anchor")
    own = F.col("list_label") == ORIGINAL
    weight = F.when(own, F.lit(max(original_weight, 0.0))).otherwise(1.0 / (F.lit(float(max(k, 1))) + F.col("anchor_rank")))
    label = F.when(own, F.lit("original_query")).otherwise(F.translate("list_label", " ", "_"))
    entry = F.struct(own.alias("last"), F.col("list_label").alias("by"), label.alias("label"), "query_text", weight.alias("list_weight"), F.col("anchor_rank").alias("anchor_doc_rank"), "anchor_doc_id")
    parts = named.groupBy("query_id", "anchor").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    fields = ("label", "query_text", "list_weight", "anchor_doc_rank", "anchor_doc_id")
    contributions = F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    order = gff_fuse(lists, k, original_weight).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gff_rank", "doc_index"))), lambda x: x["doc_index"]).alias("ranked"))
    return parts.join(order, "query_id").select("query_id", F.struct(F.col("anchor").alias("anchor_doc_index"), F.col("ranked").alias("ranked_doc_indices"), contributions.alias("contributions")).alias("fusion"))
