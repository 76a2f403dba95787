"""Reranking, risk penalty and final order, with a deterministic stand-in for the cross-encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import KEYS, with_parsed_risk
from ..functions.text import tokens

RISK_LAMBDA = 0.1


def rerank(candidates: DataFrame, scorer, k: int, incoming: str = "fusion_rank") -> DataFrame:
    """scorer takes the candidates (with their texts) and adds rerank_score, keyed, never by position.

    The k best remain; ties keep the incoming order. rerank_rank repeats the incoming rank, as consumers of the result
    format expect; rerank_position is the place after reranking.
    """
    scored = scorer(candidates)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 8)), F.asc(incoming))
    ranked = scored.withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= k)
    return ranked.withColumn("rerank_position", F.col("__p").cast("bigint")).withColumn("rerank_rank", F.col(incoming)).drop("__p")


def coverage_scorer(candidates: DataFrame) -> DataFrame:
    """Share of the query's distinct tokens that the document has: a stand-in for a cross-encoder, within 0 and 1."""
    df = candidates.withColumn("__q", F.array_distinct(tokens(F.col("query_text")))).withColumn("__d", tokens(F.col("doc_text")))
    share = F.size(F.array_intersect("__q", "__d")) / F.size("__q")
    return df.withColumn("rerank_score", F.when(F.size("__q") > 0, share).otherwise(0.0)).drop("__q", "__d")


def apply_risk(candidates: DataFrame, weight: float = RISK_LAMBDA, enabled: bool = True) -> DataFrame:
    """candidates has rerank_score and, if enabled, sub_queries and risk_raw (the risk model's output).

    Without sub-queries a query's risks are 0 and risk_parse_ok null.
    """
    subs = F.size(F.coalesce(F.col("sub_queries"), F.array().cast("array<string>"))) > 0 if enabled else F.lit(False)
    none = {k: F.lit(0.0) for k in ["risk", *KEYS]} | {"risk_parse_ok": F.lit(None).cast("boolean")}
    df = with_parsed_risk(candidates, "risk_raw") if enabled else candidates.withColumns(none)
    df = df.withColumns({k: F.when(subs, F.col(k)).otherwise(0.0) for k in ["risk", *KEYS]}).withColumn("risk_parse_ok", F.when(subs, F.col("risk_parse_ok")))
    return df.withColumn("rerank_score_norm", F.col("rerank_score")).withColumn("risk_lambda", F.lit(weight)).withColumn("final_score", F.col("rerank_score_norm") - F.lit(weight) * F.col("risk"))


def final_order(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 8)), F.desc(F.round("rerank_score_norm", 8)), F.asc("fusion_rank"), F.asc("doc_index"))
    return candidates.withColumn("__f", F.row_number().over(w)).where(F.col("__f") <= k).withColumn("final_rank", F.col("__f").cast("bigint")).drop("__f")


def rerank_depth(risk_top_k: int, final_top_k: int, risk_enabled: bool) -> int:
    return risk_top_k if risk_enabled else min(final_top_k, risk_top_k)
