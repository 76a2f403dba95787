"""Relevance feedback: move a query's vector towards the reranker's distribution over its candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..functions.vectors import dot, norm


@dataclass(frozen=True)
class Config:
    updates: int = 100
    learning_rate: float = 0.005
    temperature: float = 2.0
    min_max: bool = True


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def _distribution(s: np.ndarray, temperature: float, min_max: bool) -> np.ndarray:
    if min_max:
        span = s.max() - s.min()
        s = (s - s.min()) / span if span > 0 else np.zeros_like(s)
    e = np.exp(s / max(temperature, 1e-6) - (s / max(temperature, 1e-6)).max())
    return e / e.sum()


def gradient(q: np.ndarray, docs: np.ndarray, target: np.ndarray, min_max: bool) -> np.ndarray | None:
    """Of the divergence of the softmax of the query's scores from target; None where the scores are all equal.

    With p the softmax of the scaled scores z and g = p - target, scaling adds g . z to the lowest score's slope and
    takes it from the highest one's; scores that tie there share it.
    """
    s = docs @ q
    if not min_max:
        return docs.T @ (_distribution(s, 1.0, False) - target)
    low, high = s == s.min(), s == s.max()
    span = s.max() - s.min()
    if span <= 0:
        return None
    z = (s - s.min()) / span
    g = _distribution(s, 1.0, True) - target
    c = float(g @ z)
    return docs.T @ ((g + c * low / low.sum() - c * high / high.sum()) / span)


def update(q: np.ndarray, docs: np.ndarray, scores: np.ndarray, config: Config = Config()) -> np.ndarray:
    q = _unit(np.asarray(q, np.float64))
    if not len(docs) or config.updates <= 0:
        return q
    target = _distribution(np.asarray(scores, np.float64), config.temperature, config.min_max)
    for _ in range(config.updates):
        step = gradient(q, docs, target, config.min_max)
        if step is None:
            return q
        q = _unit(q - config.learning_rate * step)
    return q


def refit(queries: DataFrame, feedback: DataFrame, docs: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id and vector after the updates, over feedback(query_id, doc_index, score); a query without any keeps its
    own, made unit length. A query's candidates are a top-k, so a group is of bounded size."""
    ship_package(docs.sparkSession)
    kind = dict(queries.dtypes)["query_id"]
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    rows = q.join(feedback.select("query_id", "doc_index", "score"), "query_id", "left").join(docs.select("doc_index", F.col("vector").cast("array<double>").alias("d")), "doc_index", "left")

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_index")
        own = np.array(group["q"].iloc[0], np.float64)
        got = group[group["d"].notna()]
        matrix = np.array(got["d"].tolist(), np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, len(own)))
        return pd.DataFrame({"query_id": group["query_id"].iloc[:1], "vector": [update(own, matrix, got["score"].to_numpy(np.float64), config).tolist()]})

    return rows.groupBy("query_id").applyInPandas(step, f"query_id {kind}, vector array<double>")


def vector_debug(before: DataFrame, after: DataFrame, dims: int = 8) -> DataFrame:
    """Lengths, distance moved and the first entries of the vectors before and after."""
    j = before.select("query_id", F.col("vector").cast("array<double>").alias("b")).join(after.select("query_id", F.col("vector").alias("a")), "query_id")
    delta = F.zip_with("a", "b", lambda x, y: x - y)
    return j.select("query_id", norm(F.col("b")).alias("norm_before"), norm(F.col("a")).alias("norm_after"), F.sqrt(dot(delta, delta)).alias("shift_l2"), F.slice("b", 1, dims).alias("preview_before"), F.slice("a", 1, dims).alias("preview_after"), F.slice(delta, 1, dims).alias("preview_delta"))
