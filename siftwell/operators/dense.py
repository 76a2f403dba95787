"""Exact dense retrieval: a grid of query blocks and vector blocks, with a top-k kept while a query block passes them.

Vectors are packed into blocks where they are, by a column of the grid that their doc_index gives; query vectors are
packed likewise and each block goes to every column. Blocks meet in a join by column, so no vector passes the driver, and
a task holds a block of each, and the k best so far of one query block. Only these leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..functions.vectors import dot
from .bm25 import top_k

#: Bytes of a block's matrix of doubles; a longer vector makes a longer block.
BLOCK_BYTES = 1 << 19
LEAST_COLUMNS = 32


def pair_scores(queries: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores of given (query_id, doc_index) pairs."""
    return pairs.join(queries.select("query_id", F.col("vector").alias("__q")), "query_id").join(docs.select("doc_index", F.col("vector").alias("__d")), "doc_index").withColumn("dense_score", dot(F.col("__q"), F.col("__d"))).drop("__q", "__d")


def packed(rows: DataFrame, key: str, column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """col, width, block, ids and data: vectors of one grid column and width as the rows of a matrix of doubles.

    Null and empty vectors, and those with a null, NaN or infinite entry, are left out. Which rows a block has may change
    when a task runs again, which rows a column has doesn't, so lost tasks lose and repeat nothing.
    """
    kind = dict(rows.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], list] = {}

        def close(at: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(at)
            ids = pa.concat_arrays([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts]).tobytes()
            number += 1
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([part << 32 | number]), lists, pa.array([data], pa.binary())], ["col", "width", "block", "ids", "data"])

        for batch in batches:
            vectors, columns = batch.column("vector"), batch.column("col").to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = vectors.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            for width in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == width)
                matrix = flat[(ends[rows] - width)[:, None] + np.arange(width)]
                sound = np.isfinite(matrix).all(axis=1)
                rows, matrix = rows[sound], matrix[sound]
                most = max(1, block_bytes // (8 * width))
                for c in np.unique(columns[rows]).tolist():
                    mine = np.flatnonzero(columns[rows] == c)
                    for k in range(0, len(mine), most):
                        some = mine[k : k + most]
                        entry = held.setdefault((c, width), [])
                        entry.append((batch.column("id").take(pa.array(rows[some])), matrix[some]))
                        if sum(len(p[0]) for p in entry) >= most:
                            yield close((c, width))
        for at in list(held):
            yield close(at)

    chosen = rows.where("vector IS NOT NULL").select(F.col(key).alias("id"), "vector", column.cast("int").alias("col"))
    return chosen.mapInArrow(pack, f"col int, width int, block long, ids array<{kind}>, data binary")


def nearest(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score to eight decimals, equal ones by id: scores and ids (which have a row each)."""
    rounded = np.round(score, 8)
    if score.shape[1] > k:
        least = np.partition(rounded, -k, axis=1)[:, -k]
        m = int((rounded >= least[:, None]).sum(axis=1).max())  # all that tie with the last one stay in
        if m < score.shape[1]:
            some = np.argpartition(-rounded, m - 1, axis=1)[:, :m]
            score, rounded, ids = (np.take_along_axis(x, some, 1) for x in (score, rounded, ids))
    near = np.lexsort((ids, -rounded), axis=1)[:, :k]
    return np.take_along_axis(score, near, 1), np.take_along_axis(ids, near, 1)


def kept_with(scores: np.ndarray, found: np.ndarray, new: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of what is kept, as nearest() gave it, and new scores with an id for each column. Only those that reach a row's
    last kept score are looked at further."""
    if scores.shape[1] < k:
        return nearest(np.concatenate([scores, new], 1), np.concatenate([found, np.broadcast_to(ids, new.shape)], 1), k)
    # a score that rounds to the last one's value is less than 1e-8 below it, but for what large ones are inexact by
    last = np.round(scores[:, -1], 8)
    row, column = np.nonzero(new >= (last - 1e-8 - 1e-14 * np.abs(last))[:, None])
    if not len(row):
        return scores, found
    rows, first, counts = np.unique(row, return_index=True, return_counts=True)
    at = (np.repeat(np.arange(len(rows)), counts), np.arange(len(row)) - np.repeat(first, counts))
    more, names = np.full((len(rows), counts.max()), -np.inf), np.zeros((len(rows), counts.max()), found.dtype)
    more[at], names[at] = new[row, column], ids[column]
    scores[rows], found[rows] = nearest(np.concatenate([scores[rows], more], 1), np.concatenate([found[rows], names], 1), k)
    return scores, found


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, columns: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, doc_index, dense_score, dense_rank over queries(query_id, vector) and docs(doc_index, vector).

    Vectors of different widths don't match, nor do those that packed() leaves out: a query that has no match has no row.
    columns: of the grid, by default as many as there are shuffle partitions. Nothing runs while the plan is built.
    """
    spark = docs.sparkSession
    ship_package(spark)
    columns = columns or max(LEAST_COLUMNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(queries.dtypes)["query_id"]
    left = packed(queries, "query_id", F.lit(0), block_bytes).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    index = docs.withColumn("doc_index", F.col("doc_index").cast("bigint"))
    right = packed(index, "doc_index", F.pmod(F.xxhash64("doc_index"), F.lit(columns)), block_bytes)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, scores, found = None, None, None, None

        def rows() -> pa.RecordBatch:
            n = found.shape[1]
            return pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), n))), pa.array(found.ravel()), pa.array(scores.ravel())], ["query_id", "doc_index", "dense_score"])

        for batch in batches:
            for i in range(batch.num_rows if k > 0 else 0):
                block, width = batch.column("block")[i].as_py(), batch.column("width")[i].as_py()
                q, d = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, width) for c in ("q", "d"))
                score = q @ d.T
                ids = batch.column("ids")[i].values.to_numpy()
                if block != current:
                    if current is not None:
                        yield rows()
                    current, names = block, batch.column("names")[i].values
                    scores, found = nearest(score, np.broadcast_to(ids, score.shape), k)
                else:
                    scores, found = kept_with(scores, found, score, ids, k)
        if current is not None:
            yield rows()

    met = left.select("col", "width", "block", F.col("ids").alias("names"), F.col("data").alias("q")).join(right.select("col", "width", "ids", F.col("data").alias("d")), ["col", "width"])
    out = met.select("block", "width", "names", "q", "ids", "d").mapInArrow(best, f"query_id {kind}, doc_index long, dense_score double")
    return top_k(out, "dense_score", k, "dense_rank")


def min_max_softmax(scored: DataFrame, score: str, out: str, temperature: float = 1.0, min_max: bool = True) -> DataFrame:
    """Per query_id: min-max scale (a constant group becomes 0), divide by the temperature, softmax."""
    w = Window.partitionBy("query_id")
    x = F.col(score)
    if min_max:
        low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
        x = F.when(span > 0, (x - low) / span).otherwise(0.0)
    df = scored.withColumn("__z", x / max(temperature, 1e-6))
    df = df.withColumn("__e", F.exp(F.col("__z") - F.max("__z").over(w)))
    return df.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__z", "__e")
