"""Serving a stream of queries against a static index: stateless, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import bm25


def serve(stream: DataFrame, docs: DataFrame, index: bm25.Index, k: int, sink, checkpoint: str | None = None):
    """Start a query that ranks documents for each streamed query (query_id, text); sink takes (results, batch number).

    The checkpoint makes batches replayable; sink should write by batch number to have each result once.
    """

    def batch(queries: DataFrame, number: int) -> None:
        sink(bm25.bm25_top_k(queries, docs, index, k), number)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
