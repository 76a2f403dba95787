"""Exact nearest neighbours against plain loops; odd vectors; no job while the plan is built."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import dense


def table(spark, name, rows, kind="long"):
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<float>")


def plain(queries, docs, k):
    out = []
    for q, a in queries:
        rows = [(-round(float(np.dot(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float))), 8), d) for d, b in docs if a and b and len(a) == len(b) and np.isfinite(a).all() and np.isfinite(b).all()]
        out += [(q, rank, d) for rank, (_, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,columns,size", [(3, 1, 1 << 19), (7, 5, 64), (1000, 3, 200), (1, 40, 1)])
def test_against_plain_loops(spark, k, columns, size):
    rng = np.random.default_rng(k)
    docs = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]  # many ties
    docs += [(200, [1.0, 2.0]), (201, []), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0])]
    queries = [(f"q{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)]
    queries += [("two", [1.0, 1.0]), ("three", [1.0, 1.0, 1.0]), ("none", []), ("nan", [float("nan")] * 4)]
    want = plain(queries, docs, k)
    q = table(spark, "query_id", [*queries, ("null", None)], "string").repartition(3)
    d = table(spark, "doc_index", [*docs, (202, None)]).repartition(4)
    got = dense.dense_top_k(q, d, k, columns, size).collect()
    assert sorted(((r.query_id, r.dense_rank, r.doc_index) for r in got), key=repr) == want
    assert {r.query_id for r in got} == {f"q{i}" for i in range(20)} | {"two"}


def test_null_entries_dont_match(spark):
    d = spark.sql("SELECT 1L AS doc_index, array(1f, CAST(NULL AS FLOAT)) AS vector UNION ALL SELECT 2L, array(1f, 0f)")
    q = table(spark, "query_id", [(1, [1.0, 1.0])])
    assert [r.doc_index for r in dense.dense_top_k(q, d, 5).collect()] == [2]


def test_plan_without_jobs_and_without_all_pairs(spark):
    stop = F.raise_error(F.lit("a job ran")).cast("array<float>")
    q, d = (spark.range(3).select(F.col("id").alias(n), F.when(F.col("id") >= 0, stop).alias("vector")) for n in ("query_id", "doc_index"))
    plan = dense.dense_top_k(q, d, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_empty_tables(spark):
    q, d = table(spark, "query_id", [(1, [1.0])]), table(spark, "doc_index", [(1, [1.0])])
    assert dense.dense_top_k(q.where("query_id = 0"), d, 3).count() == 0
    assert dense.dense_top_k(q, d.where("doc_index = 0"), 3).count() == 0
    assert dense.dense_top_k(q, d, 0).count() == 0
