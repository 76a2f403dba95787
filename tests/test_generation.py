"""Rounds of generation with a generator that never gives the same text twice, and model outputs' functions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import models, vectors
from siftwell.operators import expansion, generation, segmenter

CUT = segmenter.Segmenter({"頭痛": 3, "檢查": 3}).cut


class Stub:
    """Writes the call's number into each text; can fail at a call."""

    def __init__(self, fail_at=None):
        self.calls, self.fail_at = 0, fail_at

    def __call__(self, rows):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("lost")
        call = F.lit(f"call{self.calls}x")
        passage = F.when(F.col("passage") == 2, F.lit("Thinking process: none")).otherwise(F.concat(F.lit("回答："), call, F.lit(" text")))
        listed = F.concat(F.lit("Keywords: rest, sleep, Sleep., headache, "), call)
        return rows.withColumn("raw", F.when(F.col("prompt").endswith("關鍵詞："), listed).otherwise(passage))


def queries(spark):
    return spark.createDataFrame([(1, "my headache"), (2, None)], "query_id long, text string")


def tables(out):
    return tuple(sorted(map(tuple, t.collect())) for t in out)


def test_outputs_are_replayed(spark, tmp_path):
    config = generation.Rounds(rounds=2, passages=2, keywords=9, seed=5)
    stub = Stub()
    first = generation.generate_keywords(queries(spark), stub, str(tmp_path), CUT, config)
    passages, keywords = tables(first)
    assert stub.calls == 4 and tables(first) == (passages, keywords)
    assert [p[1:] for p in passages if p[0] == 1] == [(1, 1, "call1x text"), (1, 2, "Thinking process: none"), (2, 1, "call3x text"), (2, 2, "Thinking process: none")]
    assert [(k[1], k[3]) for k in keywords if k[0] == 1] == [(1, "rest"), (1, "sleep"), (1, "call2x"), (3, "rest"), (3, "sleep"), (3, "call4x")]
    assert [(k[1], k[3]) for k in keywords if k[0] == 2] == [(1, "rest"), (1, "sleep"), (1, "headache"), (1, "call2x"), (3, "rest"), (3, "sleep"), (3, "headache"), (3, "call4x")]
    again = Stub(fail_at=1)  # a rerun asks nothing
    assert tables(generation.generate_keywords(queries(spark), again, str(tmp_path), CUT, config)) == (passages, keywords)
    frequencies = {(r.query_id, r.canon): r.frequency for r in expansion.keyword_frequency(first[1]).collect()}
    assert frequencies[1, "rest"] == 2 and frequencies[1, "call2x"] == 1 and (1, "headache") not in frequencies


def test_restart_in_the_middle(spark, tmp_path):
    config = generation.Rounds(rounds=2, passages=1)
    with pytest.raises(RuntimeError):
        generation.generate_keywords(queries(spark), Stub(fail_at=3), str(tmp_path), CUT, config)
    rest = Stub()
    passages, keywords = tables(generation.generate_keywords(queries(spark), rest, str(tmp_path), CUT, config))
    assert rest.calls == 2  # the second round alone
    assert {p[3] for p in passages} == {"call1x text"} and {k[3] for k in keywords if "call" in k[3]} == {"call2x"}
    other = Stub()
    generation.generate_keywords(queries(spark).where("query_id = 1"), other, str(tmp_path), CUT, config)
    assert other.calls == 4


def test_requests_have_seeds_and_focus(spark):
    rows = [r for k in (1, 2) for r in generation.passage_requests(queries(spark), k, generation.Rounds(passages=3)).collect()]
    assert len({r.seed for r in rows}) == len(rows) == 12
    assert len({r.prompt for r in rows}) == 10  # six focuses in turn, so one comes again for each query


def test_pooling(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for left, n in itertools.product([True, False], range(0, 6)):
        states, mask = rng.normal(size=(5, 3)), [0] * (5 - n) + [1] * n if left else [1] * n + [0] * (5 - n)
        rows.append((states.tolist(), mask))
        want.append((states[-1] if mask[-1] == 1 else states[sum(mask) - 1], states[0]))
    rows.append((None, None))
    df = spark.createDataFrame(rows, "states array<array<double>>, mask array<int>").coalesce(1)
    got = df.select(vectors.last_token_pool(F.col("states"), F.col("mask")).alias("last"), vectors.cls_pool(F.col("states")).alias("cls")).collect()
    assert got[-1].last is None and got[-1].cls is None
    for r, (last, cls) in zip(got, want, strict=False):
        assert r.last == pytest.approx(last.tolist()) and r.cls == pytest.approx(cls.tolist())


def test_pair_scores(spark):
    rows = [(0.5, 2.0), (-1.0, -1.0), (300.0, -300.0), (-900.0, 900.0)]
    df = spark.createDataFrame(rows, "no double, yes double").coalesce(1)
    got = df.select(vectors.pair_score(F.col("no"), F.col("yes")).alias("p"), vectors.pair_score(F.col("no"), F.col("yes"), False).alias("d")).collect()
    for r, (no, yes) in zip(got, rows, strict=True):
        z = np.array([no, yes]) - max(no, yes)
        assert r.p == pytest.approx(np.exp(z[1]) / np.exp(z).sum()) and r.d == yes - no


def test_backends():
    assert models.dense_backend("BAAI/bge-m3") == "bge" and models.reranker_backend("x/BGE-reranker") == "bge"
    assert models.dense_backend("x", "qwen") == "qwen" and models.reranker_backend("Qwen3-Reranker") == "qwen"
    for call in (lambda: models.dense_backend("x"), lambda: models.reranker_backend("bge-m3")):
        with pytest.raises(ValueError):
            call()
