"""The runs drop the texts that no candidate names where they are read; no join shuffles a whole corpus of texts."""

import pytest

from siftwell.plans import runs

D = "/root/testdata/sf0.01"


def shuffled(spark, df) -> int:
    """Bytes that the plan's shuffles wrote, after it ran."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            nodes.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("name", ["hybrid_rrf", "older_merge", "dense_rerank"])
def test_texts_of_others_are_not_shuffled(spark, monkeypatch, name):
    """One query names 150 documents of a thousand at most."""
    queries = runs.queries
    monkeypatch.setattr(runs, "queries", lambda s, d: queries(s, d).limit(1))
    size = spark.read.parquet(f"{D}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first().n
    assert shuffled(spark, getattr(runs, name)(spark, D)) < size / 2
