from siftwell.sources import cache


def test_vector_store_passes_are_bounded(spark, tmp_path):
    """40 ranges take 8 passes over the documents, a range that is added later one; a bad range stops its pass."""
    docs, calls = spark.range(40).selectExpr("id AS doc_index"), []

    def encode(rows):
        calls.append(rows)
        return rows.selectExpr("doc_index", "array(cast(doc_index as float), 1f) AS vector")

    path = str(tmp_path / "store")
    assert cache.vector_store(docs, encode, path, "k", rows=1).count() == 40 and len(calls) == cache.PASSES
    got = cache.vector_store(spark.range(41).selectExpr("id AS doc_index"), encode, path, "k", rows=1)
    assert sorted((r.doc_index, list(r.vector)) for r in got.collect()) == [(i, [i, 1.0]) for i in range(41)] and len(calls) == cache.PASSES + 1
