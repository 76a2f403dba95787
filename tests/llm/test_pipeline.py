import itertools
import os
from collections import defaultdict

import pytest

from siftwell.llm import common, near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    item = words("bench", 12)
    rows = [(1, words("a", 300)), (2, words("A", 300)), (3, words("a", 300) + " x"), (4, words("b", 40) + " " + item), (5, words("c", 30)), (6, None), (7, ""), (8, "so vile a text")]
    spark.createDataFrame([(i, t, "en", 0) for i, t in rows], "doc_id long, text string, row_key string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(8, 0, 1), (5, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    deduped = corpus_pipeline.remove_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in deduped.collect()) == [2, 3, 4, 5, 7, 8] and deduped.columns == docs.columns
    near = corpus_pipeline.remove_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [1, 4, 5, 6, 8]
    clean = corpus_pipeline.remove_contaminated(spark, docs, str(tmp_path))
    assert 4 not in {r.doc_id for r in clean.collect()} and clean.count() == 7 and clean.schema.names == docs.schema.names
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and {5} <= {r.doc_id for r in out.collect()}


def write(spark, path, rows):
    spark.createDataFrame([(i, t, None, 0) for i, t in rows], "doc_id long, text string, row_key string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "some benchmark item")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(None, None), (None, ""), (3, "one text"), (3, "ONE text"), (4, "z" * 300_000), (5, " ".join(f"w{i}" for i in range(50_000))), (None, "no id")]
    write(spark, tmp_path, rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out if r.doc_id != 5)[:2] == [(0, 0), (0, 2)] and sorted(r.doc_id or 0 for r in out) == [0, 0, 3, 4, 5]


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")
def test_near_copies_of_the_given_documents(spark):
    """Links of 0.8 and more by brute force over the documents that exact dedup keeps: no row goes wrongly, no group is lost
    whole, nine of ten rows are found, but for the one pair that the fingerprints are known to miss."""
    docs = corpus_pipeline.remove_copies(spark, common.read(spark, DATA, "documents"), DATA)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    hashes = {i: set(near_copies.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, h in hashes.items():
        for x in h:
            holders[x].append(i)
    pairs = {(a, b) for rows in holders.values() if len(rows) <= 400 for a, b in itertools.combinations(sorted(rows), 2)}
    links = [(a, b) for a, b in pairs if len(hashes[a] & hashes[b]) >= 0.8 * len(hashes[a] | hashes[b])]
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    kept = {r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, DATA).select("doc_id").collect()}
    right = {i for i in texts if find(i) == i}
    assert right <= kept and len(kept - right) <= max(1, 0.1 * (len(texts) - len(right)))
