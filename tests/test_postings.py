"""The stored index: pruning changes nothing, half-written tables are refused, hot terms are spread."""

import random
import uuid

import pytest

from siftwell.operators import bm25, postings, ranking
from siftwell.sources import cache


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = ["common"] * 30 + ["often"] * 8 + [f"w{i}" for i in range(60)] + ["頭痛", "藥物"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "common " * 500)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)] + [(90, "absent"), (91, ""), (92, "common"), (93, "common common w1")]
    return spark.createDataFrame(rows, "doc_index long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def results(df):
    return sorted((r.query_id, r.bm25_rank, r.doc_index, round(r.bm25_score, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """Small blocks and parts, so that a small corpus has many of each."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "PART", 64)


@pytest.mark.parametrize("k,k1,b", [(1, 1.5, 0.75), (10, 1.5, 0.75), (50, 0.0, 0.0), (7, 2.0, 1.0), (10_000, 1.5, 0.75)])
def test_pruning_changes_nothing(spark, small, tmp_path, k, k1, b):
    docs, queries = corpus(spark)
    plain = bm25.build_index(docs)
    stored = postings.open_index(docs, str(tmp_path), k1=k1, b=b)
    for pad in (False, True) if k < 100 else (False,):
        want = results(bm25.bm25_top_k(queries, docs, plain, k, pad, k1, b))
        assert results(bm25.bm25_top_k(queries, docs, stored, k, pad, k1, b)) == want
    whole = postings.scores(queries, stored, k, prune=False)
    assert results(bm25.top_k(whole, "bm25_score", k, "bm25_rank")) == results(bm25.bm25_top_k(queries, docs, plain, k, False, k1, b))


def test_pruning_leaves_blocks_out(spark, small, tmp_path):
    docs, queries = corpus(spark, 3000)
    stored = postings.open_index(docs, str(tmp_path))
    one = queries.where("query_id = 93")
    plan = postings.plan_terms(one, stored, 3).collect()
    assert [r.term for r in plan if not r.needed] == ["common"]
    every = postings.scores(one, stored, 3, prune=False).count()
    assert 3 <= postings.scores(one, stored, 3).count() < every / 4


def test_index_is_dealt_out(spark, small, tmp_path):
    docs, _ = corpus(spark)
    stored = postings.open_index(docs, str(tmp_path))
    blocks = stored.blocks.where("term = 'common'").collect()
    assert max(len(b.docs) for b in blocks) <= 4 and len({b.block.part for b in blocks}) > 3
    assert all(b.top == max(b.impacts) and list(b.impacts) == sorted(b.impacts, reverse=True) for b in blocks)
    assert sum(len(b.docs) for b in blocks) == stored.terms.where("term = 'common'").first().df


def test_index_is_kept_and_found(spark, tmp_path):
    docs, queries = corpus(spark, 50)
    first = postings.open_index(docs, str(tmp_path))
    again = postings.open_index(docs, str(tmp_path))
    assert first.blocks.inputFiles() == again.blocks.inputFiles()
    named = postings.open_index(docs, str(tmp_path), key="mine")
    assert postings.open_index(docs.where("doc_index < 0"), str(tmp_path), key="mine").blocks.inputFiles() == named.blocks.inputFiles()
    assert postings.open_index(docs, str(tmp_path), key="mine", b=0.5).blocks.inputFiles() != named.blocks.inputFiles()
    assert postings.open_index(docs, str(tmp_path), k1=1.2).blocks.inputFiles() != first.blocks.inputFiles()
    with pytest.raises(ValueError):
        bm25.bm25_top_k(queries, docs, first, 5, k1=1.2)
    for k1, b in ((-1.0, 0.5), (1.0, 1.5)):
        with pytest.raises(ValueError):
            postings.tables(docs, k1=k1, b=b)


def test_empty_corpus(spark, tmp_path):
    docs, queries = corpus(spark, 5)
    stored = postings.open_index(docs.where("doc_index < 0"), str(tmp_path))
    assert bm25.bm25_top_k(queries, docs, stored, 5, pad=False).count() == 0


def test_coverage_from_the_index(spark, tmp_path):
    docs, queries = corpus(spark, 60)
    stored = postings.open_index(docs, str(tmp_path))
    pairs = queries.crossJoin(docs.select("doc_index"))
    want = ranking.coverage_scorer(pairs.withColumnRenamed("text", "query_text").join(docs.withColumnRenamed("text", "doc_text"), "doc_index"))
    got = postings.coverage_scorer(queries, stored)(pairs.select("query_id", "doc_index"))
    key = lambda df: {(r.query_id, r.doc_index): r.rerank_score for r in df.collect()}
    assert key(got) == key(want)


def test_okapi_lifts_negative_weights(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "a c")], "doc_index long, text string")
    idf = {r.term: r.idf for r in bm25.build_index(docs, idf="robertson").terms.collect()}
    lifted = {r.term: r.idf for r in bm25.build_index(docs, idf="okapi").terms.collect()}
    mean = sum(idf.values()) / 3
    assert idf["a"] < 0 and lifted == pytest.approx({t: 0.25 * mean if w < 0 else w for t, w in idf.items()})
    query = spark.createDataFrame([(1, "b"), (2, "b b")], "query_id long, text string")
    got = {r.query_id: r.bm25_score for r in bm25.scores(query, bm25.build_index(docs, idf="okapi")).collect()}
    assert got[2] == pytest.approx(2 * got[1])
    with pytest.raises(ValueError):
        bm25.build_index(docs, idf="other")


def test_half_written_tables_are_refused(spark, tmp_path):
    path = str(tmp_path)
    spark.range(3).write.parquet(f"{path}/key/build-x/table")
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    assert cache.cached(build, path, "key").count() == 5
    assert cache.cached(build, path, "key").count() == 5 and len(built) == 1
    (tmp_path / "key" / cache.MANIFEST).write_text('{"key": "ke')
    assert cache.cached(build, path, "key").count() == 5 and len(built) == 2


def vectors(rows):
    return rows.selectExpr("doc_index", "array(cast(doc_index as float), 1f) AS vector")


def test_vector_store_resumes(spark, tmp_path):
    docs = spark.range(10).selectExpr("id AS doc_index", "string(id) AS text")
    path, seen = str(tmp_path / "store"), []

    def encode(rows):
        ids = [r.doc_index for r in rows.collect()]
        if 8 in ids and None not in seen:
            seen.append(None)
            raise RuntimeError("cut off")
        seen.extend(ids)
        return vectors(rows)

    with pytest.raises(RuntimeError):
        cache.vector_store(docs, encode, path, "k", rows=4)
    assert sorted(x for x in seen if x is not None) == list(range(8)) and cache.read_store(spark, path).count() == 8
    # a range that was written but not committed is no part of the store
    vectors(docs.where("doc_index >= 8")).write.parquet(f"{path}/range-2-{uuid.uuid4().hex}")
    assert cache.read_store(spark, path).count() == 8
    got = cache.vector_store(docs, encode, path, "k", rows=4)
    assert sorted((r.doc_index, list(r.vector)) for r in got.collect()) == [(i, [i, 1.0]) for i in range(10)]
    assert sorted(x for x in seen if x is not None) == list(range(10))
    # nothing to do, then another key
    cache.vector_store(docs, encode, path, "k", rows=4)
    assert len([x for x in seen if x is not None]) == 10
    assert cache.vector_store(docs.where("doc_index < 3"), encode, path, "other", rows=4).count() == 3


@pytest.mark.parametrize("bad", ["IF(doc_index = 2, array(1f), array(1f, 2f))", "IF(doc_index = 2, NULL, array(1f, 2f))", "IF(doc_index = 2, array(1f, NULL), array(1f, 2f))"])
def test_vector_store_refuses_bad_vectors(spark, tmp_path, bad):
    docs = spark.range(4).selectExpr("id AS doc_index")
    with pytest.raises(ValueError):
        cache.vector_store(docs, lambda x: x.selectExpr("doc_index", f"{bad} AS vector"), str(tmp_path), "k", rows=2)
    assert cache.read_store(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        cache.vector_store(docs, lambda x: vectors(x.where("doc_index <> 2")), str(tmp_path), "k", rows=2)
    assert cache.vector_store(docs, vectors, str(tmp_path), "k", rows=2).count() == 4
    assert cache.vector_store(docs.where("doc_index < 0"), vectors, str(tmp_path / "none"), "k").count() == 0
