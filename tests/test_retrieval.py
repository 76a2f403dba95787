import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.risk import with_parsed_risk
from siftwell.operators import bm25, dense, evaluation, expansion, feedback, fusion
from siftwell.sources import cache, json_files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize_text(F.lit("a　b \x1c c\xa0d\n\te "))) == "a b c d e"
    got = one(spark, T.tokens(F.lit("Réaution 頭痛 MCV foo_bar 3.14 頭")))
    assert got == ["r", "é", "aution", "頭痛", "頭", "痛", "mcv", "foo", "bar", "3", "14", "頭"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_index long, text string")


def test_bm25_pads_and_ignores_repeated_query_terms(spark):
    d = docs(spark, ["a x", "b", "c", None])
    index = bm25.build_index(d)
    q = spark.createDataFrame([(1, "x"), (2, "x x"), (3, "zzz")], "query_id long, text string")
    rows = bm25.bm25_top_k(q, d, index, 3).orderBy("query_id", "bm25_rank").collect()
    by = {i: [(r.doc_index, r.bm25_score) for r in rows if r.query_id == i] for i in (1, 2, 3)}
    assert by[1] == by[2] and [x[0] for x in by[1]] == [0, 1, 2] and by[1][0][1] > 0 and by[1][1][1] == 0
    assert by[3] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_bm25_plan_has_no_all_pairs(spark):
    d = docs(spark, ["a x", "b"])
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    plan = bm25.bm25_top_k(q, d, bm25.build_index(d), 3, pad=False)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_fusion_orders(spark):
    lex = spark.createDataFrame([(1, d, 1.0, r) for d, r in ((1, 1), (2, 2), (3, 3))], "query_id long, doc_index long, bm25_score double, bm25_rank long")
    near = spark.createDataFrame([(1, 3, 1.0, 1), (1, 4, 0.5, 2)], "query_id long, doc_index long, dense_score double, dense_rank long")
    order = lambda df, r: [x.doc_index for x in df.orderBy(r).collect()]
    assert order(fusion.fuse_union(lex, near), "fusion_rank") == [3, 1, 4, 2]
    rrf = fusion.fuse_rrf(lex, near)
    assert order(rrf, "fusion_rank") == [3, 1, 4, 2]
    assert rrf.where("doc_index = 3").first().rrf_score == pytest.approx(1 / 63 + 1 / 61)
    assert order(fusion.legacy_merge(lex, near), "merge_rank") == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        fusion.fuse_rrf(lex, near, -1)


def test_gff_weights(spark):
    lists = spark.createDataFrame([(1, "original", 1, 1), (1, "original", 2, 2), (1, "a", 2, 1), (1, "a", 1, 3), (1, "b", 3, 1)], "query_id long, list_label string, doc_index long, rank long")
    got = {r.doc_index: r.gff_score for r in fusion.gff_fuse(lists).collect()}
    assert got[1] == pytest.approx(0.3 / 61 + 1 / 63 / 63) and got[2] == pytest.approx(0.3 / 62 + 1 / 63 / 61) and 3 not in got


RAW = [
    ('{"topic_mismatch_risk": 0.5, "missing_subquery_risk": 1, "keyword_only_risk": 0, "shallow_answer_risk": 2}', True, 0.15 + 0.35 + 0.15),
    ('```json\n{"topic_mismatch_risk": "0.5"}\n```', True, 0.15),
    ('<think>{"x": 1}</think>{"topic_mismatch_risk": true}', True, 0.3),
    ('"topic_mismatch_risk": 0.1}', True, 0.03),
    ('{"topic_mismatch_risk": NaN, "missing_subquery_risk": -Infinity, "shallow_answer_risk":Infinity}', True, 0.3 + 0.15),
    ("garbage", False, 0.0),
    ("null", False, 0.0),
    ("[]", False, 0.0),
    (None, False, 0.0),
]


def test_risk_outputs(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RAW)], "i int, raw string")
    for r in with_parsed_risk(df, "raw").collect():
        assert (r.risk_parse_ok, round(r.risk, 9)) == (RAW[r.i][1], round(RAW[r.i][2], 9)), RAW[r.i]


def test_dense_and_softmax(spark):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "doc_index long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    near = dense.dense_top_k(q, x, 2)
    assert [(r.doc_index, r.dense_rank) for r in near.orderBy("dense_rank").collect()] == [(0, 1), (2, 2)]
    assert {r.p for r in dense.min_max_softmax(near, "dense_score", "p").collect()} == {0.5}
    assert dense.dense_top_k(q, x, 0).count() == 0


def test_feedback_gradient_matches_differences():
    rng = np.random.default_rng(1)
    docs, q = rng.normal(size=(7, 5)), rng.normal(size=5)
    target = feedback._distribution(rng.normal(size=7), 2.0, True)

    def loss(q):
        p = feedback._distribution(docs @ q, 1.0, True)
        return float((target * (np.log(target) - np.log(p))).sum())

    g = feedback.gradient(q, docs, target, True)
    for k in range(5):
        e = np.zeros(5)
        e[k] = 1e-6
        assert g[k] == pytest.approx((loss(q + e) - loss(q - e)) / 2e-6, abs=1e-6)
    moved = feedback.update(q, docs, np.log(target))
    assert np.linalg.norm(moved) == pytest.approx(1)
    assert np.allclose(feedback.update(q, docs[:1], np.array([1.0])), q / np.linalg.norm(q))
    assert np.allclose(feedback.update(q, docs[:0], np.zeros(0)), q / np.linalg.norm(q))


def test_evaluation_masks(spark):
    results = spark.createDataFrame([(1, d, r) for r, d in enumerate("xacb", 1)], "query_id long, doc_id string, rank long")
    labels = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 0), (1, "d", 2)], "query_id long, doc_id string, relevance int")
    r = evaluation.evaluate(results, labels).first()
    assert (r.mrr, r.map_10, r.scored_doc_count, r.first_scored_doc_original_rank) == (1.0, 0.5, 3, 2)
    assert r.ndcg_10 == pytest.approx((3 + 0.5) / (3 + 1 / math.log2(3)))
    full = evaluation.evaluate(results, labels, ideal="all").first()
    assert full.ndcg_10 < r.ndcg_10
    with pytest.raises(ValueError):
        evaluation.check_queries(results.withColumn("query_id", F.lit(5).cast("bigint")), labels)


def write(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_evaluation_of_files(spark, tmp_path):
    """Empty lists count with 0, the place in the list is the rank, and a query without labels is an error."""
    from siftwell import cli
    from siftwell.plans import pipelines

    labels = [{"id": q, "question": "", "answers": [{"id": "a", "final_answer": 2}, {"id": "b", "final_answer": 0}]} for q in ("1", "2")]
    labels.append({"id": "3", "question": "", "answers": []})
    docs = [{"doc_id": "x", "rank": 9}, {"doc_id": "a", "rank": 1}]
    result = [{"query_id": 1, "dense_results": docs, "rerank_results": docs[1:]}, {"query_id": 2, "dense_results": [], "rerank_results": []}]
    result.append({"query_id": 3, "dense_results": docs, "rerank_results": docs})
    annotation, path = write(tmp_path / "labels.json", labels), write(tmp_path / "r.json", result)
    per, means = pipelines.evaluate_file(spark, annotation, path)
    rows = {(r.result_field, r.query_id): r for r in per.collect()}
    assert len(rows) == 6
    first, empty, bare = (rows["dense_results", q] for q in "123")
    assert (first.first_scored_doc_original_rank, first.retrieved_doc_count, first.scored_doc_count, first.mrr) == (2, 2, 1, 1.0)
    assert (empty.first_scored_doc_original_rank, empty.retrieved_doc_count, empty.scored_doc_count, empty.mrr, empty.map_10) == (None, 0, 0, 0.0, 0.0)
    assert (bare.annotated_doc_count, bare.annotated_relevant_doc_count, bare.retrieved_doc_count, bare.ndcg_30) == (0, 0, 2, 0.0)
    assert {r.result_field: r.mrr for r in means.collect()} == {"dense_results": pytest.approx(1 / 3), "rerank_results": pytest.approx(1 / 3)}
    cli.main(["evaluate", "--annotation", annotation, "--result", path, "--result_field", "dense_results"])
    assert spark.read.json(str(tmp_path / "r.evaluation/aggregate")).first()["MRR"] == pytest.approx(1 / 3)
    assert spark.read.json(str(tmp_path / "r.evaluation/per_query")).count() == 3
    stray = write(tmp_path / "s.json", [{"query_id": "9", "dense_results": docs}])
    for df in pipelines.evaluate_file(spark, annotation, stray, ("dense_results",)):
        with pytest.raises(Exception, match="no annotations for query 9"):
            df.collect()


def test_evaluation_with_labels_of_every_query(spark):
    """Labels without a query give what the same labels for each query give; no query gives means of 0."""
    results = spark.createDataFrame([(q, d, r) for q in (1, 2) for r, d in enumerate((5, 3, 4, 7), q)], "query_id long, doc_id long, rank long")
    labels = spark.createDataFrame([(3, 2), (4, 1), (7, 0), (8, 2)], "doc_id long, relevance int")
    each = results.select("query_id").distinct().crossJoin(labels)
    for ideal in ("retrieved", "all"):
        shared = evaluation.evaluate(results, labels, ideal=ideal)
        assert sorted(shared.collect()) == sorted(evaluation.evaluate(results, each, ideal=ideal).collect())
    none = evaluation.evaluate(results.where("false"), labels)
    assert set(evaluation.aggregate(none).first()) == {0.0}


def test_segments_join_in_pairs(spark):
    """A part joins the one before it unless that was joined itself; repeats go by canonical form."""
    cases = {"頭痛檢查治療與照護": ["檢查", "治療"], "感冒藥治療以及其他": ["感冒藥", "治療"], "疼痛治療治療以及照護": ["疼痛", "治療", "治療"], "MRI以及mri檢查影像": ["MRI", "mri", "影像"]}
    rows = spark.createDataFrame([(k,) for k in cases], "keyword string")
    got = [r.keyword for r in expansion.segment(rows.coalesce(1), cases.__getitem__).collect()]
    assert got == ["檢查治療", "感冒藥治療", "疼痛治療", "治療", "MRI", "影像"]


def test_keywords(spark):
    q = spark.createDataFrame([(1, "頭痛 Fever")], "query_id long, text string")
    k = spark.createDataFrame([(1, 1, 1, "頭"), (1, 2, 1, "頭痛藥"), (1, 3, 2, "頭痛藥."), (1, 4, 2, "fever"), (1, 5, 2, "Rest")], "query_id long, pos long, passage long, keyword string")
    got = expansion.select_keywords(expansion.keyword_frequency(k), q).orderBy("keyword_rank").collect()
    assert [(r.keyword, r.frequency) for r in got] == [("頭痛藥", 2), ("Rest", 1)]
    parsed = one(spark, T.parse_keywords(F.lit("Keywords: - rest, [fever]; 1. water|passage: no"), 3))
    assert parsed == ["rest", "fever", "water"]
    assert one(spark, T.is_meta_text(F.lit("input: x task: y")))


def test_json_sources(spark, tmp_path):
    p = tmp_path / "docs.json"
    p.write_text(json.dumps([{"ID": 7, "Question": None, "Answer": "ä"}, {"ID": "b", "Question": "q", "Answer": True, "extra": 1}]))
    rows = json_files.load_documents(spark, str(p)).orderBy("doc_index").collect()
    assert [tuple(r) for r in rows] == [(0, "7", "None", "ä"), (1, "b", "q", "True")]
    assert json_files.load_documents(spark, str(p), 1).count() == 1
    p.write_text(json.dumps([{"ID": 1}]))
    with pytest.raises(Exception, match="lacks"):
        json_files.load_documents(spark, str(p)).collect()
    p.write_text(json.dumps({"ID": 1}))
    with pytest.raises(Exception, match="array"):
        json_files.load_queries(spark, str(p)).collect()
    p.write_text(json.dumps([{"ID": "1", "sub_question": [" a ", ""]}, {"query_id": "1", "sub_queries": ["b"]}]))
    assert [tuple(r) for r in json_files.load_sub_queries(spark, str(p)).collect()] == [("1", ["b"])]
    p.write_text(json.dumps([{"id": "1", "question": "q", "answers": [{"id": "a", "final_answer": 1}, {"id": "a", "final_answer": 2}]}]))
    assert [tuple(r) for r in json_files.load_annotations(spark, str(p)).collect()] == [("1", "a", 2)]


def test_submission_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(0, "q", "b", "tb", 2, 0), (0, "q", "a", "ta", 1, 1), (0, "q", "c", "tc", None, 2)], "query_index long, question string, doc_id string, text string, rank long, place int")
    r = json_files.submission(rows).first()
    assert r.id == 1 and [a.id for a in r.answers] == ["a", "b", "c"]
    d = docs(spark, ["x", "y"])
    key = cache.fingerprint(d, ["text"], k1=1.5)
    assert key != cache.fingerprint(docs(spark, ["y", "x"]), ["text"], k1=1.5) and len(key) == 16
    path = str(tmp_path / "emb")
    assert cache.resume(d.where("doc_index = 0"), lambda x: x, path).count() == 1
    assert cache.resume(d, lambda x: x, path).count() == 2


def test_serving_stream(spark, tmp_path):
    from siftwell.streaming.serving import serve

    d = docs(spark, ["alpha beta", "gamma"])
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "gamma")], "query_id long, text string").write.parquet(folder)
    seen = []
    stream = spark.readStream.schema("query_id long, text string").parquet(folder)
    query = serve(stream, d, bm25.build_index(d), 1, lambda r, n: seen.extend(r.collect()))
    query.processAllAvailable()
    query.stop()
    assert [(r.query_id, r.doc_index) for r in seen] == [(1, 1)]
