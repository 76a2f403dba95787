"""Runs from files to files: fields, counts, order, risk, restart from what is kept, the evaluation file."""

import json

import pytest

from siftwell import cli
from siftwell.plans import files, pipelines

DOCS = [{"ID": f"d{i}", "Question": q, "Answer": a, "extra": 1} for i, (q, a) in enumerate([("rest and sleep", "sleep well {at} \"night\""), ("headache and pills", "rest"), ("cold hands", None), ("頭痛 怎麼辦", "就醫 檢查"), ("sleep sleep", "no"), ("", "")])]
QUERIES = [{"ID": "q2", "Question": "how to  sleep"}, {"ID": "q1", "Question": "頭痛"}, {"ID": "q3", "Question": "zzz"}]
SUBS = [{"ID": "q2", "sub_question": [" when? ", ""]}, {"query_id": "q1", "sub_queries": []}]


@pytest.fixture
def folder(tmp_path):
    for name, rows in (("docs", DOCS), ("queries", QUERIES), ("subs", SUBS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    return tmp_path


def run(spark, folder, name, *flags):
    out = folder / "out" / f"{name}.json"
    cli.main([name, "--data", str(folder / "docs.json"), "--query", str(folder / "queries.json"), "--output", str(out), "--cache_dir", str(folder / "cache"), *flags])
    rows = json.loads(out.read_text())
    assert [r["query_id"] for r in rows] == ["q2", "q1", "q3"] and rows[0]["query"] == "how to sleep"
    return rows


def test_hybrid(spark, folder):
    plain = run(spark, folder, "hybrid", "--final_top_k", "4")
    assert [*plain[0]["results"][0]] == pipelines.HYBRID_FIELDS
    first = plain[0]["results"][0]
    assert first["doc_id"] in ("d0", "d4") and first["question"] and first["risk"] == 0 and first["risk_parse_ok"] is None and first["fusion_method"] == "union" and first["rrf_score"] is None
    assert plain[0]["final_top_k"] == 4 and plain[0]["fusion_size"] == 6 and plain[0]["rerank_top_k"] == 4 and not plain[0]["risk_penalty_enabled"] and plain[0]["sub_queries"] == []
    risky = run(spark, folder, "hybrid", "--subquery_path", str(folder / "subs.json"), "--rrf", "--final_top_k", "3", "--risk_top_k", "5")
    assert risky[0]["sub_queries"] == ["when?"] and risky[0]["sub_query_count"] == 1 and risky[1]["sub_queries"] == risky[2]["sub_queries"] == []
    assert risky[0]["rerank_top_k"] == 5 and risky[0]["final_top_k"] == 3 and risky[0]["rrf_k"] == 60 and risky[0]["bm25"] == {"k1": 1.5, "b": 0.75}
    top = risky[0]["results"][0]
    assert top["risk_parse_ok"] and top["final_score"] == pytest.approx(top["rerank_score"] - 0.1 * 0.3 * (1 - top["rerank_score"]))
    assert risky[1]["results"][0]["risk_parse_ok"] is None and risky[1]["results"][0]["doc_id"] == "d3"
    assert [r["rank"] for r in risky[2]["results"]] == [1, 2, 3]


def test_dense_and_evaluation(spark, folder):
    labels = [{"id": q["ID"], "question": q["Question"], "answers": [{"id": "d0", "final_answer": 2}, {"id": "d3", "final_answer": 2}, {"id": "d5", "final_answer": 0}]} for q in QUERIES]
    (folder / "labels.json").write_text(json.dumps(labels))
    rows = run(spark, folder, "dense", "--dense_top_k", "5", "--rerank_top_k", "2", "--annotation", str(folder / "labels.json"))
    assert [*rows[0]["dense_results"][0]] == pipelines.DENSE_FIELDS and [*rows[0]["rerank_results"][0]] == pipelines.RERANK_FIELDS
    assert rows[0]["dense_top_k"] == 5 and rows[0]["rerank_top_k"] == 2 and rows[0]["document_text_mode"] == "question"
    found = json.loads((folder / "out" / "dense.evaluation.json").read_text())
    assert [*found] == ["dense_results", "rerank_results"]
    one = found["rerank_results"]
    assert one["query_count"] == 3 and [r["query_id"] for r in one["per_query"]] == ["q2", "q1", "q3"] and one["binary_relevance_threshold"] == 2
    assert [*one["per_query"][0]][:7] == ["query_id", "annotated_doc_count", "annotated_relevant_doc_count", "retrieved_doc_count", "scored_doc_count", "first_scored_doc_original_rank", "MRR"]
    assert [*one["aggregate"]] == ["MRR", "MAP@10", "NDCG@10", "MAP@30", "NDCG@30"]
    assert one["aggregate"]["MRR"] == pytest.approx(sum(r["MRR"] for r in one["per_query"]) / 3)
    cli.main(["evaluate", "--annotation", str(folder / "labels.json"), "--result", str(folder / "out" / "dense.json"), "--result_field", "rerank_results", "--output", str(folder / "e.json")])
    assert json.loads((folder / "e.json").read_text())["per_query"] == one["per_query"]


def test_feedback(spark, folder):
    rows = run(spark, folder, "feedback", "--feedback_top_k", "3", "--final_top_k", "4", "--refit_updates", "5")
    assert [*rows[0]["refit_results"][0]] == pipelines.FEEDBACK_FIELDS
    assert rows[0]["feedback_top_k"] == 3 and rows[0]["final_top_k"] == 4 and rows[0]["refit_use_minmax"] and rows[0]["query_vector_shift_l2"] > 0
    ranks = sorted(r["first_rerank_rank"] for r in rows[0]["refit_results"] if r["first_rerank_rank"])
    assert ranks == [1, 2, 3][: len(ranks)] and any(r["first_dense_rank"] is None for r in rows[0]["refit_results"])


def test_fused(spark, folder):
    rows = run(spark, folder, "fused", "--feedback_top_k", "4", "--final_top_k", "3", "--refit_updates", "2", "--gff_rounds", "2", "--gff_passages_per_round", "1")
    assert [*rows[0]["refit_results"][0]] == pipelines.FUSED_FEEDBACK_FIELDS and rows[0]["gff"]["rounds"] == 2
    grown = rows[0]["gff"]["query_expansion"]
    assert [*grown] == ["query", "selected_keywords", "keyword_frequencies", "candidate_keywords", "generated_passages"]
    assert [(p["round_index"], p["passage_index"]) for p in grown["generated_passages"]] == [(1, 1), (2, 1)] and grown["query"] == "how to sleep"
    assert sum(grown["keyword_frequencies"].values()) == len(grown["candidate_keywords"]) == sum(len(p["keywords"]) for p in grown["generated_passages"])
    fused = rows[0]["gff"]["first_stage_fusion"]
    assert [*fused] == ["anchor_doc_index", "ranked_doc_indices", "contributions"] and len(fused["ranked_doc_indices"]) == 4
    own = fused["contributions"][-1]
    assert own == {"label": "original_query", "query_text": "how to sleep", "list_weight": 0.3, "anchor_doc_rank": 1, "anchor_doc_id": f"d{fused['anchor_doc_index']}"}
    assert run(spark, folder, "fused", "--feedback_top_k", "4", "--final_top_k", "3", "--refit_updates", "2", "--gff_rounds", "2", "--gff_passages_per_round", "1") == rows


def test_merge(spark, folder):
    rows = run(spark, folder, "merge", "--final_top_k", "2", "--no_cache")
    assert [*rows[0]["results"][0]] == pipelines.OLDER_FIELDS and rows[0]["result_count"] == 2
    assert rows[0]["results"][0]["sources"] == ["bm25", "dense"]


def test_unknown_models():
    with pytest.raises(ValueError):
        files.model("dense", "other")
