"""The runs from JSON files to JSON files, as the command line has them.

Models are functions: an encoder gives texts vectors, a scorer gives pairs scores, a risk model and a generator write text.
No model runs here, so the command line takes the deterministic stand-ins that MODELS names; a program passes its own.
"""

from __future__ import annotations

import json
import zlib
from argparse import Namespace
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.risk import risk_prompt
from ..operators import dense, evaluation, expansion, feedback, fusion, generation, postings, ranking, segmenter
from ..shipping import ship_package
from ..sources import cache, json_files
from . import pipelines

DIMENSIONS = 256


def hashing_encoder(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds vector: tokens counted by hash, of unit length; a text without tokens has zeros. A stand-in for a model."""
    ship_package(df.sparkSession)

    def vector(words: list[str]) -> np.ndarray:
        v = np.zeros(DIMENSIONS)
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % DIMENSIONS] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(vector=[vector(w) for w in rows["vector"]])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.withColumn("vector", T.tokens(F.col(text))).mapInPandas(encode, f"{kinds}, vector array<float>")


def coverage_risk(candidates: DataFrame) -> DataFrame:
    """Adds risk_raw: the topic risk is what the score lacks to 1. A stand-in for a model that is given the prompt."""
    prompted = candidates.withColumn("risk_prompt", risk_prompt(F.col("query_text"), F.col("sub_queries"), F.col("doc_text")))
    return prompted.withColumn("risk_raw", F.to_json(F.struct((1 - F.col("rerank_score")).alias("topic_mismatch_risk")))).drop("risk_prompt")


def echo_generator(requests: DataFrame) -> DataFrame:
    """Adds raw: the words of the request's query or passage. A stand-in for a model."""
    source = F.col("text") if "text" in requests.columns else F.col("query")
    return requests.withColumn("raw", F.array_join(F.array_distinct(T.tokens(source)), ", "))


#: The models that the command line knows, by kind and name.
MODELS: dict[str, dict[str, Callable]] = {"dense": {"hashing": hashing_encoder}, "reranker": {"coverage": ranking.coverage_scorer}, "risk": {"coverage": coverage_risk}, "generator": {"echo": echo_generator}}


def model(kind: str, name: str) -> Callable:
    if name not in MODELS[kind]:
        raise ValueError(f"unknown {kind} model {name}; known: {', '.join(MODELS[kind])}. Others are passed as functions")
    return MODELS[kind][name]


def load(spark: SparkSession, a: Namespace) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_index, doc_id, question, answer, text, vector) and queries (query_index, query_id, text, vector).

    Document vectors are kept in the vector store under cache_dir and encoded again only where it lacks them.
    """
    mode = {"question": "question", "question+answer": "question_answer", "joined": "joined"}[a.document_text_mode]
    read = json_files.load_documents(spark, a.data, a.limit_docs)
    docs = cache.written(read.select("doc_index", F.col("ID").alias("doc_id"), F.col("Question").alias("question"), F.col("Answer").alias("answer"), T.document_text(F.col("Question"), F.col("Answer"), mode).alias("text")))
    encode = model("dense", a.dense_model)
    key = cache.fingerprint(docs, ["text"], model=a.dense_model)
    if a.no_cache:
        vectors = encode(docs.select("doc_index", "text")).select("doc_index", "vector")
    else:
        root = a.cache_dir or f"{cache.shared_dir(spark)}/siftwell/cache"
        vectors = cache.vector_store(docs.select("doc_index", "text"), encode, f"{root}/dense/{key}", key)
    asked = json_files.load_queries(spark, a.query, a.limit_queries).select("query_index", F.col("ID").alias("query_id"), T.question_text(F.col("Question")).alias("text"))
    instructed = encode(asked.withColumn("instructed", T.with_instruction(F.col("text"), a.retrieval_instruction)), "instructed").drop("instructed")
    return docs.join(vectors, "doc_index", "left"), cache.written(instructed)


def index(spark: SparkSession, docs: DataFrame, a: Namespace) -> postings.StoredIndex:
    root = None if a.no_cache or not a.cache_dir else f"{a.cache_dir}/bm25"
    return postings.open_index(docs.select("doc_index", "text"), root, k1=a.bm25_k1, b=a.bm25_b)


def write(rows: DataFrame, path: str) -> None:
    json_files.json_array_rows.write_array(rows, path, ["query_index"], [c for c in rows.columns if c != "query_index"])


def run_hybrid(spark: SparkSession, a: Namespace) -> None:
    docs, queries = load(spark, a)
    config = pipelines.HybridConfig(a.bm25_top_k, a.dense_top_k, a.risk_top_k, a.final_top_k, a.use_rrf, a.rrf_k, a.bm25_k1, a.bm25_b, a.risk_lambda)
    subs = json_files.load_sub_queries(spark, a.subquery_path) if a.subquery_path else None
    risk = a.subquery_path is not None and a.risk_model is not None
    stages = pipelines.hybrid_stages(queries, docs, config, subs, model("risk", a.risk_model) if risk else None, model("reranker", a.reranker_model), index(spark, docs, a))
    fused, best, results = map(cache.written, stages)
    none = F.array().cast("array<string>")
    known = (subs if subs is not None else queries.select("query_id", none.alias("sub_queries"))).select("query_id", F.coalesce("sub_queries", none).alias("sub_queries"))
    asked = queries.select("query_id").join(known, "query_id", "left").select("query_id", F.coalesce("sub_queries", none).alias("sub_queries"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = {"sub_query_count": F.size("sub_queries"), "fusion_size": n("fusion_size"), "union_size": n("fusion_size"), "rerank_top_k": n("rerank_top_k"), "final_top_k": n("final_top_k")}
    out = pipelines.result_rows(
        queries, {"results": (results, pipelines.HYBRID_FIELDS)}, counts, [asked, pipelines.sizes(fusion_size=fused, rerank_top_k=best, final_top_k=results)],
        fusion_method=config.method, rrf_k=config.rrf_k if config.rrf else None, bm25_top_k=config.bm25_top_k, dense_top_k=config.dense_top_k, dense_model_name_or_path=a.dense_model, reranker_model_name_or_path=a.reranker_model,
        risk_penalty_enabled=risk, risk_model_name_or_path=a.risk_model if risk else None, risk_lambda=config.risk_lambda if risk else None, risk_top_k=config.risk_top_k if risk else None,
        retrieval_instruction=a.retrieval_instruction, document_text_mode="Question + Answer", bm25=F.struct(F.lit(config.k1).alias("k1"), F.lit(config.b).alias("b")),
    )
    write(out, a.output)


def run_dense(spark: SparkSession, a: Namespace) -> None:
    docs, queries = load(spark, a)
    near, best = map(cache.written, pipelines.dense_rerank(queries, docs, a.dense_top_k, a.rerank_top_k, model("reranker", a.reranker_model)))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("dense_top_k", "rerank_top_k")}
    lists = {"dense_results": (near, pipelines.DENSE_FIELDS), "rerank_results": (best, pipelines.RERANK_FIELDS)}
    settings = {"dense_model_name_or_path": a.dense_model, "reranker_model_name_or_path": a.reranker_model, "document_text_mode": a.document_text_mode, "retrieval_instruction": a.retrieval_instruction}
    write(pipelines.result_rows(queries, lists, counts, [pipelines.sizes(dense_top_k=near, rerank_top_k=best)], **settings), a.output)
    if a.annotation:
        evaluate(spark, a.annotation, a.output, a.evaluation_output)


def _refit(a: Namespace) -> feedback.Config:
    return feedback.Config(a.refit_updates, a.refit_learning_rate, a.refit_temperature, not a.refit_no_minmax)


def _refit_settings(a: Namespace) -> dict:
    return {"refit_updates": a.refit_updates, "refit_learning_rate": a.refit_learning_rate, "refit_temperature": a.refit_temperature, "refit_use_minmax": not a.refit_no_minmax, "dense_model_name_or_path": a.dense_model, "reranker_model_name_or_path": a.reranker_model, "retrieval_instruction": a.retrieval_instruction}


def _taught(spark: SparkSession, a: Namespace, teach: Callable) -> tuple:
    """What the two feedback runs share: first list, teacher's facts, moved vectors, second list joined with the facts."""
    docs, queries = load(spark, a)
    first = cache.written(dense.dense_top_k(queries, docs, a.feedback_top_k))
    facts, score = teach(queries, docs, first)
    facts = cache.written(facts)
    scores = facts.select("query_id", "doc_index", F.col(score).alias("score"))
    moved = cache.written(feedback.refit(queries, scores, docs, _refit(a)))
    second = dense.dense_top_k(moved, docs, a.final_top_k).join(facts, ["query_id", "doc_index"], "left").withColumn("rank", F.col("dense_rank"))
    shift = feedback.vector_debug(queries, moved).select("query_id", F.col("shift_l2").alias("query_vector_shift_l2"))
    return docs, queries, first, shift, second


def run_feedback(spark: SparkSession, a: Namespace) -> None:
    def teach(queries: DataFrame, docs: DataFrame, first: DataFrame) -> tuple[DataFrame, str]:
        order = pipelines.Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_feedback_score", 8)), "first_dense_rank")
        scored = model("reranker", a.reranker_model)(pipelines.with_texts(first, queries, docs))
        facts = scored.select("query_id", "doc_index", F.col("dense_score").alias("first_dense_score"), F.col("dense_rank").alias("first_dense_rank"), F.col("rerank_score").alias("rerank_feedback_score"))
        return facts.withColumn("first_rerank_rank", F.row_number().over(order).cast("bigint")), "rerank_feedback_score"

    docs, queries, first, shift, second = _taught(spark, a, teach)
    second = second.withColumnsRenamed({"dense_score": "refit_dense_score", "dense_rank": "refit_rank"})
    results = cache.written(pipelines.project(second, docs, pipelines.FEEDBACK_FIELDS))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("feedback_top_k", "final_top_k")}
    write(pipelines.result_rows(queries, {"refit_results": (results, pipelines.FEEDBACK_FIELDS)}, counts, [shift, pipelines.sizes(feedback_top_k=first, final_top_k=results)], **_refit_settings(a)), a.output)


def run_fused(spark: SparkSession, a: Namespace) -> None:
    rounds = generation.Rounds(a.gff_rounds, a.gff_passages_per_round, a.gff_keywords_per_passage)
    root = a.cache_dir or f"{cache.shared_dir(spark)}/siftwell/cache"
    beside: dict[str, DataFrame] = {}

    def teach(queries: DataFrame, docs: DataFrame, first: DataFrame) -> tuple[DataFrame, str]:
        cutter = segmenter.segmenter(segmenter.learn(docs.select("text")))
        passages, keywords = generation.generate_keywords(queries, model("generator", a.generator_model), f"{root}/generated", cutter.cut, rounds)
        chosen = expansion.select_keywords(expansion.keyword_frequency(keywords), queries, a.gff_top_keywords)
        variants = cache.written(pipelines.query_variants(queries, keywords, a.gff_top_keywords))
        lists = cache.written(pipelines.variant_lists(first, variants, docs, model("reranker", a.reranker_model)))
        beside["expansion"] = generation.expansion_record(queries, passages, keywords, chosen, rounds)
        beside["fusion"] = fusion.fusion_record(lists.select("query_id", "list_label", "doc_index", "rank"), variants, docs, a.gff_rrf_k, a.gff_original_query_weight)
        return pipelines.fused_first_stage(first, lists, a.gff_rrf_k, a.gff_original_query_weight).drop("list_ranks"), "first_gff_fused_score"

    docs, queries, first, shift, second = _taught(spark, a, teach)
    second = second.withColumnsRenamed({"dense_score": "refit_dense_score", "dense_rank": "refit_dense_rank"})
    results = cache.written(pipelines.project(second, docs, pipelines.FUSED_FEEDBACK_FIELDS))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("feedback_top_k", "final_top_k")}
    settings = _refit_settings(a) | {"generator_model_name_or_path": a.generator_model}
    parts = {"rounds": rounds.rounds, "passages_per_round": rounds.passages, "keywords_per_passage": rounds.keywords, "top_keywords": a.gff_top_keywords, "rrf_k": a.gff_rrf_k, "original_query_weight": a.gff_original_query_weight}
    gff = F.struct(*(F.lit(v).alias(k) for k, v in parts.items()), F.col("expansion").alias("query_expansion"), F.col("fusion").alias("first_stage_fusion"))
    out = pipelines.result_rows(queries, {"refit_results": (results, pipelines.FUSED_FEEDBACK_FIELDS)}, counts, [shift, *beside.values(), pipelines.sizes(feedback_top_k=first, final_top_k=results)], **settings, gff=gff)
    write(out.drop("expansion", "fusion"), a.output)


def run_merge(spark: SparkSession, a: Namespace) -> None:
    docs, queries = load(spark, a)
    results = cache.written(pipelines.older_merge(queries, docs, a.bm25_top_k, a.dense_top_k, a.final_top_k, model("reranker", a.reranker_model)))
    counts = {"result_count": F.coalesce(F.col("result_count"), F.lit(0))}
    write(pipelines.result_rows(queries, {"results": (results, pipelines.OLDER_FIELDS)}, counts, [pipelines.sizes(result_count=results)]), a.output)


RUNS = {"hybrid": run_hybrid, "dense": run_dense, "feedback": run_feedback, "fused": run_fused, "merge": run_merge}

NAMES = {"mrr": "MRR", "map_": "MAP@", "ndcg_": "NDCG@", "scored_hits_": "scored_hits@", "scored_docs_": "scored_docs@"}


def file_names(df: DataFrame) -> DataFrame:
    """Columns named as in evaluation files: MRR, MAP@10, scored_hits@10 and so on."""
    named = {c: new + c[len(old) :] for c in df.columns for old, new in NAMES.items() if c.startswith(old)}
    return df.withColumnsRenamed(named)


def evaluate(spark: SparkSession, annotation: str, result: str, output: str | None = None, fields: tuple[str, ...] = pipelines.RESULT_FIELDS, threshold: int = evaluation.THRESHOLD) -> str:
    """Write one evaluation file for a result file, by default <stem>.evaluation.json beside it, and return its path.

    With several fields it holds one evaluation under each field's name. Queries come in the result file's order; the file
    of annotated queries is small, so it is put together on the driver.
    """
    per_query, means = pipelines.evaluate_file(spark, annotation, result, fields, threshold)
    places = json_files.json_array(spark, result, "struct<query_id:string>").select("pos", F.col("item.query_id").alias("query_id"))
    rows = [json.loads(r[0]) for r in file_names(per_query).join(places.groupBy("query_id").agg(F.min("pos").alias("pos")), "query_id").orderBy("pos").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    totals = {r["result_field"]: r for r in (json.loads(x[0]) for x in file_names(means).select(F.to_json(F.struct("*"))).collect())}
    found = {}
    for field in fields:
        own = [{k: v for k, v in r.items() if k not in ("result_field", "pos")} for r in rows if r["result_field"] == field]
        mean = {k: v for k, v in totals.get(field, {}).items() if k != "result_field"}
        found[field] = {
            "annotation_path": annotation, "result_path": result, "result_field": field, "binary_relevance_threshold": threshold, "filter_rule": "remove_unlabeled_docs_then_apply_metrics", "query_count": len(own),
            "per_query": own, "aggregate": mean,
        }
    content = found if len(fields) > 1 else found[fields[0]]
    target = output or f"{result.removesuffix('.json')}.evaluation.json"
    cache.write_text(spark, target, json.dumps(content, ensure_ascii=False, indent=2) + "\n")
    return target
