"""The retrieval pipelines: hybrid, dense + rerank, feedback, keyword-fused feedback and the older merge.

Each takes DataFrames and model seams. A seam is a function from DataFrame to DataFrame that carries the keys; the
defaults are deterministic stand-ins. Texts are joined only to the few candidates that a stage needs them for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bm25, dense, evaluation, expansion, feedback, fusion, postings, ranking
from ..sources import cache, json_files


@dataclass(frozen=True)
class HybridConfig:
    bm25_top_k: int = 100
    dense_top_k: int = 100
    risk_top_k: int = 50
    final_top_k: int = 30
    rrf: bool = False
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    risk_lambda: float = 0.1

    @property
    def method(self) -> str:
        return "rrf" if self.rrf else "union"


def with_texts(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with both texts, dealt out by pair: scoring is spread evenly, whatever files the texts come from and
    however many queries share a document. Only candidates' texts are shuffled."""
    q = queries.select("query_id", F.col("text").alias("query_text"))
    return candidates.join(q, "query_id").join(wanted(docs, candidates).select("doc_index", F.col("text").alias("doc_text")), "doc_index").repartition("query_id", "doc_index")


def wanted(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The documents that some candidate names. The semi join is taken to where texts are read, so that, with few candidates in
    a written table, the others' texts are dropped there and aren't shuffled for any join of docs."""
    return docs.join(candidates.select("doc_index").distinct(), "doc_index", "left_semi")


# The fields of the result formats, in their order.
DOCUMENT_FIELDS = ["doc_id", "question", "answer"]
HYBRID_FIELDS = [
    "rank", "doc_index", "doc_id", "question", "answer", "fusion_method", "fusion_rank", "fusion_score", "candidate_sources", "union_rank", "union_seed_rank", "bm25_score", "bm25_rank", "dense_score", "dense_rank", "rrf_score",
    "rerank_score_norm", "rerank_score", "rerank_rank", "risk_lambda", "risk", "risk_parse_ok", "topic_mismatch_risk", "missing_subquery_risk", "keyword_only_risk", "shallow_answer_risk", "final_score", "final_rank",
]
DENSE_FIELDS = ["rank", "doc_index", "doc_id", "question", "answer", "dense_score"]
RERANK_FIELDS = ["rank", "doc_index", "doc_id", "question", "answer", "dense_rank", "dense_score", "rerank_score"]
FEEDBACK_FIELDS = ["rank", "doc_index", "doc_id", "question", "answer", "first_dense_score", "first_dense_rank", "rerank_feedback_score", "first_rerank_rank", "refit_dense_score", "refit_rank"]
FUSED_FEEDBACK_FIELDS = [
    "rank", "doc_index", "doc_id", "question", "answer", "first_dense_score", "first_dense_rank", "first_original_rerank_score", "first_original_rerank_rank", "first_gff_fused_score", "first_gff_fused_rank",
    "refit_dense_score", "refit_dense_rank",
]
OLDER_FIELDS = ["rank", "doc_index", "doc_id", "question", "answer", "rerank_score", "bm25_rank", "bm25_score", "dense_rank", "dense_score", "sources"]


def project(results: DataFrame, docs: DataFrame, fields: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """query_id and the fields; what a document says comes from docs, where it has such columns (null where it hasn't).
    candidates: a written table that has the results' documents."""
    said = [c for c in DOCUMENT_FIELDS if c in fields]
    docs = docs if candidates is None else wanted(docs, candidates)
    known = docs.select("doc_index", *((F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in said))
    return results.drop(*said).join(known, "doc_index").select("query_id", *fields)


def hybrid_stages(queries: DataFrame, docs: DataFrame, config: HybridConfig = HybridConfig(), sub_queries: DataFrame | None = None, risk_model=None, scorer=ranking.coverage_scorer, index=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All fused candidates, those kept after reranking, and the results (see hybrid)."""
    index = index or postings.open_index(docs, k1=config.k1, b=config.b)
    lexical = bm25.bm25_top_k(queries, docs, index, config.bm25_top_k, k1=config.k1, b=config.b)
    near = dense.dense_top_k(queries, docs, config.dense_top_k)
    fused = fusion.fuse_rrf(lexical, near, config.rrf_k) if config.rrf else fusion.fuse_union(lexical, near).withColumn("rrf_score", F.lit(None).cast("double"))
    fused = cache.written(fused.withColumn("fusion_method", F.lit(config.method)).withColumn("fusion_score", F.col("rrf_score")).withColumn("union_rank", F.col("fusion_rank")).withColumn("union_seed_rank", F.col("seed_rank")))
    risky = sub_queries is not None and risk_model is not None
    best = ranking.rerank(with_texts(fused, queries, docs), scorer, ranking.rerank_depth(config.risk_top_k, config.final_top_k, risky))
    judged = risk_model(best.join(sub_queries, "query_id", "left")) if risky else best
    scored = ranking.apply_risk(judged, config.risk_lambda, risky)
    return fused, best, project(ranking.final_order(scored, config.final_top_k).withColumn("rank", F.col("final_rank")), docs, HYBRID_FIELDS, fused)


def hybrid(queries: DataFrame, docs: DataFrame, config: HybridConfig = HybridConfig(), sub_queries: DataFrame | None = None, risk_model=None, scorer=ranking.coverage_scorer, index=None) -> DataFrame:
    """query_id and HYBRID_FIELDS. queries: query_id, text, vector; docs: doc_index, text, vector, and doc_id, question,
    answer where they are to come out. The risk step runs only with both sub_queries (query_id, sub_queries) and a
    risk_model, which adds risk_raw; index: a stored one, built where none is given."""
    return hybrid_stages(queries, docs, config, sub_queries, risk_model, scorer, index)[2]


def sizes(**lists: DataFrame) -> DataFrame:
    """query_id and the number of rows that it has in each of the named tables."""
    out = None
    for name, rows in lists.items():
        counted = rows.groupBy("query_id").agg(F.count("*").cast("int").alias(name))
        out = counted if out is None else out.join(counted, "query_id", "full_outer")
    return out


def result_rows(queries: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], counts: dict[str, Column], beside: list[DataFrame], **constants) -> DataFrame:
    """A result file's row per query of queries(query_index, query_id, text): its text, what is beside it by query_id, counts,
    the run's constants, and each named list of results (query_id and fields) by rank; empty where there are none.

    Nulls among the constants are columns of null; a result list is a top-k.
    """
    out = queries.select("query_index", "query_id", F.col("text").alias("query"))
    for table in beside:
        out = out.join(table, "query_id", "left")
    for name, (rows, fields) in lists.items():
        entry = F.struct(*fields)
        nested = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias(name))
        out = out.join(nested, "query_id", "left")
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(out.dtypes)[name])))
    extra = [c for table in beside for c in table.columns if c not in ("query_id", *counts)]
    typed = [(v if isinstance(v, Column) else F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in constants.items()]
    return out.select("query_index", "query_id", "query", *extra, *(c.alias(k) for k, c in counts.items()), *typed, *lists)


def dense_rerank(queries: DataFrame, docs: DataFrame, dense_k: int = 100, rerank_k: int = 30, scorer=ranking.coverage_scorer) -> tuple[DataFrame, DataFrame]:
    """Both result lists: query_id and DENSE_FIELDS, query_id and RERANK_FIELDS."""
    near = cache.written(dense.dense_top_k(queries, docs, dense_k))
    best = ranking.rerank(with_texts(near, queries, docs), scorer, rerank_k, incoming="dense_rank")
    return project(near.withColumn("rank", F.col("dense_rank")), docs, DENSE_FIELDS, near), project(best.withColumn("rank", F.col("rerank_position")), docs, RERANK_FIELDS, near)


def second_search(queries: DataFrame, docs: DataFrame, first: DataFrame, scores: DataFrame, final_k: int, config: feedback.Config) -> DataFrame:
    """query_id, doc_index, refit_score and refit_rank by the query vectors that the scores of the first list move."""
    moved = feedback.refit(queries, first.join(scores.select("query_id", "doc_index", "score"), ["query_id", "doc_index"]), docs, config)
    return dense.dense_top_k(moved, docs, final_k).select("query_id", "doc_index", F.col("dense_score").alias("refit_score"), F.col("dense_rank").alias("refit_rank"))


def feedback_retrieval(queries: DataFrame, docs: DataFrame, scores: DataFrame | None = None, feedback_k: int = 100, final_k: int = 30, config: feedback.Config = feedback.Config(), scorer=ranking.coverage_scorer, first: DataFrame | None = None) -> DataFrame:
    """Dense top-k, teacher scores (query_id, doc_index, score; by default the scorer's), query update, dense again.

    first: the first search's results as a written table, where the caller has them; else it is run and written once.
    first_dense_rank, first_dense_score, first_rerank_score and first_rerank_rank are null for documents that the first
    search lacks.
    """
    first = first if first is not None else cache.written(dense.dense_top_k(queries, docs, feedback_k))
    if scores is None:
        scores = scorer(with_texts(first, queries, docs)).select("query_id", "doc_index", F.col("rerank_score").alias("score"))
    second = second_search(queries, docs, first, scores, final_k, config)
    facts = first.join(scores, ["query_id", "doc_index"], "left").select("query_id", "doc_index", F.col("dense_rank").alias("first_dense_rank"), F.col("dense_score").alias("first_dense_score"), F.col("score").alias("first_rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("first_rerank_score", 8)), "first_dense_rank")
    return second.join(facts.withColumn("first_rerank_rank", F.row_number().over(order).cast("bigint")), ["query_id", "doc_index"], "left")


def feedback_results(queries: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """query_id and FEEDBACK_FIELDS of feedback_retrieval()."""
    out = feedback_retrieval(queries, docs, **how).withColumn("rank", F.col("refit_rank"))
    return project(out.withColumnsRenamed({"first_rerank_score": "rerank_feedback_score", "refit_score": "refit_dense_score"}), docs, FEEDBACK_FIELDS)


def query_variants(queries: DataFrame, keywords: DataFrame, top_keywords: int) -> DataFrame:
    """query_id, list_label and query_text: the query itself (`original`) and one per chosen keyword (`keyword 1` ...)."""
    chosen = expansion.select_keywords(expansion.keyword_frequency(keywords), queries, top_keywords)
    variants = expansion.expand_queries(queries, chosen).select("query_id", F.concat(F.lit("keyword "), "keyword_rank").alias("list_label"), F.col("expanded_query").alias("query_text"))
    return variants.unionByName(queries.select("query_id", F.lit(fusion.ORIGINAL).alias("list_label"), F.col("text").alias("query_text")))


def variant_lists(first: DataFrame, variants: DataFrame, docs: DataFrame, scorer=ranking.coverage_scorer) -> DataFrame:
    """query_id, list_label, doc_index, score and rank: the candidates of first(query_id, doc_index, dense_rank), scored
    for all variants in one pass over their texts; ties keep the first order."""
    pairs = first.select("query_id", "doc_index", "dense_rank").join(docs.select("doc_index", F.col("text").alias("doc_text")), "doc_index").join(variants, "query_id")
    order = Window.partitionBy("query_id", "list_label").orderBy(F.desc(F.round("rerank_score", 8)), "dense_rank")
    scored = scorer(pairs.repartition("query_id", "list_label", "doc_index"))
    return scored.select("query_id", "list_label", "doc_index", F.col("rerank_score").alias("score"), F.row_number().over(order).cast("bigint").alias("rank"))


def fused_first_stage(first: DataFrame, lists: DataFrame, k: int = fusion.GFF_K, original_weight: float = fusion.ORIGINAL_WEIGHT) -> DataFrame:
    """A row per candidate: its first dense score and rank, original score and rank, fused score and rank, and its rank in
    each list (list_ranks, a map)."""
    own = F.col("list_label") == fusion.ORIGINAL
    by_list = lists.groupBy("query_id", "doc_index").agg(
        F.max(F.when(own, F.col("score"))).alias("first_original_rerank_score"),
        F.max(F.when(own, F.col("rank"))).alias("first_original_rerank_rank"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("list_label", "rank")))).alias("list_ranks"),
    )
    fused = fusion.gff_fuse(lists.select("query_id", "list_label", "doc_index", "rank"), k, original_weight).select("query_id", "doc_index", F.col("gff_score").alias("first_gff_fused_score"), F.col("gff_rank").alias("first_gff_fused_rank"))
    facts = first.select("query_id", "doc_index", F.col("dense_score").alias("first_dense_score"), F.col("dense_rank").alias("first_dense_rank"))
    return facts.join(by_list, ["query_id", "doc_index"]).join(fused, ["query_id", "doc_index"])


def fused_feedback(queries: DataFrame, docs: DataFrame, keywords: DataFrame, feedback_k: int = 100, final_k: int = 30, top_keywords: int = 3, config: feedback.Config = feedback.Config(), scorer=ranking.coverage_scorer) -> DataFrame:
    """query_id and FUSED_FEEDBACK_FIELDS: as feedback_results, taught by the fusion of the lists that the query and its
    expansions by keywords(query_id, pos, passage, keyword) give. The first stage is written once."""
    first = cache.written(dense.dense_top_k(queries, docs, feedback_k))
    lists = cache.written(variant_lists(first, query_variants(queries, keywords, top_keywords), docs, scorer))
    stage = cache.written(fused_first_stage(first, lists).drop("list_ranks"))
    second = second_search(queries, docs, first, stage.withColumnRenamed("first_gff_fused_score", "score"), final_k, config)
    out = second.join(stage, ["query_id", "doc_index"], "left").withColumn("rank", F.col("refit_rank"))
    return project(out.withColumnsRenamed({"refit_score": "refit_dense_score", "refit_rank": "refit_dense_rank"}), docs, FUSED_FEEDBACK_FIELDS)


def older_merge(queries: DataFrame, docs: DataFrame, bm25_k: int = 50, dense_k: int = 50, rerank_k: int = 30, scorer=ranking.coverage_scorer) -> DataFrame:
    """query_id and OLDER_FIELDS: BM25 of the Okapi form over questions (texts where docs has none) and dense search,
    merged in order of arrival, reranked."""
    text = "question" if "question" in docs.columns else "text"
    asked = queries.select("query_id", F.col("text").alias(text))
    lexical = bm25.bm25_top_k(asked, docs, postings.open_index(docs.select("doc_index", text), text=text, okapi=True), bm25_k, text=text)
    merged = cache.written(fusion.legacy_merge(lexical, dense.dense_top_k(queries, docs, dense_k)))
    best = ranking.rerank(with_texts(merged, queries, docs), scorer, rerank_k, incoming="merge_rank")
    return project(best.withColumn("rank", F.col("rerank_position")).withColumnRenamed("candidate_sources", "sources"), docs, OLDER_FIELDS, merged)


def envelope(results: DataFrame, queries: DataFrame, fields: list[str], rank: str, **constants) -> DataFrame:
    """One nested row per query: its text, the run's constants, the number of results and the results by rank."""
    entry = F.struct(F.col(rank).alias("rank"), *(F.col(c) for c in fields))
    nested = results.groupBy("query_id").agg(F.count("*").alias("result_count"), F.sort_array(F.collect_list(entry)).alias("results"))
    out = queries.select("query_id", F.col("text").alias("query")).join(nested, "query_id", "left")
    return out.select("*", *(F.lit(v).alias(k) for k, v in constants.items()))


RESULT_FIELDS = ("dense_results", "rerank_results")


def evaluate_file(spark: SparkSession, annotation: str, result: str, fields: tuple[str, ...] = RESULT_FIELDS, threshold: int = evaluation.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Metrics of each result field of a result file: by query, and their means (no row for a field without queries)."""
    labels, out = json_files.load_annotations(spark, annotation), None
    for field in fields:
        one = evaluation.evaluate(json_files.load_results(spark, result, field), labels, threshold=threshold).withColumn("result_field", F.lit(field))
        out = one if out is None else out.unionByName(one)
    return out, evaluation.aggregate(out, "result_field")
