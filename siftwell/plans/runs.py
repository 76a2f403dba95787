"""The whole retrieval runs as registered queries, over documents with the vectors of embeddings, and their DuckDB SQL.

A document's question is its text up to the first full stop, its answer the rest; benchmark items with a vector of their
number are the queries. Deterministic stand-ins take the places of the models: shared terms score pairs, the words of the
three nearest documents are the generated keywords, and a risk output is written from rank and score.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import dense, feedback, postings
from ..sources import cache, json_array, json_files
from . import catalog, pipelines

K_DENSE, K_OLDER = 50, 50


def docs(spark: SparkSession, d: str) -> DataFrame:
    """doc_index, doc_id, question, answer, text, vector; documents without a vector have null there."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    question = F.substring_index("text", ". ", 1)
    rows = read("documents").select(F.col("doc_id").alias("doc_index"), F.col("doc_id").cast("string").alias("doc_id"), question.alias("question"), F.expr("substr(text, length(substring_index(text, '. ', 1)) + 3)").alias("answer"), "text")
    return rows.join(read("embeddings").select(F.col("vec_id").alias("doc_index"), F.col("embedding").alias("vector")), "doc_index", "left")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text, vector."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return catalog.queries(spark, d).join(vectors, "query_id")


def sub_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every other query has one sub-query, its own text."""
    return catalog.queries(spark, d).where("query_id % 2 = 0").select("query_id", F.array("text").alias("sub_queries"))


def stand_in_risk(candidates: DataFrame) -> DataFrame:
    """A risk model's output: the topic risk falls with the score, the risk of a shallow answer follows the rank."""
    topic, shallow = F.round(1 - F.col("rerank_score"), 4).cast("string"), (F.col("fusion_rank") % 7).cast("string")
    return candidates.withColumn("risk_raw", F.concat(F.lit('<think>a {draft}</think>{"topic_mismatch_risk": "'), topic, F.lit('", "shallow_answer_risk": '), shallow, F.lit("}")))


def index(spark: SparkSession, d: str) -> postings.StoredIndex:
    return postings.open_index(catalog.docs(spark, d))


_r = catalog._r


def _hybrid(spark, d, rrf):
    config = pipelines.HybridConfig(dense_top_k=K_DENSE, rrf=rrf)
    out = pipelines.hybrid(queries(spark, d), docs(spark, d), config, sub_queries(spark, d), stand_in_risk, index=index(spark, d))
    scores = ["fusion_score", "bm25_score", "dense_score", "rerank_score", "risk", "topic_mismatch_risk", "shallow_answer_risk", "final_score"]
    rest = ["query_id", "rank", "doc_index", "doc_id", "fusion_method", "fusion_rank", "union_seed_rank", "bm25_rank", "dense_rank", "rerank_rank", "risk_parse_ok"]
    return out.select(*rest, F.array_join("candidate_sources", ",").alias("sources"), F.length("question").alias("question_length"), F.length("answer").alias("answer_length"), *map(_r, scores))


def hybrid_union(spark, d):
    return _hybrid(spark, d, False)


def hybrid_rrf(spark, d):
    return _hybrid(spark, d, True)


def dense_rerank(spark, d):
    best = pipelines.dense_rerank(queries(spark, d), docs(spark, d), K_DENSE)[1]
    return best.select("query_id", "rank", "doc_index", "doc_id", F.length("question").alias("question_length"), F.length("answer").alias("answer_length"), "dense_rank", _r("dense_score"), _r("rerank_score"))


def older_merge(spark, d):
    out = pipelines.older_merge(queries(spark, d), docs(spark, d), K_OLDER, K_OLDER)
    return out.select("query_id", "rank", "doc_index", "doc_id", _r("rerank_score"), "bm25_rank", _r("bm25_score"), "dense_rank", _r("dense_score"), F.array_join("sources", ",").alias("sources"))


def _keywords(first: DataFrame, x: DataFrame) -> DataFrame:
    near = first.where("dense_rank <= 3").join(x.select("doc_index", "text"), "doc_index")
    words = near.select("query_id", F.col("dense_rank").alias("passage"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w", "keyword"))
    return words.select("query_id", "passage", (F.col("passage") * 100_000_000 + F.col("w")).alias("pos"), "keyword")


def fused_first_stage(spark, d):
    q, x = queries(spark, d), docs(spark, d)
    first = dense.dense_top_k(q, x, K_DENSE)
    lists = pipelines.variant_lists(first, pipelines.query_variants(q, _keywords(first, x), 3), x)
    ranks = F.array_join(F.transform(F.map_entries("list_ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("list_ranks")
    out = pipelines.fused_first_stage(first, lists)
    return out.select("query_id", "doc_index", "first_dense_rank", _r("first_dense_score"), "first_original_rerank_rank", _r("first_original_rerank_score"), "first_gff_fused_rank", _r("first_gff_fused_score", 9), ranks)


def fused_feedback(spark, d):
    q, x = queries(spark, d), docs(spark, d)
    out = pipelines.fused_feedback(q, x, _keywords(dense.dense_top_k(q, x, 3), x), K_DENSE, 30)
    return out.select("query_id", *(_r(c) if c.endswith("score") else c for c in pipelines.FUSED_FEEDBACK_FIELDS if c not in ("question", "answer")))


def feedback_run(spark, d):
    out = pipelines.feedback_results(queries(spark, d), docs(spark, d), feedback_k=K_DENSE)
    return out.select("query_id", *(_r(c) if c.endswith("score") else c for c in pipelines.FEEDBACK_FIELDS if c not in ("question", "answer")))


def refit_one_update(spark, d):
    """The query vectors after one update without min-max scaling, taught by 1 / rank; entries one by one."""
    q, x = queries(spark, d), docs(spark, d)
    first = dense.dense_top_k(q, x, K_DENSE).withColumn("score", 1.0 / F.col("dense_rank"))
    moved = feedback.refit(q, first, x, feedback.Config(updates=1, learning_rate=0.5, temperature=1.0, min_max=False))
    return moved.select("query_id", F.posexplode("vector").alias("entry", "value")).select("query_id", "entry", F.round("value", 7).alias("value"))


def _own_path(spark: SparkSession, name: str) -> str:
    return f"{cache.shared_dir(spark)}/siftwell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def json_documents(spark, d):
    """documents written as one JSON array and read back from its byte ranges."""
    path = _own_path(spark, "documents") + ".json"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("ID"), F.col("text").alias("Question"), F.col("lang").alias("Answer"))
    json_array.write_array(rows, path, ["doc_id"], ["ID", "Question", "Answer"])
    return json_files.load_documents(spark, path).select("doc_index", "ID", F.sha2("Question", 256).alias("question_sha256"), "Answer")


def vector_store(spark, d):
    """Each document's vector, kept by ranges in a store and read back; the encoder looks the vectors up."""
    vectors = catalog.vectors(spark, d)
    kept = cache.vector_store(vectors.select("doc_index"), lambda rows: rows.join(vectors, "doc_index"), _own_path(spark, "store"), "vectors", rows=1000)
    return kept.select("doc_index", F.size("vector").alias("width"), F.round(norm(F.col("vector")), 6).alias("norm"))


def pair_scores(spark, d):
    """Dense scores of given pairs: each query with the document after its own."""
    q = catalog.vector_queries(spark, d)
    pairs = q.select("query_id", (F.col("query_id") + 1).alias("doc_index"))
    return dense.pair_scores(q, pairs, catalog.vectors(spark, d)).select("query_id", "doc_index", _r("dense_score"))


QUERIES = {f.__name__: f for f in (json_documents, vector_store, pair_scores, hybrid_union, hybrid_rrf, dense_rerank, older_merge, fused_first_stage, fused_feedback, feedback_run, refit_one_update)}

_RUN = f"""{catalog._BM25},
rq AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
rd AS MATERIALIZED (SELECT doc_id AS doc_index, doc_id::VARCHAR AS doc_id, text, length(split_part(text, '. ', 1)) AS question_length, length(substr(text, length(split_part(text, '. ', 1)) + 3)) AS answer_length, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
pad AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_index, coalesce(s, 0) AS bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 8) DESC, doc_index) AS bm25_rank
  FROM (SELECT query_id, doc_index FROM rq, rd) LEFT JOIN sc USING (query_id, doc_index)) WHERE bm25_rank <= {catalog.K_BM25}),
nr AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_index, s AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, doc_index) AS dense_rank
  FROM (SELECT query_id, doc_index, list_inner_product(rq.v, rd.v) AS s FROM rq, rd WHERE rd.v IS NOT NULL)) WHERE dense_rank <= {K_DENSE}),
qset AS (SELECT query_id, list(term) AS q FROM qt GROUP BY query_id)"""


def _fused(rrf: bool) -> str:
    order = "round(fusion_score, 12) DESC, seed" if rrf else "seed"
    score = "coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0)" if rrf else "NULL::DOUBLE"
    return f"""{_RUN},
two AS (SELECT *, least(coalesce(bm25_rank, 1000000000), coalesce(dense_rank, 1000000000)) AS seed, {score} AS fusion_score FROM pad FULL JOIN nr USING (query_id, doc_index)),
fu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, coalesce(dense_rank, 1000000000), coalesce(bm25_rank, 1000000000), doc_index) AS fusion_rank FROM two),
cov AS (SELECT f.*, coalesce(len(list_intersect(q, list_distinct(w)))::DOUBLE / len(q), 0) AS cover FROM fu f LEFT JOIN qset USING (query_id) JOIN tok USING (doc_index)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cover, 8) DESC, fusion_rank) AS pos FROM cov) WHERE pos <= 50),
risked AS (SELECT *, query_id % 2 = 0 AS subs, CASE WHEN query_id % 2 = 0 THEN round(1 - cover, 4) ELSE 0 END AS topic, CASE WHEN query_id % 2 = 0 THEN least(1, fusion_rank % 7) ELSE 0 END::DOUBLE AS shallow FROM best),
fin AS (SELECT *, 0.3::DOUBLE * topic + 0.15::DOUBLE * shallow AS risk FROM risked),
ord AS (SELECT *, cover - 0.1::DOUBLE * risk AS fs, row_number() OVER (PARTITION BY query_id ORDER BY round(cover - 0.1::DOUBLE * risk, 8) DESC, round(cover, 8) DESC, fusion_rank, doc_index) AS rank FROM fin)
SELECT query_id, rank, doc_index, doc_id, '{"rrf" if rrf else "union"}' AS fusion_method, fusion_rank, seed AS union_seed_rank, bm25_rank, dense_rank, fusion_rank AS rerank_rank, CASE WHEN subs THEN true END AS risk_parse_ok,
  concat_ws(',', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS sources, question_length, answer_length,
  round(fusion_score, 6) AS fusion_score, round(bm25_score, 6) AS bm25_score, round(dense_score, 6) AS dense_score, round(cover, 6) AS rerank_score, round(risk, 6) AS risk, round(topic, 6) AS topic_mismatch_risk, round(shallow, 6) AS shallow_answer_risk, round(fs, 6) AS final_score
FROM ord JOIN rd USING (doc_index) WHERE rank <= 30"""


_OKAPI = f"""{_RUN},
ot AS MATERIALIZED (SELECT doc_id AS doc_index, {catalog._tokens("split_part(text, '. ', 1)")} AS w FROM documents),
oc AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM ot),
op AS (SELECT doc_index, dl, term, count(*) AS tf FROM (SELECT doc_index, len(w) AS dl, unnest(w) AS term FROM ot) GROUP BY ALL),
oi AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM op, oc GROUP BY term),
ow AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM oi) ELSE idf END AS idf FROM oi),
oq AS (SELECT item_id AS query_id, unnest({catalog._tokens("text")}) AS term FROM benchmark),
os AS (SELECT query_id, doc_index, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM oq JOIN ow USING (term) JOIN op USING (term), oc GROUP BY ALL),
ol AS (SELECT * FROM (SELECT query_id, doc_index, coalesce(s, 0) AS bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 8) DESC, doc_index) AS bm25_rank
  FROM (SELECT query_id, doc_index FROM rq, rd) LEFT JOIN os USING (query_id, doc_index)) WHERE bm25_rank <= {K_OLDER}),
om AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25_rank, 1000000000), dense_rank) AS merge_rank FROM ol FULL JOIN nr USING (query_id, doc_index)),
cov AS (SELECT f.*, coalesce(len(list_intersect(q, list_distinct(w)))::DOUBLE / len(q), 0) AS cover FROM om f LEFT JOIN qset USING (query_id) JOIN tok USING (doc_index)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cover, 8) DESC, merge_rank) AS rank FROM cov) WHERE rank <= 30)
SELECT query_id, rank, doc_index, doc_id, round(cover, 6) AS rerank_score, bm25_rank, round(bm25_score, 6) AS bm25_score, dense_rank, round(dense_score, 6) AS dense_score,
  concat_ws(',', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS sources FROM best JOIN rd USING (doc_index)"""

_CANON = f"replace(regexp_replace(lower(regexp_replace({catalog._normal('text')}, '^[.,!?;:]+', '')), '[.,!?;:]+$', ''), 'ß', 'ss')"

_STAGE = f"""{_RUN},
kw AS (SELECT query_id, passage, passage * 100000000 + i - 1 AS pos, w[i] AS keyword FROM (SELECT query_id, dense_rank AS passage, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS w FROM nr JOIN rd USING (doc_index) WHERE dense_rank <= 3), unnest(range(1, len(w) + 1)) AS t(i)),
freq AS (SELECT query_id, lower(k.keyword) AS canon, count(DISTINCT passage) AS frequency, arg_min(k.keyword, pos) AS keyword FROM kw k GROUP BY query_id, lower(k.keyword)),
chosen AS (SELECT * FROM (SELECT f.*, text, row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, keyword) AS keyword_rank FROM freq f JOIN rq USING (query_id) WHERE NOT contains({_CANON}, canon)) WHERE keyword_rank <= 3),
var AS (SELECT query_id, 'keyword ' || keyword_rank AS list_label, {catalog._normal("concat(text, ' ', keyword)")} AS t FROM chosen WHERE length(keyword) < 80 UNION ALL SELECT query_id, 'original', text FROM rq),
vt AS (SELECT query_id, list_label, list_distinct({catalog._tokens("t")}) AS q FROM var),
vs AS (SELECT n.query_id, list_label, doc_index, dense_rank, coalesce(len(list_intersect(q, list_distinct(w)))::DOUBLE / nullif(len(q), 0), 0) AS score FROM nr n JOIN vt USING (query_id) JOIN tok USING (doc_index)),
vl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, list_label ORDER BY round(score, 8) DESC, dense_rank) AS rank FROM vs),
wt AS (SELECT o.query_id, o.list_label, 1.0::DOUBLE / (60 + o.rank) AS weight FROM vl o JOIN vl a ON a.query_id = o.query_id AND a.doc_index = o.doc_index AND a.list_label = 'original' AND a.rank = 1 WHERE o.list_label <> 'original'
  UNION ALL SELECT DISTINCT query_id, 'original', 0.3::DOUBLE FROM vl),
st AS (SELECT query_id, doc_index, sum(weight / (60 + rank)) AS g, min(rank) FILTER (list_label = 'original') AS o, min(score) FILTER (list_label = 'original') AS os, string_agg(list_label || '=' || rank, ',' ORDER BY list_label) AS list_ranks FROM vl JOIN wt USING (query_id, list_label) GROUP BY ALL)
SELECT query_id, doc_index, dense_rank AS first_dense_rank, round(dense_score, 6) AS first_dense_score, o AS first_original_rerank_rank, round(os, 6) AS first_original_rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(g, 12) DESC, o, doc_index) AS first_gff_fused_rank, round(g, 9) AS first_gff_fused_score, list_ranks FROM st JOIN nr USING (query_id, doc_index)"""

_UPDATE = f"""{_RUN},
un AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS q FROM rq),
sc2 AS (SELECT n.query_id, d.v, list_inner_product(q, d.v) AS s, 1.0::DOUBLE / dense_rank AS t FROM nr n JOIN un USING (query_id) JOIN rd d USING (doc_index)),
mm AS (SELECT *, CASE WHEN max(s) OVER w > min(s) OVER w THEN exp(s) / sum(exp(s)) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END - exp(t) / sum(exp(t)) OVER w AS g FROM sc2 WINDOW w AS (PARTITION BY query_id)),
gr AS (SELECT query_id, i, sum(g * v[i + 1]) AS g FROM mm, range(0, 64) AS e(i) GROUP BY query_id, i),
st AS (SELECT query_id, i AS entry, q[i + 1] - 0.5::DOUBLE * g AS x FROM gr JOIN un USING (query_id))
SELECT query_id, entry, round(x / sqrt(sum(x * x) OVER (PARTITION BY query_id)), 7) AS value FROM st"""

ORACLE_SQL = {
    "json_documents": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, doc_id::VARCHAR AS ID, sha256(coalesce(text, 'None')) AS question_sha256, coalesce(lang, 'None') AS Answer FROM documents",
    "vector_store": "SELECT vec_id AS doc_index, len(embedding) AS width, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "pair_scores": "SELECT a.vec_id AS query_id, b.vec_id AS doc_index, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dense_score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0",
    "hybrid_union": f"WITH {_fused(False)}",
    "hybrid_rrf": f"WITH {_fused(True)}",
    "dense_rerank": f"""WITH {_RUN}, cov AS (SELECT f.*, coalesce(len(list_intersect(q, list_distinct(w)))::DOUBLE / len(q), 0) AS cover FROM nr f LEFT JOIN qset USING (query_id) JOIN tok USING (doc_index)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cover, 8) DESC, dense_rank) AS rank FROM cov) WHERE rank <= 30)
SELECT query_id, rank, doc_index, doc_id, question_length, answer_length, dense_rank, round(dense_score, 6) AS dense_score, round(cover, 6) AS rerank_score FROM best JOIN rd USING (doc_index)""",
    "older_merge": f"WITH {_OKAPI}",
    "fused_first_stage": f"WITH {_STAGE}",
    "refit_one_update": f"WITH {_UPDATE}",
}
