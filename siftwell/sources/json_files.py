"""JSON inputs and outputs: documents, queries, sub-queries, annotations, results and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_array as json_array_rows

RESULT_DOCS = 30


def json_array(spark: SparkSession, path: str, element: str = "map<string,string>") -> DataFrame:
    """pos and item of each element of a JSON array file, read in parallel; anything but an array of objects is an error."""
    return json_array_rows.read_array(spark, path, element)


def _field(key: str):
    """A required key as text: null is 'None', true 'True', false 'False'."""
    value = F.col("item")[key]
    value = F.when(value == "true", "True").when(value == "false", "False").otherwise(F.coalesce(value, F.lit("None")))
    return F.when(F.map_contains_key("item", key), value).otherwise(F.raise_error(F.lit(f"an element lacks {key}")).cast("string")).alias(key)


def load_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_index (place in the array: the identity), ID, Question, Answer."""
    rows = json_array(spark, path)
    rows = rows if limit is None else rows.where(F.col("pos") < limit)
    return rows.select(F.col("pos").cast("bigint").alias("doc_index"), *map(_field, ("ID", "Question", "Answer")))


def load_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = json_array(spark, path)
    rows = rows if limit is None else rows.where(F.col("pos") < limit)
    return rows.select(F.col("pos").cast("bigint").alias("query_index"), *map(_field, ("ID", "Question")))


def load_sub_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id and sub_queries, stripped, blank ones left out; both spellings of the keys; the last duplicate holds."""
    rows = json_array(spark, path, "struct<query_id:string,ID:string,sub_queries:array<string>,sub_question:array<string>>")
    subs = F.filter(F.transform(F.coalesce("item.sub_queries", "item.sub_question"), lambda s: F.trim(s)), lambda s: s != "")
    named = rows.select(F.coalesce("item.query_id", "item.ID").alias("query_id"), subs.alias("subs"), "pos")
    return named.groupBy("query_id").agg(F.max_by("subs", "pos").alias("sub_queries"))


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance; the last duplicate holds, of queries and of documents. A query without answers is a
    row without doc_id."""
    rows = json_array(spark, path, "struct<id:string,question:string,answers:array<struct<id:string,final_answer:int>>>")
    last = rows.groupBy("item.id").agg(F.max_by("item", "pos").alias("item"))
    each = last.select(F.col("item.id").alias("query_id"), F.posexplode_outer("item.answers").alias("pos", "a"))
    return each.groupBy("query_id", F.when(F.col("pos").isNotNull(), F.coalesce("a.id", F.lit("None"))).alias("doc_id")).agg(F.max_by("a.final_answer", "pos").alias("relevance"))


def load_results(spark: SparkSession, path: str, field: str) -> DataFrame:
    """query_id, doc_id, rank of one result field of a result file; a missing field is an error.

    The rank is the place in the list, from 1. An empty list is a row without doc_id and rank.
    """
    kind = "array<struct<doc_id:string>>"
    rows = json_array(spark, path, f"struct<query_id:string,{field}:{kind}>")
    items = F.coalesce(F.col(f"item.{field}"), F.raise_error(F.lit(f"a result lacks {field}")).cast(kind))
    each = rows.select(F.col("item.query_id").alias("query_id"), F.posexplode_outer(items).alias("place", "r"))
    doc = F.when(F.col("place").isNotNull(), F.coalesce("r.doc_id", F.lit("None")))
    return each.select("query_id", doc.alias("doc_id"), (F.col("place") + 1).cast("bigint").alias("rank"))


def submission(results: DataFrame, rank: str = "rank", k: int = RESULT_DOCS) -> DataFrame:
    """id (from 1, by query_index), question, answers (id and text of the k best by rank; a missing rank is last)."""
    entry = F.struct(F.coalesce(F.col(rank).cast("double"), F.lit(float("inf"))).alias("r"), F.col("place"), F.col("doc_id").alias("id"), F.col("text"))
    grouped = results.groupBy("query_index", "question").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    return grouped.select((F.col("query_index") + 1).alias("id"), "question", F.transform("top", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"))).alias("answers"))


def to_eval_format(results: DataFrame, source: str = "results", target: str = "rerank_results") -> DataFrame:
    """Rename the result list, sorted by rank, with rank, doc_id, question, answer and rerank_score of each."""
    entry = lambda r: F.struct(*(r[c].alias(c) for c in ("rank", "doc_id", "question", "answer", "rerank_score")))
    return results.withColumn(target, F.sort_array(F.transform(source, entry))).drop(source)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, letters of any script kept as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One indented array file, in the order of the given columns."""
    json_array_rows.write_array(df, path, order)


def lines_to_array(spark: SparkSession, path: str, target: str, schema: str) -> None:
    """JSON lines, blank ones skipped, as one indented array in the lines' order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"))
    items = lines.where(F.trim("value") != "").select("file", "range", "line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("item"))
    json_array_rows.write_array(items, target, ["file", "range", "line"], "item.*")


def array_to_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of a JSON array; a missing id is the place from 1."""
    rows = json_array(spark, path, f"struct<{schema}>")
    return rows.select(F.coalesce(F.col("item.id").cast("bigint"), F.col("pos") + 1).alias("id"), *(F.col(f"item.{c.split(':')[0]}") for c in schema.split(",") if not c.startswith("id:")))
