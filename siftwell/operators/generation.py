"""Rounds of generated passages and keywords: each output is written once, so lost executors and reruns replay it.

A generator samples, so a task that runs again would give another text, and what follows from it would change in
between. Here each round's passages, and then its keyword lists, are a table that counts only once its manifest is
written (sources.cache). Later steps, and a run that begins again after a stop, read the tables; only rounds without one
call the generator. Requests carry a seed made from the query, round and passage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import d2k_prompt, is_meta_text, normalize_text, q2d_focus, q2d_prompt, sanitize_generated
from ..sources import cache
from . import expansion


@dataclass(frozen=True)
class Rounds:
    rounds: int = 3
    passages: int = 2
    keywords: int = 15
    seed: int = 0


def passage_requests(queries: DataFrame, round_: int, config: Rounds) -> DataFrame:
    """query_id, query, round, passage, text_id (unique in the round), seed and prompt of a round's passages."""
    each = queries.select("query_id", normalize_text(F.coalesce(F.col("text"), F.lit(""))).alias("query"), F.lit(round_).alias("round"), F.explode(F.sequence(F.lit(1), F.lit(config.passages))).alias("passage"))
    keyed = each.select("*", F.concat_ws("/", F.col("query_id").cast("string"), F.col("passage").cast("string")).alias("text_id"), F.xxhash64(F.lit(config.seed), F.col("query_id").cast("string"), "round", "passage").alias("seed"))
    return keyed.withColumn("prompt", q2d_prompt(F.col("query"), q2d_focus(F.col("round"), F.col("passage"))))


def generate_keywords(queries: DataFrame, generator: Callable[[DataFrame], DataFrame], root: str, segmenter: Callable[[str], list[str]], config: Rounds = Rounds()) -> tuple[DataFrame, DataFrame]:
    """All rounds' passages and keywords.

    generator takes rows with seed and prompt and adds raw. passages: query_id, round, passage, text (label prefixes
    peeled). keywords: query_id, passage (numbered through all rounds), pos (order of appearance), keyword, without
    repeats within a passage and without parts of the query; as expansion.keyword_frequency() takes them. A passage that
    talks about its task has no keywords. root is the folder of this run's tables; it is bound to the queries and settings.
    """
    spark = queries.sparkSession
    key = cache.fingerprint(queries.select(F.col("query_id").alias("doc_index"), "text"), ["text"], rounds=repr(config))
    passages = keywords = None
    for r in range(1, config.rounds + 1):
        requests = passage_requests(queries, r, config)
        kept = ("query_id", "query", "round", "passage", "text_id", "seed", "raw")
        written = cache.stored(spark, root, f"{key}-passages-{r}", lambda requests=requests: {"table": generator(requests).select(*kept)})["table"]
        texts = written.select("query_id", "query", "round", "passage", "text_id", F.xxhash64("seed", F.lit("keywords")).alias("seed"), sanitize_generated(F.coalesce(F.col("raw"), F.lit(""))).alias("text"))
        asked = texts.where(~is_meta_text(F.col("text"))).withColumn("prompt", d2k_prompt(F.col("query"), F.col("text"), config.keywords))
        lists = cache.stored(spark, root, f"{key}-keywords-{r}", lambda asked=asked: {"table": generator(asked).select("query_id", "query", "round", "passage", "text_id", "raw")})["table"]
        found = expansion.deduplicated(expansion.parsed_keywords(lists, config.keywords, segmenter))
        number = (F.col("round") - 1) * config.passages + F.col("passage")
        found = found.select("query_id", number.alias("passage"), (number.cast("long") * 1_000_000 + F.col("place")).alias("pos"), "keyword")
        texts = texts.select("query_id", "round", "passage", "text")
        passages = texts if passages is None else passages.unionByName(texts)
        keywords = found if keywords is None else keywords.unionByName(found)
    canon = keywords.withColumn("canon", expansion.canonical_keyword(F.col("keyword")))
    return passages, expansion.without_overlap(canon, queries).drop("canon")


def expansion_record(queries: DataFrame, passages: DataFrame, keywords: DataFrame, selected: DataFrame, config: Rounds = Rounds()) -> DataFrame:
    """query_id and expansion: query, selected_keywords by rank, keyword_frequencies (each keyword's first spelling),
    candidate_keywords in order of appearance, and generated_passages with their keywords. All queries have a row."""
    in_order = lambda rows, key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    number = (F.col("round") - 1) * config.passages + F.col("passage")
    found = keywords.groupBy("query_id", F.col("passage").alias("number")).agg(in_order(keywords, "pos", "keyword").alias("keywords"))
    none = F.array().cast("array<string>")
    each = passages.withColumn("number", number).join(found, ["query_id", "number"], "left")
    each = each.select("query_id", F.struct(F.col("round").alias("round_index"), F.col("passage").alias("passage_index"), F.col("text").alias("passage"), F.coalesce("keywords", none).alias("keywords")).alias("p"))
    parts = [
        each.groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("generated_passages")),
        keywords.groupBy("query_id").agg(in_order(keywords, "pos", "keyword").alias("candidate_keywords")),
        expansion.keyword_frequency(keywords).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "frequency")))).alias("keyword_frequencies")),
        selected.groupBy("query_id").agg(in_order(selected, "keyword_rank", "keyword").alias("selected_keywords")),
    ]
    out = queries.select("query_id", normalize_text(F.coalesce(F.col("text"), F.lit(""))).alias("query"))
    for part in parts:
        out = out.join(part, "query_id", "left")
    lists = [F.coalesce(c, none).alias(c) for c in ("selected_keywords",)]
    counted = F.coalesce("keyword_frequencies", F.create_map().cast("map<string,bigint>")).alias("keyword_frequencies")
    return out.select("query_id", F.struct("query", *lists, counted, F.coalesce("candidate_keywords", none).alias("candidate_keywords"), "generated_passages").alias("expansion"))
