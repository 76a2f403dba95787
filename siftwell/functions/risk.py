"""Risk-model output: prompt, clean-up and parsing into bounded scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NO_SUB_QUERY, normalize_text

# The risks with their weights, and the prompt's texts.
WEIGHTS = {"missing_subquery_risk": 0.35, "topic_mismatch_risk": 0.30, "keyword_only_risk": 0.20, "shallow_answer_risk": 0.15}
KEYS = ["topic_mismatch_risk", "missing_subquery_risk", "keyword_only_risk", "shallow_answer_risk"]
PROMPT_TAIL = (
    "請評估四個風險分數，範圍都是 0 到 1：\n"
    "topic_mismatch_risk: 主題方向錯誤。\n"
    "missing_subquery_risk: 遺漏重要子問題。\n"
    "keyword_only_risk: 只對到關鍵字但沒有真正回答。\n"
    "shallow_answer_risk: 回答太通用、不夠具體。\n\n"
    "只輸出單行 JSON，不要輸出任何其他文字。\n"
    "JSON schema:\n"
    '{"topic_mismatch_risk": <float>, "missing_subquery_risk": <float>, "keyword_only_risk": <float>, "shallow_answer_risk": <float>}'
)


def risk_prompt(query: Column, sub_queries: Column, document: Column) -> Column:
    numbered = F.array_join(F.transform(sub_queries, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), normalize_text(x))), "\n")
    subs = F.when(F.size(F.coalesce(sub_queries, F.array().cast("array<string>"))) > 0, numbered).otherwise(F.lit(NO_SUB_QUERY))
    return F.concat(F.lit("Query：\n"), query, F.lit("\n\nSub-query：\n"), subs, F.lit("\n\nAnswer：\n"), normalize_text(document), F.lit("\n\n" + PROMPT_TAIL))


def with_json_block(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add the braced part of an output without think blocks and code fences; a missing first brace is supplied.

    Each step is a column of its own, so that none is computed again for each use in the next.
    """
    t = F.col(out)
    df = df.withColumn(out, F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"(?is)<think>.*?</think>", ""))
    df = df.withColumn(out, F.trim(F.when(F.contains(t, F.lit("<think>")) & F.contains(t, F.lit("{")), F.substr(t, F.instr(t, "{"))).otherwise(t)))
    df = df.withColumn("__fenced", F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)\n\s*```$", 1))
    df = df.withColumn(out, F.trim(F.when(F.col("__fenced") != "", F.col("__fenced")).otherwise(t)))
    df = df.withColumn("__block", F.regexp_extract(t, r"(?s)\{.*\}", 0))
    repaired = F.when(t.startswith('"topic_mismatch_risk"'), F.concat(F.lit("{\n  "), t))
    repaired = repaired.when(t.startswith("'topic_mismatch_risk'"), F.concat(F.lit('{\n  "topic_mismatch_risk"'), F.substr(t, F.lit(len("'topic_mismatch_risk'") + 1))))
    return df.withColumn(out, F.when(F.col("__block") != "", F.trim("__block")).otherwise(repaired.otherwise(t))).drop("__fenced", "__block")


def clamp(v: Column) -> Column:
    """Text of a JSON value as a number within 0 and 1; what isn't a number is 0, not-a-number is 1."""
    number = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(F.trim(v, F.lit('"')).try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def with_parsed_risk(df: DataFrame, raw: str) -> DataFrame:
    """Add the four risks, risk (their weighted sum) and risk_parse_ok. Any failure gives zeros."""
    df = with_json_block(df, raw, "__json")
    # NaN and infinities are numbers of the format that is read, though JSON has none
    df = df.withColumn("__json", F.regexp_replace("__json", r'(:\s*)(NaN|-?Infinity)(?=\s*[,}])', '$1"$2"')).withColumn("__map", F.from_json("__json", "map<string,string>"))
    whole = F.col("__json").startswith("{") & F.col("__json").endswith("}")
    df = df.withColumn("risk_parse_ok", F.coalesce(whole & F.col("__map").isNotNull() & F.get_json_object("__json", "$").isNotNull(), F.lit(False)))
    for k in KEYS:
        df = df.withColumn(k, F.when(F.col("risk_parse_ok"), clamp(F.col("__map")[k])).otherwise(0.0))
    return df.withColumn("risk", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))).drop("__json", "__map")
