"""Command line: python -m siftwell.cli hybrid|dense|feedback|fused|merge --data D --query Q --output O, or evaluate
--annotation A --result R. All files are JSON arrays."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.text import INSTRUCTION_HISTORY, INSTRUCTION_SIMILAR
from .operators import evaluation
from .plans import files, pipelines
from .sources.json_files import write_json

file_names = files.file_names


def evaluate(argv: list[str]) -> None:
    """Write the evaluation file, and OUTPUT/per_query and OUTPUT/aggregate as JSON lines."""
    p = argparse.ArgumentParser(prog="evaluate")
    p.add_argument("--annotation", required=True)
    p.add_argument("--result", required=True)
    p.add_argument("--result_field", default="both", choices=["both", *pipelines.RESULT_FIELDS])
    p.add_argument("--output", help="the evaluation file; by default beside the result")
    p.add_argument("--binary_relevance_threshold", type=int, default=evaluation.THRESHOLD, choices=[1, 2])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    fields = pipelines.RESULT_FIELDS if a.result_field == "both" else (a.result_field,)
    files.evaluate(spark, a.annotation, a.result, a.output, fields, a.binary_relevance_threshold)
    per_query, means = pipelines.evaluate_file(spark, a.annotation, a.result, fields, a.binary_relevance_threshold)
    folder = (a.output or a.result).removesuffix(".json").removesuffix(".evaluation") + ".evaluation"
    write_json(file_names(per_query), f"{folder}/per_query")
    write_json(file_names(means), f"{folder}/aggregate")


def parser(run: str) -> argparse.ArgumentParser:
    """The flags of one run; those about a model's batches, precision and device have no use here and don't exist."""
    p = argparse.ArgumentParser(prog=run, description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--data", required=True, help="documents: ID, Question, Answer")
    p.add_argument("--query", required=True, help="queries: ID, Question")
    p.add_argument("--output", required=True)
    p.add_argument("--cache_dir", help="where the index, vectors and generated texts are kept; by default in the shared folder")
    p.add_argument("--no_cache", action="store_true", help="encode anew and keep no vectors")
    p.add_argument("--dense_model", default="hashing", choices=[*files.MODELS["dense"]])
    p.add_argument("--reranker_model", default="coverage", choices=[*files.MODELS["reranker"]])
    p.add_argument("--limit_docs", type=int, help="the first documents only")
    p.add_argument("--limit_queries", type=int, help="the first queries only")
    p.add_argument("--retrieval_instruction", default=INSTRUCTION_HISTORY if run == "hybrid" else INSTRUCTION_SIMILAR)
    p.add_argument("--document_text_mode", default="question" if run == "dense" else "joined", choices=["question", "question+answer", "joined"])
    if run in ("hybrid", "merge"):
        k = 100 if run == "hybrid" else 50
        p.add_argument("--bm25_top_k", type=int, default=k)
        p.add_argument("--dense_top_k", type=int, default=k)
    if run == "hybrid":
        p.add_argument("--subquery_path", help="sub-queries; with them and a risk model risks count")
        p.add_argument("--risk_model", default="coverage", choices=[*files.MODELS["risk"]])
        p.add_argument("--risk_top_k", type=int, default=50)
        p.add_argument("--risk_lambda", type=float, default=0.1)
        p.add_argument("--RRF", "--rrf", dest="use_rrf", action="store_true")
        p.add_argument("--rrf_k", type=int, default=60)
        p.add_argument("--bm25_k1", type=float, default=1.5)
        p.add_argument("--bm25_b", type=float, default=0.75)
    if run == "dense":
        p.add_argument("--dense_top_k", type=int, default=100)
        p.add_argument("--rerank_top_k", type=int, default=30)
        p.add_argument("--annotation", help="evaluates the results as well")
        p.add_argument("--evaluation_output")
    else:
        p.add_argument("--final_top_k", type=int, default=30)
    if run in ("feedback", "fused"):
        p.add_argument("--feedback_top_k", type=int, default=100)
        p.add_argument("--refit_updates", type=int, default=100)
        p.add_argument("--refit_learning_rate", type=float, default=0.005)
        p.add_argument("--refit_temperature", type=float, default=2.0)
        p.add_argument("--refit_no_minmax", action="store_true")
    if run == "fused":
        p.add_argument("--generator_model", default="echo", choices=[*files.MODELS["generator"]])
        p.add_argument("--gff_rounds", type=int, default=3)
        p.add_argument("--gff_passages_per_round", type=int, default=2)
        p.add_argument("--gff_keywords_per_passage", type=int, default=15)
        p.add_argument("--gff_top_keywords", type=int, default=3)
        p.add_argument("--gff_rrf_k", type=int, default=60)
        p.add_argument("--gff_original_query_weight", type=float, default=0.3)
    return p


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["evaluate"]:
        return evaluate(argv[1:])
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("run", choices=[*files.RUNS, "evaluate"])
    run = p.parse_args(argv[:1]).run
    a = parser(run).parse_args(argv[1:])
    files.RUNS[run](SparkSession.builder.appName("siftwell").getOrCreate(), a)


if __name__ == "__main__":
    main()
