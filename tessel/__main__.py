"""Command line: evaluate a question set in a dry run, or merge the shards of a run.

python -m tessel evaluate --data qa.jsonl --method aks --setup keyframe_16f_pool256 --out runs
python -m tessel merge --out merged runs/task_method_setup_s*
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions import text
from .operators import relational
from .plans import pipeline
from .sources import qa, results, tasks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessel", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("evaluate", help="run a method under a setup")
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--task", help="task file (YAML)")
    source.add_argument("--data", help="question set: JSON lines or Parquet")
    run.add_argument("--method", required=True, choices=sorted(catalog.METHODS))
    run.add_argument("--setup", default="lowres_base_256f", choices=sorted(catalog.SETUPS))
    run.add_argument("--model", default="qwen3-vl-4b", choices=sorted(catalog.MODELS))
    run.add_argument("--prune-kwargs", type=catalog.prune_json, default={}, help="parameters of the pruner, a JSON object")
    run.add_argument("--thinking", action=argparse.BooleanOptionalAction, default=None)
    run.add_argument("--only-videos", nargs="+", help="video ids; each must exist")
    run.add_argument("--limit", type=int)
    run.add_argument("--shard", type=text.parse_shard, help="i/N")
    run.add_argument("--out", required=True)
    merge = commands.add_parser("merge", help="merge the shards of one run")
    merge.add_argument("runs", nargs="+", help="run folders or globs")
    merge.add_argument("--out", required=True)
    merge.add_argument("--strict", action="store_true", help="all run settings must agree")
    return top


def question_set(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, str, str]:
    """Questions, the name of the task, and its prompt template."""
    if args.data:
        return qa.read(spark, args.data), "questions", text.PROMPT
    task = tasks.load(args.task)
    return tasks.loader(task.loader)(spark, *task.kwargs.values()), task.name, task.template


def evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    """Rows chosen in the order videos, limit, shard; their run folder is returned. A row that can't be scored is an error row of its own."""
    questions, name, template = question_set(spark, args)
    if args.only_videos:
        questions = relational.only(questions, "video_id", args.only_videos)
    questions = relational.limit(questions, "ord", args.limit)
    if args.shard:
        questions = relational.shard(questions, "ord", *args.shard)
    # A question without options, or with more than there are letters, fails alone.
    n = F.size("options")
    samples = questions.withColumn("__bad", F.when((n < 1) | (n > 26), F.concat(F.lit("ValueError: options: "), n.cast("string"))))
    good = samples.filter("__bad is null").withColumn("query", text.build_prompt(F.col("question"), F.col("options"), template))
    kept = ["ord", "video_id", "question_id", "gold"]
    pick = lambda x: x.withColumn("gold", F.col("answer"))
    done = pipeline.dry_run(pick(good).select("ord", "video_id", "question_id", "gold", F.col("ord").alias("sample"), "query"), args.method, args.setup, args.model, args.prune_kwargs or None, args.thinking)
    failed = pick(samples.filter("__bad is not null")).select(*kept, F.lit("").alias("prediction"), F.lit("error").alias("status"), F.col("__bad").alias("error"), *[F.lit(0).cast("double" if c in catalog.REAL_COSTS else "long").alias(c) for c in catalog.COSTS])
    rows = done.drop("sample", "query").unionByName(failed, allowMissingColumns=True)
    arm = F.to_json(F.struct(F.lit(args.method).alias("method"), F.lit(args.setup).alias("setup"), *[F.lit(x).alias(k) for k, x in zip(("selector", "pruner"), catalog.method(args.method), strict=True)]))
    meta = {"task": name, "method": args.method, "setup": args.setup, "model": args.model, "thinking": args.thinking, "prune_kwargs": args.prune_kwargs}
    if args.shard:
        meta["shard"] = {"index": args.shard[0], "n": args.shard[1]}
    return results.write(rows.withColumn("arm", arm), args.out, meta)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessel").getOrCreate()
    try:
        made = evaluate(spark, args) if args.command == "evaluate" else results.write_merged(spark, results.glob(spark, args.runs), args.out, args.strict)
    except (ValueError, FileNotFoundError, KeyError) as e:
        print(f"tessel: {e}", file=sys.stderr)
        return 2
    print(made)
    return 0


if __name__ == "__main__":
    sys.exit(main())
