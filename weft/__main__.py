"""Command line: ``python -m weft <command> --help``. Paths may be on any file system that Spark reads."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from weft.functions.text import parse_counts
from weft.operators import evaluate, samples, splits, stats, toolsets
from weft.session import session
from weft.sources import readers, sinks

#: Fixed value: the system prompt of tool-list rows.
SYSTEM = """You are a function-calling assistant.
Available tools are provided as a JSON array.
Return only the correct JSON array of tool calls.
Do not output explanations, Markdown, or any text outside the JSON array.
/no_think"""
TOOL_ROWS = "id string, query string, answers string, tools string"
PREDICTED = "id string, tool_count int, answers string, prediction string"
CALLED = "sample_id string, level int, target string, prediction string"


def _stats(spark, a) -> None:
    light = stats.trajectories(readers.trajectories(spark, a.trajectories))
    for name, made in (("call_stats", stats.call_stats), ("repeat_stats", stats.repeat_stats), ("tool_frequency", stats.tool_frequency), ("success_stats", stats.success_stats)):
        sinks.csv(made(light), f"{a.out}/{name}", "uuid")


def _split(spark, a) -> None:
    rows = readers.csv(spark, a.stats)
    counts = ["success_count", "failure_count", "unknown_count", "max_same_tool_success_count"]
    rows = readers.require(rows, "uuid", "split", *counts).withColumns({c: F.col(c).cast("int") for c in counts})
    splits.check_input(rows)
    parts = splits.manifest(rows, tuple(a.ratios), a.seed)
    sinks.partition_csvs(parts, f"{a.out}/partitions")
    sinks.csv(parts, f"{a.out}/all", "data_partition", "uuid")
    summary = splits.summary(parts)
    sinks.summary(spark, f"{a.out}/summary", {r.data_partition: r.asDict() for r in summary.collect()})  # one row per partition


def _build(spark, a) -> None:
    wanted = readers.manifest(spark, a.manifest)
    fact = samples.facts(readers.trajectories(spark, a.trajectories), wanted)
    sinks.samples(samples.build(fact, a.threshold), f"{a.out}/samples", samples.PARTITIONS, samples.TYPES)
    written = spark.read.schema("partition string, sample_type string").json(f"{a.out}/samples")
    reasons = fact.groupBy("reject_reason").count().collect()  # one row per reason
    lost = splits.unprocessed(wanted, fact.where("reject_reason is null").select("uuid")).count()
    counts = {"manifest_uuids": wanted.count(), "processed_uuids": sum(r[1] for r in reasons if r[0] is None), "missing_uuids": lost}
    sinks.summary(spark, f"{a.out}/summary", {"samples": sinks.table_summary(samples.matrix(written), ["partition", "sample_type"], "n"), "rejected": {r[0]: r[1] for r in reasons if r[0]}, **counts})
    if a.strict and lost:
        raise SystemExit(f"{lost} keys of the manifest were not processed; see {a.out}/summary")


def _tool_lists(spark, a) -> None:
    valid, _ = readers.lenient(spark, a.rows, TOOL_ROWS, ["id", "query", "answers", "tools"], "id", a.max_rows)
    made = toolsets.expand(readers.non_empty(valid, a.rows), a.counts, a.variants, a.threshold, a.policy, a.seed, a.arguments)
    written = toolsets.sequential_ids(made, a.start_id) if a.start_id is not None else made.where("outcome = 'written'")
    sinks.jsonl_required(written.drop("outcome", "chosen"), f"{a.out}/rows")
    sinks.summary(spark, f"{a.out}/summary", sinks.table_summary(toolsets.generation_stats(made), ["outcome"], "n"))


def _sharegpt(spark, a) -> None:
    if a.kind == "calls":
        made = samples.sharegpt(spark.read.json(a.rows))
    else:
        made = toolsets.sharegpt(readers.json_any(spark, a.rows, TOOL_ROWS), a.system)
    sinks.jsonl_required(made.select("conversations"), f"{a.out}/{a.name}")
    spark.createDataFrame([(sinks.dataset_info(a.name, a.name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/dataset_info")


def _evaluate(spark, a) -> None:
    rows = spark.read.schema(CALLED if a.kind == "calls" else PREDICTED).json(a.predictions)
    scored = evaluate.score_calls(rows) if a.kind == "calls" else evaluate.score_arrays(rows)
    sinks.predictions(scored, evaluate.level_metrics(scored) if a.kind == "calls" else evaluate.confusion(scored), a.out)
    if a.kind == "calls":
        print(json.dumps(evaluate.overall_metrics(scored).first().asDict()))


def positive(text: str) -> int:
    """A whole number of at least 1, as an option."""
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weft", description=__doc__)
    top.add_argument("--master", help="Spark master; unset on a cluster")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str, *paths: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        for p in (*paths, "out"):
            c.add_argument(f"--{p}", required=True)
        c.set_defaults(run=run)
        return c

    command("stats", _stats, "statistics tables of trajectories", "trajectories")
    c = command("split", _split, "leak-free partitions of a statistics table", "stats")
    c.add_argument("--ratios", type=float, nargs=3, default=[0.8, 0.1, 0.1])
    c.add_argument("--seed", type=int, default=42)
    c = command("build", _build, "labelled samples of trajectories and a manifest", "trajectories", "manifest")
    c.add_argument("--threshold", type=positive, default=3)
    c.add_argument("--strict", action="store_true", help="fail, after all is written, if a key of the manifest gave no sample")
    c = command("tool-lists", _tool_lists, "rows with chosen numbers of tools", "rows")
    c.add_argument("--counts", type=parse_counts, default="1,2,3,4,5,6,7,8")
    c.add_argument("--variants", type=positive, default=1)
    c.add_argument("--threshold", type=int, default=3)
    c.add_argument("--policy", choices=["all", "triggered-only", "absent"], default="all")
    c.add_argument("--arguments", choices=["null", "string"], default="null")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--start-id", type=int)
    c.add_argument("--max-rows", type=positive)
    c = command("sharegpt", _sharegpt, "conversations for training", "rows", "name")
    c.add_argument("--kind", choices=["calls", "arrays"], default="calls")
    c.add_argument("--system", default=SYSTEM)
    c = command("evaluate", _evaluate, "metrics of a table of predictions", "predictions")
    c.add_argument("--kind", choices=["calls", "arrays"], default="calls")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(master=a.master), a)


if __name__ == "__main__":
    main()
