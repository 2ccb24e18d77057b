"""Queries of operators that the first set does not reach: row numbers, scalars, token arrays, registry rows, sources and sinks."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.common import folded, one_per_key, plain_uuid, table
from weft.functions import text, tokens
from weft.functions.outcome import config_hash
from weft.operators import evaluate, messages, ranking, registry, samples, splits, toolsets
from weft.plans import views
from weft.session import ensure_checkpoint_dir
from weft.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, for what is written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def _samples(spark, root, *columns):
    return one_per_key(table(spark, root, "sft_samples").where("sample_id is not null").select("sample_id", *columns), "sample_id")


# row numbers


@_query
def numbered_rows(spark, root):
    """Every line item with its number in the order of its key."""
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ranking.with_row_index(rows, "l_orderkey", "l_linenumber", "l_partkey")


@_query
def batch_sizes(spark, root):
    """Batches of 1,000 line items in the order of their key: rows and first and last order of each."""
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ranking.batches(rows, 1000, "l_orderkey", "l_linenumber", "l_partkey").groupBy("batch").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


@_query
def sequential_tool_rows(spark, root):
    made = toolsets.expand(views.tool_rows(spark, root), [2, 4], variants=1, policy="all")
    return toolsets.sequential_ids(made, 100).select("id", "source_id", "tool_count", "variant")


# scalars


@_query
def config_hashes(spark, root):
    """The hash of a config made of a job's columns."""
    rows = registry.current(table(spark, root, "job"))
    return rows.select("id", config_hash(F.to_json(F.struct(F.col("stage").alias("stage"), F.col("run_id").alias("run"), F.col("id").alias("id")), {"ignoreNullFields": "false"})).alias("hash"))


@_query
def answer_scalars(spark, root):
    """Lenient parse, marker first, first tool and compact text of the answers of tool lists; every seventh answer is broken off."""
    rows = views.tool_rows(spark, root).select("id", F.when(F.ascii(F.substring("id", -1, 1)) % 7 == 0, F.expr("left(answers, length(answers) - 2)")).when(F.ascii(F.substring("id", -1, 1)) % 7 == 1, F.lit('[ {"name": "trigger_tool", "arguments": null} ]')).otherwise(F.col("answers")).alias("a"))
    parsed = text.parse_lenient("a")
    return rows.select("id", parsed.isNotNull().alias("readable"), text.is_marker_answer("a").alias("is_marker"), text.first_tool("a").alias("tool"), text.compact_json("a").alias("compact"), text.strip_code_fence(F.concat(F.lit("```json\n"), "a", F.lit("\n```"))).alias("unfenced"))


@_query
def tool_prompts(spark, root):
    """The chat prompt of each tool list, role by role."""
    turns = toolsets.prompt("Answer with calls.", answers="answers")
    return views.tool_rows(spark, root).select("id", F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit("="), F.md5(m["content"]))), ",").alias("turns"))


@_query
def chat_templates(spark, root):
    """The chat template over a question and its answer, of each document."""
    chat = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("topic", F.lit("")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce("source", F.lit("")).alias("content"))))
    return table(spark, root, "documents").select("doc_id", F.md5(tokens.chat_template(chat)).alias("chat_md5"))


@_query
def training_arrays(spark, root):
    """Word tokens of prompt and target, labels, padding, attention, truncation and the prefix rule of each sample."""
    rows = _samples(spark, root, "focal_tool", "target").select("sample_id", tokens.words(F.col("focal_tool")).alias("p"), tokens.words(F.col("target")).alias("t"))
    end = F.array(F.lit("<end>"))
    rows = rows.withColumn("cut", tokens.truncated_target(F.col("t"), end, 12)).withColumn("whole", F.concat("p", "cut"))
    sizes = rows.select("sample_id", "whole", "p", F.transform("p", lambda _: F.lit(1)).alias("pn"), F.transform("cut", lambda _: F.lit(7)).alias("cn"), "cut")
    shown = lambda c: F.array_join(c.cast("array<string>"), " ")
    return sizes.select("sample_id", shown(F.col("cut")).alias("target"), shown(tokens.labels(F.col("pn"), F.col("cn"))).alias("labels"), shown(tokens.padded(F.col("cn"), 16, 0)).alias("right_padded"), shown(tokens.padded(F.col("cn"), 16, 0, left=True)).alias("left_padded"),
                        shown(tokens.attention(F.col("cn"), 16, left=True)).alias("attention"), tokens.starts_with(F.col("whole"), F.col("p")).alias("has_prefix"))


# joins, unions, checks


@_query
def unprocessed_uuids(spark, root):
    """Manifest keys that gave no sample: those without a trajectory and the rejected ones."""
    fact = views.facts(spark, root)
    return splits.unprocessed(views.split_manifest(spark, root), fact.where("reject_reason is null").select("uuid"))


@_query
def predictions_with_gold(spark, root):
    """Scored predictions joined with their gold rows by key."""
    gold = _samples(spark, root, "sample_type").select("sample_id", folded("sample_type").alias("sample_type"))
    return evaluate.with_gold(evaluate.score_calls(views.call_predictions(spark, root)), gold, "sample_id").select("sample_id", "sample_type", "level", "strict", "exact")


@_query
def union_of_parts(spark, root):
    """The partitions of the manifest put together again under their checks."""
    parts = views.split_manifest(spark, root).select("uuid", "data_partition")
    each = [parts.where(F.col("data_partition") == p) for p in samples.PARTITIONS]
    return splits.combined(*each).groupBy("data_partition").agg(F.count("*").alias("n"), F.min("uuid").alias("first"), F.max("uuid").alias("last"))


@_query
def sampled_levels(spark, root):
    rows = views.call_predictions(spark, root).select("sample_id", "level").where("level <= 3")
    return evaluate.sample_per_level(rows, [0, 1, 2, 3], "sample_id", 15).select("sample_id", "level", "rank")


@_query
def shared_uuids(spark, root):
    """Samples whose source has a row of statistics."""
    rows = _samples(spark, root, "source_uuid").select("sample_id", plain_uuid("source_uuid").alias("uuid"))
    return registry.exists(rows, table(spark, root, "nemotron_uuid_same_tool_success_stats").select(plain_uuid("uuid").alias("id")), "uuid").select("sample_id", "uuid")


# registry

def _now():
    return F.lit("2031-03-01 00:00:00").cast("timestamp")


def _jobs(spark, root):
    return registry.current(table(spark, root, "job"))


@_query
def jobs_of_one_run(spark, root):
    rows = _jobs(spark, root)
    return registry.jobs_of_run(rows, 3).select("id", "run_id", "stage")


@_query
def one_node(spark, root):
    return registry.get(table(spark, root, "node"), 5).select("id", "name", "hostname")


@_query
def nodes_without_gone(spark, root):
    nodes = table(spark, root, "node").select("id", "name")
    return registry.without(nodes, nodes.where("id % 5 = 0").select("id"))


@_query
def overwritten_nodes(spark, root):
    """A change in which a null overwrites."""
    nodes = table(spark, root, "node").select("id", "name", "gpu_info", "ssh_user")
    return registry.patched(nodes, nodes.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "1x80G").alias("gpu_info")), null_keeps=False)


@_query
def heartbeats(spark, root):
    return registry.heartbeat(table(spark, root, "node"), 4, _now()).select("id", "status", F.date_format("last_heartbeat_at", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat_at"))


@_query
def cancelled_jobs(spark, root):
    """What is appended when the first ten jobs are cancelled: those that have not ended."""
    rows = _jobs(spark, root)
    return functools.reduce(DataFrame.unionByName, (registry.cancelled(rows, i, _now()) for i in range(1, 11))).select("id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@_query
def created_nodes(spark, root):
    """New rows of a registry table: ids go on, columns that were not given are null or a default."""
    new = spark.createDataFrame([("zeta", "z.host"), ("alpha", "a.host")], "name string, hostname string")
    return registry.created(table(spark, root, "node"), new, _now(), status="alive", ssh_port=22).select("id", "name", "hostname", "ssh_user", "ssh_port", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@_query
def created_runs(spark, root):
    """Run rows with their config's hash, made of the stages of the jobs."""
    stages = _jobs(spark, root).where("stage is not null").select(folded("stage").alias("name")).distinct()
    new = stages.select("name", F.to_json(F.struct(F.col("name").alias("stage"), F.lit(1).alias("a"))).alias("config_json"))
    log = spark.createDataFrame([], "id long, name string, status string, config_json string, created_at timestamp")
    return registry.new_runs(log, new, _now()).select("id", "name", "status", "config_hash")


@_query
def queued_jobs(spark, root):
    """The jobs that a new run of two stages appends, for each node."""
    runs = table(spark, root, "node").select("id", F.concat(F.lit("/runs/"), F.col("id").cast("string")).alias("workdir"), F.col("id").alias("node_id"))
    entry = lambda stage, node: F.struct(F.lit(stage).alias("stage"), F.lit(f"run {stage}").alias("command"), F.lit(None).cast("string").alias("workdir"), node.cast("bigint").alias("node_id"))
    return registry.new_jobs(runs, F.array(entry("train", F.lit(None)), entry("eval", F.lit(2))), _now()).select("run_id", "position", "stage", "command", "workdir", "status", "node_id")


@_query
def last_checkpoints(spark, root):
    names = _jobs(spark, root).select(F.concat(F.lit("checkpoint-"), F.col("id").cast("string")).alias("name"))
    return registry.latest_checkpoint(names.unionByName(spark.createDataFrame([("checkpoint-x",), ("other-9999",)], "name string")))


# sources and sinks: written, read back


@_query
def json_lines_read_back(spark, root):
    at = f"{_folder(spark)}/rows"
    rows = _samples(spark, root, "sample_type", "target")
    sinks.jsonl(rows, at)
    return readers.jsonl(spark, at, rows.schema).select("sample_id", "sample_type", F.md5("target").alias("target_md5"))


@_query
def lenient_rows_read_back(spark, root):
    """JSON lines of which some lack a required field, read leniently."""
    at = f"{_folder(spark)}/rows"
    sinks.jsonl(_samples(spark, root, "sample_type", "target"), at, keep_nulls=False)
    valid, rejected = readers.lenient(spark, at, "sample_id string, sample_type string, target string", ["sample_type", "target"], "sample_id")
    return valid.select("sample_id", F.lit(True).alias("valid")).unionByName(rejected.select("sample_id", F.lit(False).alias("valid")))


@_query
def numbered_lines_read_back(spark, root):
    """The lines of a file numbered where they stand, in several parts of one file."""
    at = f"{_folder(spark)}/rows"
    rows = table(spark, root, "orders").select("o_orderkey").orderBy("o_orderkey")
    rows.coalesce(1).sortWithinPartitions("o_orderkey").write.json(at)
    return readers.numbered(spark, at).select("record_no", F.get_json_object("record", "$.o_orderkey").cast("long").alias("o_orderkey"))


@_query
def fan_out_read_back(spark, root):
    at = f"{_folder(spark)}/rows"
    rows = _samples(spark, root, "partition", "sample_type").select("sample_id", F.coalesce(folded("partition"), F.lit("none")).alias("partition"), F.coalesce(folded("sample_type"), F.lit("none")).alias("sample_type"))
    sinks.samples(rows, at, samples.PARTITIONS, samples.TYPES)
    return spark.read.schema("sample_id string, partition string, sample_type string, part string, type string").json(at).groupBy("part", "type").agg(F.count("*").alias("n"), F.count_if(F.col("part") == F.col("partition")).alias("same_part"))


@_query
def manifest_read_back(spark, root):
    """A split manifest as sorted CSV files, read as one."""
    at = f"{_folder(spark)}/manifest"
    sinks.csv(views.split_manifest(spark, root).select("uuid", "split", "data_partition"), at, "data_partition", "uuid")
    return readers.manifest(spark, at)


@_query
def partition_files_read_back(spark, root):
    at = f"{_folder(spark)}/parts"
    sinks.partition_csvs(views.split_manifest(spark, root).select("uuid", "data_partition", "success_count"), at)
    return readers.csv(spark, at).groupBy("data_partition").agg(F.count("*").alias("n"), F.sum(F.col("success_count").cast("long")).alias("successes"))


@_query
def metrics_read_back(spark, root):
    at = f"{_folder(spark)}/run"
    scored = evaluate.score_calls(views.call_predictions(spark, root))
    metrics = evaluate.overall_metrics(scored)
    sinks.predictions(scored, metrics, at)
    sinks.summary(spark, f"{at}/train_results.json", {"loss": 1})
    rows = spark.read.json(f"{at}/metrics.json")
    return rows.select("total_samples", "overall_ftr", "overall_asr", F.lit(spark.read.json(f"{at}/predictions.jsonl").count()).alias("n_predictions"))


@_query
def neighbour_contents(spark, root):
    """Messages per role with how many follow and are followed by a message of the same role."""
    rows = messages.message_rows(messages.parsed(views.trajectories(spark, root))).select("uuid", "idx", "role")
    found = messages.neighbours(rows)
    return found.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("previous_role") == F.col("role")).alias("after_same"), F.count_if(F.col("next_role") == F.col("role")).alias("before_same"))


def queries() -> dict[str, Query]:
    return dict(_ALL)
