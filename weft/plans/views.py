"""Inputs of the queries, made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.functions.text import MARKER_TARGET, hash_unit
from weft.operators import samples, splits
from weft.operators import stats as statistics


def trajectories(spark, root: str) -> DataFrame:
    return table(spark, root, "trajectories").select("uuid", "split", "messages")


def light(spark, root: str, outcomes: bool = True) -> DataFrame:
    """One small row per trajectory, for the statistics tables."""
    return statistics.trajectories(trajectories(spark, root), outcomes)


def stats(spark, root: str) -> DataFrame:
    return table(spark, root, "nemotron_uuid_same_tool_success_stats")


def split_manifest(spark, root: str) -> DataFrame:
    return splits.manifest(stats(spark, root).select("uuid", "split", "success_count", "failure_count", "unknown_count", "max_same_tool_success_count"))


def facts(spark, root: str) -> DataFrame:
    return samples.facts(trajectories(spark, root), split_manifest(spark, root).select("uuid", F.col("data_partition").alias("partition"), "source_subset"))


def call_predictions(spark, root: str) -> DataFrame:
    """(sample_id, level, target, prediction): a prediction table made from sft_samples by a rule on the hash of its key."""
    rows = table(spark, root, "sft_samples").where("sample_id is not null").groupBy("sample_id").agg(F.max("focal_tool_success_count_at_decision").alias("level"), F.max("target").alias("target"))
    u = hash_unit(F.lit("prediction"), "sample_id")
    wrong = F.when(u < 0.9, '<tool_call>{"name": "trigger_tool", "arguments": {"label": "A"}}</tool_call>').otherwise("the trigger_tool call")
    return rows.where("level is not null").withColumn("prediction", F.when(u < 0.6, F.col("target")).when(u < 0.8, F.lit(MARKER_TARGET)).otherwise(wrong))


def tool_rows(spark, root: str) -> DataFrame:
    """(id, query, tools, answers): tool-list rows made from sft_samples (the tool counted is called) and tool_catalog.

    A row has the first one to five tools of its tool's topic, by the code of its id's first character, and its own tool unless that is a multiple of three.
    """
    tool = F.to_json(F.struct(F.col("tool_name").alias("name"), F.coalesce("description", F.lit("")).alias("description")))
    catalog = table(spark, root, "tool_catalog")
    topics = catalog.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("tool_id", tool.alias("t"), "tool_name"))).alias("all"))
    focal = catalog.select(F.col("tool_name").alias("focal"), tool.alias("own"), "topic").join(topics, "topic")
    rows = table(spark, root, "sft_samples").where("sample_id is not null and focal_tool is not null").groupBy(F.col("sample_id").alias("id")).agg(F.max(folded("focal_tool")).alias("focal"))
    rows = rows.join(focal, "focal")
    n = F.ascii("id")
    first = F.transform(F.filter(F.slice("all", F.lit(1), n % 5 + 1), lambda x: x["tool_name"] != F.col("focal")), lambda x: x["t"])
    tools = F.when(n % 3 == 0, first).otherwise(F.concat(first, F.array("own")))
    return rows.select("id", F.concat(F.lit("use "), "focal").alias("query"), F.concat(F.lit("["), F.array_join(tools, ","), F.lit("]")).alias("tools"), F.concat(F.lit('[{"name":"'), "focal", F.lit('","arguments":{}}]')).alias("answers"))
