"""Labelled samples out of trajectories: training samples, controlled prefixes, rejects.

A trajectory is one row. Its pairs, decisions and the counts that the sample rules ask for are made within the row, the
row is hashed by uuid once, meets its manifest row there, and emits its samples.

Defined results: without a manifest row, with an unknown partition, with broken JSON, with an unpaired message or a call
without a readable name a trajectory is rejected, for the first of these reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import MARKER_SCHEMA, MARKER_TARGET
from weft.operators import rowwise
from weft.operators.pairing import NO_NAME
from weft.operators.rowwise import joined

PARTITIONS = ("train", "validation", "test_iid", "test_ood")
TYPES = ("positive", "boundary", "near_miss_failure", "near_miss_different_tools", "clean", "controlled_prefix")
RULE = "same_tool_success_count_ge_{}"


def with_marker_schema(messages: Column) -> Column:
    """The marker's schema appended to the first system message unless it is there; a system message is put first if there is none."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))), F.lit("system"))
    declared = '"name": "trigger_tool"'

    def changed(m: Column, i: Column) -> Column:
        text = F.coalesce(m["content"], F.lit(""))
        new = F.when(F.contains(text, F.lit(declared)), text).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit(MARKER_SCHEMA)))
        return F.struct(m["role"].alias("role"), F.when(i + 1 == at, new).otherwise(m["content"]).alias("content"))

    plain = F.transform(messages, changed)
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(MARKER_SCHEMA.strip()).alias("content")))
    return F.when(at > 0, plain).otherwise(F.concat(first, plain))


def _counted(rows: DataFrame) -> DataFrame:
    """Counts over the pairs of a row: per tool, the focal tool with its outputs, and totals."""
    pair, has = F.col("pairs"), lambda r: lambda p: p["result"] == r
    names = F.array_distinct(F.transform(pair, lambda p: p["tool_name"]))

    def of(name: Column) -> Column:
        own = F.filter(pair, lambda p: p["tool_name"] == name)
        outputs = F.transform(F.filter(own, has("success")), lambda p: p["output_index"])
        return F.struct((-F.size(outputs)).alias("key"), F.coalesce(F.array_min(outputs), F.lit(0)).alias("first"), name.alias("tool_name"), F.size(own).alias("calls"), F.array_sort(outputs).alias("outputs"))

    rows = rows.withColumn("tools", F.transform(names, of))
    succeeded = F.filter("tools", lambda t: t["key"] < 0)
    rows = rows.withColumn("focal", F.array_min(succeeded))
    total = lambda r: F.size(F.filter(pair, has(r)))
    return rows.select(
        "uuid", "messages", "broken", "decisions", "unpaired_calls", "unpaired_outputs", F.size(pair).alias("full_tool_call_count"), *(total(r).alias(f"full_{r}_count") for r in ("success", "failure", "unknown")),
        F.coalesce(F.array_max(F.transform("tools", lambda t: t["calls"])), F.lit(0)).alias("most_calls"), F.exists(pair, lambda p: p["tool_name"] == NO_NAME).alias("nameless"),
        F.map_from_entries(F.array_sort(F.transform(succeeded, lambda t: F.struct(t["tool_name"].alias("k"), (-t["key"]).cast("bigint").alias("v"))))).alias("full_tool_success_counts"),
        F.col("focal.tool_name").alias("focal_tool"), F.coalesce(-F.col("focal.key"), F.lit(0)).alias("focal_count"), F.col("focal.outputs").alias("focal_outputs"),
    )


def facts(trajectories: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per trajectory with all that the sample rules ask for, and ``reject_reason``; ``manifest(uuid, partition, source_subset)``."""
    rows = _counted(rowwise.analysed(trajectories))
    # what a row is rejected for by itself is known before it is shuffled: only flags of such rows are moved, not their messages
    sound = ~F.col("broken") & (F.coalesce(F.col("unpaired_calls") + F.col("unpaired_outputs"), F.lit(0)) == 0) & ~F.coalesce(F.col("nameless"), F.lit(False))
    rows = rowwise.once(rows.withColumns({c: F.when(sound, F.col(c)) for c in ("messages", "decisions", "focal_outputs", "full_tool_success_counts")}))
    parts = manifest.where("uuid is not null").groupBy("uuid").agg(F.min("partition").alias("partition"), F.min("source_subset").alias("source_subset"), F.lit(True).alias("known"))
    out = rows.join(parts, "uuid", "left")
    reason = (
        F.when(F.col("known").isNull(), "uuid_missing_from_manifest")
        .when(~F.coalesce(F.col("partition").isin(*PARTITIONS), F.lit(False)), "bad_partition")
        .when(F.col("broken"), "message_parse_error")
        .when(F.coalesce(F.col("unpaired_calls") + F.col("unpaired_outputs"), F.lit(0)) > 0, "unpaired_trajectory")
        .when(F.col("nameless"), "tool_name_parse_error")
    )
    return out.withColumn("reject_reason", reason)


def _next(after: Column) -> Column:
    """The first decision that starts after an index, or null."""
    return F.get(F.filter("decisions", lambda d: d["start"] > after), F.lit(0))


def _sample(kind: Column | str, level: Column, end: Column, decision: Column | None, position: Column) -> Column:
    """What to emit: the first ``end`` messages, and as target the decision, or the marker if there is none."""
    first, last = (decision["start"], decision["end"]) if decision is not None else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("sample_type"), level.cast("int").alias("level"), end.cast("int").alias("end"), first.alias("first"), last.alias("last"), position.cast("int").alias("position"))


def emitted(threshold: int = 3) -> Column:
    """The samples of one trajectory as an array, by its partition; entries may be null."""
    focal = F.col("focal_count")
    output = lambda n: F.get("focal_outputs", n - 1)
    none = F.lit(None).cast("int")
    after = _next(output(F.lit(threshold - 1)))
    reached = F.array(
        _sample("positive", F.lit(threshold), output(F.lit(threshold)) + 1, None, output(F.lit(threshold))),
        F.when(after.isNotNull(), _sample("boundary", F.lit(threshold - 1), after["start"], after, none)),
    )
    last = F.try_element_at("decisions", F.lit(-1))
    kind = F.when(F.col("most_calls") >= threshold, "near_miss_failure").when(F.col("full_success_count") >= threshold, "near_miss_different_tools").when(focal == threshold - 1, "boundary").otherwise("clean")
    below = F.array(F.when(last.isNotNull(), _sample(kind, focal, last["start"], last, none)))
    training = F.when(focal >= threshold, reached).otherwise(below)

    first = F.get("decisions", F.lit(0))
    zero = F.array(F.when(first.isNotNull(), _sample("controlled_prefix", F.lit(0), first["start"], first, none)))

    def at(level: Column) -> Column:
        following = _next(output(level))
        return F.when(level >= threshold, _sample("controlled_prefix", level, output(level) + 1, None, output(level))).when(following.isNotNull(), _sample("controlled_prefix", level, output(level) + 1, following, none))

    levels = F.when(focal > 0, F.transform(F.sequence(F.lit(1), F.least(focal, F.lit(threshold + 1))), at)).otherwise(F.array())
    return F.when(F.col("partition").startswith("test_"), F.concat(zero, levels)).otherwise(training)


def build(fact: DataFrame, threshold: int = 3) -> DataFrame:
    """All samples of the trajectories that are not rejected, with their 18 fields."""
    rows = fact.where("reject_reason is null").withColumn("s", F.explode(F.filter(emitted(threshold), lambda s: s.isNotNull())))
    cut = F.slice("messages", F.lit(1), F.col("s.end"))
    marked = F.col("s.first").isNull()
    return rows.select(
        F.concat_ws("__", "uuid", "s.sample_type", F.concat(F.lit("c"), F.col("s.level").cast("string"))).alias("sample_id"), F.col("uuid").alias("source_uuid"), "source_subset", "partition", F.col("s.sample_type").alias("sample_type"),
        F.lit(RULE.format(threshold)).alias("trigger_type"), F.lit(threshold).alias("threshold"), marked.alias("expected_trigger"), "focal_tool",
        F.col("s.level").alias("focal_tool_success_count_at_decision"), F.col("s.position").alias("trigger_position"),
        "full_tool_call_count", "full_success_count", "full_failure_count", "full_unknown_count", "full_tool_success_counts",
        with_marker_schema(cut).alias("messages"), F.when(marked, MARKER_TARGET).otherwise(joined(F.col("messages"), F.col("s.first"), F.col("s.last"))).alias("target"),
    )


def matrix(samples: DataFrame) -> DataFrame:
    """Samples per partition and type, with a row for every combination of the known ones."""
    spark = samples.sparkSession
    frame = spark.createDataFrame([(p, t) for p in PARTITIONS for t in TYPES], "partition string, sample_type string")
    counts = samples.groupBy("partition", "sample_type").agg(F.count("*").alias("n"))
    return frame.join(counts, ["partition", "sample_type"], "left").na.fill(0)


def sharegpt(samples: DataFrame) -> DataFrame:
    """(sample_id, conversations): the serialized prompt and the target; samples without messages or target are dropped."""
    from weft.operators.messages import serialize_array

    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return samples.where("messages is not null and target is not null").select("sample_id", F.array(turn("human", serialize_array("messages")), turn("gpt", F.col("target"))).alias("conversations"))
