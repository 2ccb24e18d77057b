"""Per-trajectory statistics tables: calls, repeats, tool frequencies, same-tool successes.

``light`` is one small row per trajectory (``trajectories``): it is read and analysed in place, and only these rows are
hashed by uuid. Each table is then a chain of groupings whose keys begin with uuid, without a further shuffle or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import rowwise
from weft.operators.pairing import NO_NAME


def trajectories(raw: DataFrame, outcomes: bool = True) -> DataFrame:
    """(uuid, split, message_count, user_count, tool_output_count, calls, pairs, unpaired_calls, unpaired_outputs), once per readable uuid."""
    each = rowwise.analysed(raw, outcomes).where("not broken")
    users = F.size(F.filter("messages", lambda m: F.coalesce(m["role"] == "user", F.lit(False))))
    return rowwise.once(each.select("uuid", "split", F.size("messages").alias("message_count"), users.cast("bigint").alias("user_count"), F.col("outputs").alias("tool_output_count"), "calls", "pairs", "unpaired_calls", "unpaired_outputs"))


def pairs(light: DataFrame) -> DataFrame:
    return light.select("uuid", F.explode("pairs").alias("p")).select("uuid", "p.*")


def _flag(c: Column) -> Column:
    return c.cast("int")


def call_stats(light: DataFrame) -> DataFrame:
    """Messages, user messages, calls, outputs and complete pairs per uuid, with flags for three or more."""
    out = light.select("uuid", "split", F.col("message_count").cast("bigint").alias("message_count"), "user_count", F.size("calls").cast("bigint").alias("tool_call_count"), "tool_output_count", F.size("pairs").cast("bigint").alias("complete_pair_count"))
    return out.withColumns({"has_three_calls": _flag(F.col("tool_call_count") >= 3), "has_three_complete_pairs": _flag(F.col("complete_pair_count") >= 3)})


def counts_json(name: Column, n: Column) -> Column:
    """A JSON object of counts, names in order, from grouped rows; ``{}`` without rows."""
    entries = F.array_sort(F.collect_list(F.when(name.isNotNull() & (n > 0), F.struct(name.alias("name"), n.alias("n")))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["name"])).substr(F.lit(2), F.length(F.to_json(F.array(e["name"]))) - 2), F.lit(": "), e["n"].cast("string"))), ", "), F.lit("}"))


def repeat_stats(light: DataFrame) -> DataFrame:
    """How often tools are called again: most called tools joined by ``|`` in name order, and all counts as JSON."""
    called = light.select("uuid", "split", "message_count", F.explode_outer("calls").alias("c"))
    named = called.groupBy("uuid", "split", "message_count", F.col("c.tool_name").alias("tool_name")).agg(F.count("c").alias("n"))
    parsed = F.coalesce(F.col("tool_name") != NO_NAME, F.lit(False))
    named = named.withColumn("top", F.max(F.when(parsed, F.col("n"))).over(Window.partitionBy("uuid")))
    by = named.groupBy("uuid", "split", "message_count").agg(
        F.sum("n").alias("total_tool_calls"), F.coalesce(F.sum(F.when(parsed, F.col("n"))), F.lit(0)).alias("parsed_tool_calls"), F.count_if(parsed).alias("unique_tool_count"),
        F.coalesce(F.max("top"), F.lit(0)).alias("max_same_tool_calls"), F.count_if(parsed & (F.col("n") > 1)).alias("repeated_tool_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(parsed & (F.col("n") == F.col("top")), F.col("tool_name")))), "|").alias("most_called_tools"),
        counts_json(F.when(parsed, F.col("tool_name")), F.col("n")).alias("tool_counts_json"),
    )
    out = by.withColumn("has_repeated_tool", _flag(F.col("repeated_tool_count") > 0)).withColumn("all_calls_same_tool", _flag((F.col("unique_tool_count") == 1) & (F.col("parsed_tool_calls") > 1)))
    return out.select("uuid", "split", "message_count", "total_tool_calls", "parsed_tool_calls", "unique_tool_count", "max_same_tool_calls", "repeated_tool_count", "has_repeated_tool", "all_calls_same_tool", "most_called_tools", "tool_counts_json")


def tool_frequency(light: DataFrame) -> DataFrame:
    """(uuid, split, total_tool_calls, unique_tool_count, tool_name, tool_call_count, tool_call_ratio) of parsed calls."""
    called = light.select("uuid", "split", F.explode("calls").alias("c")).where(F.col("c.tool_name") != NO_NAME)
    named = called.groupBy("uuid", "split", F.col("c.tool_name").alias("tool_name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("uuid")
    out = named.withColumn("total_tool_calls", F.sum("n").over(w)).withColumn("unique_tool_count", F.count("*").over(w))
    return out.select("uuid", "split", "total_tool_calls", "unique_tool_count", "tool_name", F.col("n").alias("tool_call_count"), F.round(F.col("n") / F.col("total_tool_calls"), 6).alias("tool_call_ratio"))


def occurrences(found: DataFrame) -> DataFrame:
    """Successful pairs with their number among the successes of their tool."""
    w = Window.partitionBy("uuid", "tool_name").orderBy("output_index")
    return found.where("result = 'success'").withColumn("occurrence", F.row_number().over(w))


def focal_tools(found: DataFrame) -> DataFrame:
    """(uuid, focal_tool, focal_count, focal_outputs): most successes, then the earliest, then the name."""
    by = found.where("result = 'success'").groupBy("uuid", "tool_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("output_index")).alias("outputs"))
    best = by.groupBy("uuid").agg(F.min(F.struct((-F.col("n")).alias("key"), F.element_at("outputs", 1).alias("first"), "tool_name", "outputs")).alias("b"))
    return best.select("uuid", F.col("b.tool_name").alias("focal_tool"), (-F.col("b.key")).alias("focal_count"), F.col("b.outputs").alias("focal_outputs"))


def success_stats(light: DataFrame) -> DataFrame:
    """Outcomes per uuid: pairs by result, successes per tool, tools at and beyond three, unpaired messages, three count maps."""
    keys = ["uuid", "split", "total_tool_calls", "unpaired_calls", "unpaired_outputs"]
    each = light.select("uuid", "split", F.size("calls").cast("bigint").alias("total_tool_calls"), "unpaired_calls", "unpaired_outputs", F.explode_outer("pairs").alias("p"))
    by_tool = each.groupBy(*keys, F.col("p.tool_name").alias("tool_name")).agg(*(F.count_if(F.coalesce(F.col("p.result") == r, F.lit(False))).alias(r) for r in ("success", "failure", "unknown")))
    listed = lambda bound: F.array_join(F.array_sort(F.collect_list(F.when(F.col("success") > bound, F.col("tool_name")))), "|")
    by = by_tool.groupBy(*keys).agg(
        *(F.sum(r).alias(f"{r}_count") for r in ("success", "failure", "unknown")),
        F.count_if(F.col("success") > 0).alias("unique_success_tool_count"), F.max("success").alias("most"), listed(2).alias("trigger_tools_ge_3"), listed(3).alias("trigger_tools_gt_3"),
        *(counts_json(F.col("tool_name"), F.col(r)).alias(f"tool_{r}_counts_json") for r in ("success", "failure", "unknown")),
    )
    return by.select(
        "uuid", "split", "total_tool_calls", (F.col("success_count") + F.col("failure_count") + F.col("unknown_count")).alias("complete_pair_count"), "success_count", "failure_count", "unknown_count",
        "unique_success_tool_count", F.col("most").alias("max_same_tool_success_count"), "trigger_tools_ge_3", "trigger_tools_gt_3", _flag(F.col("most") >= 3).alias("same_tool_success_ge_3"), _flag(F.col("most") > 3).alias("same_tool_success_gt_3"),
        F.col("unpaired_calls").alias("unpaired_call_count"), F.col("unpaired_outputs").alias("unpaired_output_count"), "tool_success_counts_json", "tool_failure_counts_json", "tool_unknown_counts_json",
    )
