"""Tool calls with their outputs, first in, first out, without a queue.

With running counts of calls and outputs, an output is unpaired exactly when the running maximum of (outputs - calls)
rises above its former value; the k-th other output belongs to the k-th call. One pass of windows over one
partitioning by uuid, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.outcome import classify_output
from weft.functions.text import tool_name

NO_NAME = "__PARSE_ERROR__"


def ranked(rows: DataFrame) -> DataFrame:
    """(uuid, idx, is_call, tool_name, result, nc, no, un, rank): calls and outputs; rank null for unpaired outputs.

    Outputs are classified before anything moves, so that contents are not carried along.
    """
    call = F.col("role") == "tool_call"
    kept = rows.where(F.col("role").isin("tool_call", "tool_output")).select(
        "uuid", "idx", call.alias("is_call"),
        F.when(call, F.coalesce(tool_name("content", "name"), F.lit(NO_NAME))).alias("tool_name"),
        classify_output(F.when(~call, F.col("content"))).alias("verdict"),
    )
    kept = kept.withColumn("result", F.when(~F.col("is_call"), F.col("verdict"))).drop("verdict")
    w = Window.partitionBy("uuid").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = kept.withColumn("nc", F.sum(F.col("is_call").cast("int")).over(upto)).withColumn("no", F.sum((~F.col("is_call")).cast("int")).over(upto))
    counted = counted.withColumn("un", F.greatest(F.lit(0), F.max(F.col("no") - F.col("nc")).over(upto)))
    lost = ~F.col("is_call") & (F.col("un") > F.lag("un", 1, 0).over(w))
    return counted.withColumn("rank", F.when(F.col("is_call"), F.col("nc")).when(~lost, F.col("no") - F.col("un")))


def events(rank: DataFrame) -> DataFrame:
    """(uuid, k, tool_name, call_index, output_index, result) of each pair, k from 1."""
    call = F.col("is_call")
    pairs = rank.where("rank is not null").groupBy("uuid", "rank").agg(
        F.max(F.when(call, F.col("tool_name"))).alias("tool_name"), F.max(F.when(call, F.col("idx"))).alias("call_index"),
        F.max(F.when(~call, F.col("idx"))).alias("output_index"), F.max("result").alias("result"),
    )
    return pairs.where("call_index is not null and output_index is not null").withColumnRenamed("rank", "k")


def unpaired(rank: DataFrame) -> DataFrame:
    """(uuid, calls, outputs, unpaired_calls, unpaired_outputs)."""
    by = rank.groupBy("uuid").agg(F.max("nc").alias("calls"), F.max("no").alias("outputs"), F.max("un").alias("unpaired_outputs"))
    return by.select("uuid", "calls", "outputs", (F.col("calls") - F.col("outputs") + F.col("unpaired_outputs")).alias("unpaired_calls"), "unpaired_outputs")
