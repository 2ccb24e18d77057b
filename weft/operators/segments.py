"""Decisions: reasoning messages followed by a tool call or an answer, and lookups among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decisions(rows: DataFrame) -> DataFrame:
    """(uuid, start, end, target): every call or answer, with the unbroken run of reasoning right before it.

    Each reasoning message looks ahead to the first message that is none; the run belongs to it if that decides.
    """
    ahead = Window.partitionBy("uuid").orderBy("idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reasoning = F.coalesce(F.col("role") == "reasoning", F.lit(False))
    decides = F.col("role").isin("tool_call", "answer")
    marked = rows.withColumn("end", F.first(F.when(~reasoning, F.struct(F.col("idx").alias("at"), F.coalesce(decides, F.lit(False)).alias("decides"))), ignorenulls=True).over(ahead))
    kept = marked.where((reasoning | decides) & F.col("end.decides"))
    texts = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("content", F.lit("")).alias("content"))))
    return kept.groupBy("uuid", F.col("end.at").alias("end")).agg(F.min("idx").alias("start"), F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("target")).select("uuid", "start", "end", "target")


def as_array(segments: DataFrame) -> DataFrame:
    """(uuid, segments): all decisions of a trajectory in order."""
    return segments.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "target"))).alias("segments"))


def next_decision(segments: Column | str, after: Column) -> Column:
    """The first decision that starts after an index, or null."""
    return F.get(F.filter(segments, lambda s: s["start"] > after), F.lit(0))


def final_decision(segments: Column | str) -> Column:
    return F.try_element_at(segments if isinstance(segments, Column) else F.col(segments), F.lit(-1))


def prefix(messages: Column | str, length: Column) -> Column:
    """The first ``length`` messages."""
    return F.slice(messages, F.lit(1), length)
