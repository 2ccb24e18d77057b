"""Trajectories as rows of messages, chat turns and their serialization.

Defined results: null, cut or non-array JSON is a parse error and gives no messages; a null element is a message
without a role; null contents count as empty in texts; a uuid that comes again counts once; null uuids are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.common import one_per_key
from weft.functions.text import chatml

MESSAGE = "array<struct<role:string,content:string,name:string>>"
ASSISTANT = ("reasoning", "tool_call", "answer", "assistant")


def parsed(trajectories: DataFrame) -> DataFrame:
    """(uuid, split, messages array, broken): one row per uuid, hashed by uuid so that all that follows stays in place."""
    array = F.from_json("messages", MESSAGE)
    ok = F.json_array_length("messages").isNotNull() & array.isNotNull()
    rows = trajectories.where("uuid is not null").select("uuid", "split", F.when(ok, array).alias("messages"), (~F.coalesce(ok, F.lit(False))).alias("broken"))
    return one_per_key(rows, "uuid")


def message_rows(whole: DataFrame) -> DataFrame:
    """(uuid, idx, role, content, name) of ``parsed`` rows; idx from 0."""
    return whole.select("uuid", F.posexplode("messages").alias("idx", "m")).select("uuid", "idx", "m.role", "m.content", "m.name")


def chat_turns(rows: DataFrame) -> DataFrame:
    """(uuid, turn, role, text): assistant-like messages merge; a reasoning starts a new turn; all others stand alone."""
    w = Window.partitionBy("uuid").orderBy("idx")
    like = F.coalesce(F.trim("role").isin(*ASSISTANT), F.lit(False))
    begins = ~like | ~F.coalesce(F.lag(like).over(w), F.lit(False)) | (F.trim("role") == "reasoning")
    marked = rows.withColumn("like", like).withColumn("turn", F.sum(begins.cast("int")).over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "\n")
    role = F.when(F.max("like"), "assistant").when(F.max("role") == "tool_output", "tool").otherwise(F.max(F.trim("role")))
    return marked.groupBy("uuid", "turn").agg(role.alias("role"), texts.alias("text"))


def serialized(turns: DataFrame) -> DataFrame:
    """(uuid, prompt): all turns in chat markup, open for the assistant."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", chatml(F.coalesce("role", F.lit("")), "text").alias("s"))))
    return turns.groupBy("uuid").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["s"]), ""), F.lit("<|im_start|>assistant\n")).alias("prompt"))


def serialize_array(messages: Column | str) -> Column:
    """The same markup from an array of messages, within the row: its turns, each joined once."""
    from weft.operators.rowwise import turns

    shown = F.transform(turns(messages), lambda t: chatml(F.coalesce(t["role"], F.lit("")), F.array_join(t["lines"], "\n")))
    return F.concat(F.array_join(shown, ""), F.lit("<|im_start|>assistant\n"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Each message with the roles before and after it."""
    w = Window.partitionBy("uuid").orderBy("idx")
    return rows.withColumns({"previous_role": F.lag("role").over(w), "next_role": F.lead("role").over(w)})
