"""Pairs, decisions and counts of a trajectory within its row: no shuffle before the messages are gone.

All of it is index arithmetic over arrays, linear in the number of messages. Calls and outputs are filtered out in order; an
output's place among both says how many calls came before it. Where no output comes before its call, the k-th output
belongs to the k-th call. Only a trajectory with an output too many is folded, and what the fold collects goes into
chunks, so that no step copies more than one chunk and the list of them. A decision begins after the last message before
it that is no reasoning. ``pairing`` and ``segments`` hold the same semantics as windows over rows of messages, for
input that is stored so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.common import let, one_per_key
from weft.functions.outcome import classify_outputs
from weft.functions.text import tool_name
from weft.operators.messages import ASSISTANT, MESSAGE
from weft.operators.pairing import NO_NAME

PAIR = "struct<k:bigint,tool_name:string,call_index:int,output_index:int,result:string>"


def _is(m: Column, role: str) -> Column:
    return F.coalesce(m["role"] == role, F.lit(False))


#: Pairs that a fold collects before it puts them away.
CHUNK = 64


def _elements(messages: Column) -> Column:
    """(i, role, name) of each message; the name is that of a call's tool."""
    return F.transform(messages, lambda m, i: F.struct(i.cast("int").alias("i"), F.coalesce(m["role"], F.lit("")).alias("role"), F.when(_is(m, "tool_call"), F.coalesce(tool_name(m["content"], m["name"]), F.lit(NO_NAME))).alias("name")))


def _pair(row: Column, output: Column, seen: Column, used: Column) -> Column:
    """The pair of the output number ``seen`` and the call number ``used``, both from 0."""
    call = F.get(row["calls"], used)
    return F.struct((used + 1).cast("bigint").alias("k"), call["tool_name"].alias("tool_name"), call["idx"].alias("call_index"), output["i"].alias("output_index"), F.get(row["verdicts"], seen).alias("result"))


def _pairs(row: Column) -> Column:
    """Pairs of a struct of ``calls``, ``outs`` (outputs with their place q among calls and outputs) and ``verdicts``, first in, first out."""
    numbered = F.transform(row["outs"], lambda o, j: F.struct(o["i"].alias("i"), j.alias("j"), (o["q"] - j).alias("before")))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    zero = F.struct(F.lit(0).alias("used"), empty(f"array<{PAIR}>").alias("full"), empty(PAIR).alias("part"))

    def step(s: Column, o: Column) -> Column:
        takes, fills = s["used"] < o["before"], F.size(s["part"]) >= CHUNK
        new = F.array(_pair(row, o, o["j"], s["used"]))
        return F.struct(
            (s["used"] + takes.cast("int")).alias("used"),
            F.when(takes & fills, F.concat(s["full"], F.array(s["part"]))).otherwise(s["full"]).alias("full"),
            F.when(takes & fills, new).when(takes, F.concat(s["part"], new)).otherwise(s["part"]).alias("part"),
        )

    folded = F.aggregate(numbered, zero, step, lambda s: F.flatten(F.concat(s["full"], F.array(s["part"]))))
    too_many = F.size(F.filter(row["outs"], lambda o, j: o["q"] - j <= j)) > 0
    return F.when(too_many, folded).otherwise(F.transform(row["outs"], lambda o, j: _pair(row, o, j, j)))


def _decisions(solid: Column) -> Column:
    """(start, end) of the decisions, out of all messages that are no reasoning, in order."""
    each = F.transform(solid, lambda x, k: F.struct((F.coalesce(F.get(solid, k - 1)["i"], F.lit(-1)) + 1).alias("start"), x["i"].alias("end"), x["role"].alias("role")))
    return F.transform(F.filter(each, lambda x: x["role"].isin("tool_call", "answer")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def parsed(trajectories: DataFrame) -> DataFrame:
    """(uuid, split, messages array, broken) of each row with a uuid, in place; see ``messages.parsed`` for what is broken."""
    array = F.from_json("messages", MESSAGE)
    ok = F.json_array_length("messages").isNotNull() & array.isNotNull()
    return trajectories.where("uuid is not null").select("uuid", "split", F.when(ok, array).alias("messages"), (~F.coalesce(ok, F.lit(False))).alias("broken"))


def analysed(trajectories: DataFrame, outcomes: bool = True) -> DataFrame:
    """``parsed`` rows with calls, pairs, unpaired_calls, unpaired_outputs and decisions; still in place, repeated uuids still there.

    Without ``outcomes`` the pairs have no result, and nothing leaves the JVM.
    """
    rows = parsed(trajectories)
    outputs = F.transform(F.filter("messages", lambda m: _is(m, "tool_output")), lambda m: m["content"])
    rows = rows.withColumn("verdicts", classify_outputs(outputs) if outcomes else F.lit(None).cast("array<string>"))
    rows = rows.withColumn("e", _elements(F.col("messages")))
    rows = rows.withColumn("events", F.transform(F.filter("e", lambda x: x["role"].isin("tool_call", "tool_output")), lambda x, q: F.struct(x["i"].alias("i"), x["role"].alias("role"), x["name"].alias("name"), q.alias("q"))))
    rows = rows.withColumns({
        "calls": F.transform(F.filter("events", lambda x: x["role"] == "tool_call"), lambda x: F.struct(x["i"].alias("idx"), x["name"].alias("tool_name"))),
        "outs": F.filter("events", lambda x: x["role"] == "tool_output"),
        "solid": F.filter("e", lambda x: x["role"] != "reasoning"),
    }).drop("e", "events")
    # bound as wholes, so that no plan works an array out again for each of its elements
    rows = rows.withColumns({"pairs": let(F.struct("calls", "outs", "verdicts"), _pairs), "decisions": let(F.col("solid"), _decisions)})
    return rows.select(
        "uuid", "split", "messages", "broken", "calls", "pairs", (F.size("calls") - F.size("pairs")).cast("bigint").alias("unpaired_calls"),
        (F.size("outs") - F.size("pairs")).cast("bigint").alias("unpaired_outputs"), F.size("outs").cast("bigint").alias("outputs"), "decisions",
    )


def once(rows: DataFrame) -> DataFrame:
    """One row per uuid, hashed by it; only the columns that are used afterwards are moved. Of repeats that differ the greatest counts."""
    return one_per_key(rows, "uuid")


def joined(messages: Column, first: Column, last: Column) -> Column:
    """The contents from one index to another, a line each."""
    return F.array_join(F.transform(F.slice(messages, first + 1, last - first + 1), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def turns(messages: Column | str) -> Column:
    """Chat turns as an array of (role, like, lines): assistant-like messages merge, a reasoning begins a new turn.

    Turns are found by their first messages, each of which is told by its neighbour alone; nothing is copied twice.
    """
    whole = F.col(messages) if isinstance(messages, str) else messages
    like = lambda m: F.coalesce(F.trim(m["role"]).isin(*ASSISTANT), F.lit(False))
    flags = F.transform(whole, lambda m, i: F.struct(i.cast("int").alias("i"), like(m).alias("like"), F.trim(m["role"]).alias("role")))

    def starts(flag: Column) -> Column:
        return F.filter(flag, lambda x, i: ~x["like"] | ~F.coalesce(F.get(flag, i - 1)["like"], F.lit(False)) | F.coalesce(x["role"] == "reasoning", F.lit(False)))

    def each(start: Column) -> Column:
        def turn(x: Column, k: Column) -> Column:
            after = F.coalesce(F.get(start, k + 1)["i"], F.size(whole))
            lines = F.transform(F.slice(whole, x["i"] + 1, after - x["i"]), lambda m: F.coalesce(m["content"], F.lit("")))
            shown = F.when(x["like"], "assistant").when(x["role"] == "tool_output", "tool").otherwise(x["role"])
            return F.struct(shown.alias("role"), x["like"].alias("like"), lines.alias("lines"))

        return F.transform(start, turn)

    return let(let(flags, starts), each)
