"""Tool lists: validation of rows, subsets of tools per row, samples by number of tools.

Tools and calls stay JSON texts of open schema; a tool is an element of a VARIANT array. Choices are made by hash
rank within a row, so they are the same for every layout; the same tools are never borrowed from other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.common import let
from weft.functions.text import MARKER, hash_unit, source_id
from weft.operators.ranking import with_row_index

#: Fixed value: the marker's definition among a row's tools.
MARKER_TOOL = '{"name":"trigger_tool","description":"A special trigger tool used by the controlled tool-count experiment.","parameters":{}}'


def json_objects(c: Column | str) -> Column:
    """A JSON array of objects as an array of JSON texts; one object counts as an array; null for anything else."""
    text = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)\A\s+|\s+\z", "")
    as_array = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text)
    items = F.transform(F.try_variant_get(F.try_parse_json(as_array), "$", "array<variant>"), lambda v: F.to_json(v))
    return F.when(F.forall(items, lambda x: x.startswith("{")), items)


def name_of(tool: Column) -> Column:
    """The tool's name if it is a non-empty string."""
    return F.nullif(F.try_variant_get(F.try_parse_json(tool), "$.name", "string"), F.lit(""))


def unique_by_name(tools: Column) -> Column:
    """The first tool of each name, in order; tools without a name are dropped. Each tool is parsed once."""
    named = F.filter(F.transform(tools, lambda t: F.struct(name_of(t).alias("name"), t.alias("tool"))), lambda x: x["name"].isNotNull())
    first = lambda found: lambda names: F.filter(found, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return let(named, lambda found: let(F.transform(found, lambda x: x["name"]), first(found)))


def validated(rows: DataFrame, threshold: int = 3, check_rule: bool = True) -> DataFrame:
    """Rows of (id, query, tools, answers) with parsed lists, counts and ``problem``: the first rule that a row breaks, or null."""
    out = rows.withColumns({"tool_list": json_objects("tools"), "answer_list": json_objects("answers")})
    out = out.withColumn("tool_count", F.size("tool_list")).withColumn("is_trigger", F.coalesce(name_of(F.get("answer_list", F.lit(0))) == MARKER, F.lit(False)))
    nameless = F.exists("answer_list", lambda a: name_of(a).isNull())
    problem = (
        F.when(F.col("query").isNull(), "query is no text")
        .when(F.col("tool_list").isNull(), "tools is no array of objects")
        .when(F.col("answer_list").isNull(), "answers is no array of objects")
        .when(F.size("tool_list") == 0, "no tools")
        .when(F.size("answer_list") == 0, "no answers")
        .when(nameless, "answer without a name")
    )
    if check_rule:
        problem = F.coalesce(problem, F.when(F.col("is_trigger") != (F.col("tool_count") > threshold), "label against rule"))
    return out.withColumn("problem", problem)


def expand(rows: DataFrame, counts: list[int], variants: int = 1, threshold: int = 3, policy: str = "all", seed: int = 42, arguments: str = "null") -> DataFrame:
    """Every row at every number of tools and variant, with its outcome; ``tools`` of what is written is an array of names and texts.

    arguments: what the marker's answer has as arguments, JSON ``null`` or the text ``"null"`` (``string``).
    policy: whether the marker is among the tools in ``all`` rows, ``triggered-only``, or ``absent``.
    outcome: ``written``, ``exceeds`` (more tools asked for than the row has), ``too_few`` (no room for those its answer
    calls) or ``absent_tool`` (its answer calls a tool that it lacks).
    """
    base = validated(rows, threshold, check_rule=False).where("problem is null").withColumn("unique_tools", unique_by_name(F.col("tool_list")))
    base = base.withColumn("needed", F.array_distinct(F.transform("answer_list", name_of))).withColumn("names", F.transform("unique_tools", lambda x: x["name"]))
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n in counts for v in range(1, variants + 1))))
    out = base.withColumn("g", grid).withColumns({"requested": F.col("g.n"), "variant": F.col("g.v")}).drop("g").withColumn("triggered", F.col("requested") > threshold)
    marker = {"all": F.lit(True), "triggered-only": F.col("triggered"), "absent": F.lit(False)}[policy]
    required = F.array_distinct(F.when(marker, F.concat("needed", F.array(F.lit(MARKER)))).otherwise(F.col("needed")))
    out = out.withColumn("required", required).withColumn("optional", F.filter("names", lambda x: ~F.array_contains(F.col("required"), x) & (x != MARKER)))
    room = F.col("requested") - F.size("required")
    outcome = (
        F.when(F.col("requested") > F.size("names"), "exceeds")
        .when(F.size(F.array_except("needed", "names")) > 0, "absent_tool")
        .when((room < 0) | (F.size("optional") < room), "too_few")
        .otherwise("written")
    )
    draw = lambda what: lambda x: F.struct(hash_unit(F.lit(f"{seed}|{what}"), F.col("id"), F.col("requested"), F.col("variant"), x).alias("u"), x.alias("name"))
    ranked = F.transform(F.array_sort(F.transform("optional", draw("pick"))), lambda x: x["name"])
    chosen = F.concat("required", F.slice(ranked, F.lit(1), F.greatest(room, F.lit(0))))
    order = F.transform(F.array_sort(F.transform(chosen, draw("order"))), lambda x: x["name"])
    text_of = lambda n: F.coalesce(F.get(F.filter("unique_tools", lambda t: t["name"] == n), F.lit(0))["tool"], F.when(n == MARKER, F.lit(MARKER_TOOL)))
    out = out.withColumn("outcome", outcome).withColumn("chosen", F.when(F.col("outcome") == "written", order))
    marker_answer = F.lit('[{"name":"trigger_tool","arguments":%s}]' % {"null": "null", "string": '"null"'}[arguments])
    return out.select(
        F.concat(F.col("id").cast("string"), F.lit("_tc"), F.col("requested").cast("string"), F.lit("_v"), F.col("variant").cast("string")).alias("id"), "query",
        F.when(F.col("triggered"), marker_answer).otherwise(F.concat(F.lit("["), F.array_join("answer_list", ","), F.lit("]"))).alias("answers"),
        F.concat(F.lit("["), F.array_join(F.transform("chosen", text_of), ","), F.lit("]")).alias("tools"), F.col("id").cast("string").alias("source_id"), F.size("names").alias("source_tool_count"),
        F.col("requested").alias("tool_count"), F.col("triggered").alias("is_trigger"), "variant", "outcome", "chosen",
    )


def sequential_ids(expanded: DataFrame, start: int = 0) -> DataFrame:
    """What was written with whole numbers as ids, in the order of source, number of tools and variant."""
    rows = with_row_index(expanded.where("outcome = 'written'"), "source_id", "tool_count", "variant")
    return rows.withColumn("id", F.col("row_index") + start).drop("row_index")


def generation_stats(expanded: DataFrame) -> DataFrame:
    """Rows by outcome."""
    return expanded.groupBy("outcome").agg(F.count("*").alias("n"))


def missing_answer_tools(rows: DataFrame) -> DataFrame:
    """(id, tool_name): tools that an answer calls and the row's list lacks."""
    base = validated(rows, check_rule=False)
    return base.select("id", F.explode(F.array_except(F.transform("answer_list", name_of), F.transform("tool_list", name_of))).alias("tool_name")).where("tool_name is not null")


def prompt(system: str, query: Column | str = "query", tools: Column | str = "tools", answers: Column | str | None = None) -> Column:
    """Chat messages of a tool-list row: the system prompt with the tools, the query, and the answer if given."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    col = lambda c: F.col(c) if isinstance(c, str) else c
    turns = [turn("system", F.concat(F.lit(f"{system.strip()}\n\nAvailable tools JSON:\n"), col(tools))), turn("user", col(query))]
    return F.array(*turns, *([turn("assistant", col(answers))] if answers is not None else []))


def sharegpt(rows: DataFrame, system: str) -> DataFrame:
    """(id, conversations) of valid rows."""
    names = {"system": "system", "user": "human", "assistant": "gpt"}
    turns = F.transform(prompt(system, answers="answers"), lambda m: F.struct(F.when(m["role"] == "system", names["system"]).when(m["role"] == "user", names["user"]).otherwise(names["assistant"]).alias("from"), m["content"].alias("value")))
    return rows.select("id", turns.alias("conversations"))


def group_key(group_by: str, query: Column | str = "query", explicit: Column | str = "source_id", row_id: Column | str = "id") -> Column:
    """The key that keeps rows of one query or one source together."""
    if group_by == "query":
        return F.concat(F.lit("query:"), F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))
    if group_by == "source_id":
        return F.concat(F.lit("source:"), source_id(explicit, row_id))
    raise ValueError(f"cannot group by {group_by!r}")
