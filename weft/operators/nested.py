"""Flat, related tables out of nested JSON values, arrays of objects and maps.

``nodes`` explodes every array level of a JSON value, level by level, into one row for each object (and for the root), with
the key of its parent row and its ordinal in the array it came from. ``merged_schema`` aggregates the fields of all rows
of one table path into one schema, ``child_tables`` lists its tables by level, ``child_rows`` are their rows with
surrogate and parent keys, and ``child_table``, ``tables`` and ``flat`` project them onto the schema's columns.

Values are parsed once: the rows are written as a table (``session.written``), and schema, keys and tables read from it
the columns they need. Surrogate keys are 128-bit hashes of record and path, so they need no shuffle and no counter, and do
not collide in practice at any number of rows.

Defined results: a null, blank or invalid JSON value has no rows; an empty array has no children; an object repeated
in an array is one row per position; null keys of records are dropped, since no child could lead back to them; texts of one
place of a repeated record count once, the first valid one in order; fields beyond the ``widest`` of a flat table are in its
column ``other_fields``, so that no field is lost where keys are data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.common import table
from weft.session import written

#: Tag and fence around a response; fixed values of the data's format.
RESPONSE = re.compile(r"<tool_response>(.*?)</tool_response>", re.I | re.S)
FENCE = re.compile(r"^```[^\n`]*\n?(.*?)\n?\s*```$", re.S)

NODE_SCHEMA = "record_key string, path string, parent_path string, table_path string, ordinal int, depth int, in_array boolean, fields map<string,struct<type:string,value:string>>"
_ARROW = pa.schema(
    [
        ("record_key", pa.string()),
        ("path", pa.string()),
        ("parent_path", pa.string()),
        ("table_path", pa.string()),
        ("ordinal", pa.int32()),
        ("depth", pa.int32()),
        ("in_array", pa.bool_()),
        ("fields", pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))),
    ]
)
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


class _Number(str):
    """A number as it is spelled, so that no digit is lost and no size fails."""


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def _deep(text: str) -> Any:
    """A stack-based JSON reader, for values nested deeper than the recursive reader can go."""
    root: list = []
    stack: list[tuple[Any, str | None]] = [(root, None)]  # container, key that waits for its value
    pos, want, end = 0, "value", len(text.rstrip())
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(pos)
        pos = m.end()
        mark, string, scalar = m.groups()
        box, key = stack[-1]
        if mark in ("}", "]"):
            if len(stack) == 1 or isinstance(box, dict) != (mark == "}") or want not in ("comma", "first"):
                raise ValueError(pos)
            stack.pop()
            want = "comma"
            continue
        if mark == ",":
            if want != "comma" or len(stack) == 1:
                raise ValueError(pos)
            want = "key" if isinstance(box, dict) else "value"
            continue
        if isinstance(box, dict) and want in ("key", "first"):
            if string is None:
                raise ValueError(pos)
            stack[-1] = (box, json.loads(string))
            want = "colon"
            continue
        if mark == ":":
            if want != "colon":
                raise ValueError(pos)
            want = "value"
            continue
        if want not in ("value", "first"):
            raise ValueError(pos)
        value: Any = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string else {"true": True, "false": False, "null": None}.get(scalar, _Number(scalar))
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        if mark:
            stack.append((value, None))
            want = "first"
        else:
            want = "comma"
    if len(stack) != 1 or len(root) != 1 or want != "comma":
        raise ValueError(pos)
    return root[0]


def parse(text: str) -> Any:
    """Strict JSON; raises ValueError. NaN and Infinity are no JSON; a repeated key keeps its last value."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)


def response(content: str | None) -> Any:
    """The value inside a tool response: tag and code fence dropped, a JSON string opened once more. Raises ValueError."""
    if content is None:
        raise ValueError("null")
    m = RESPONSE.search(content)
    text = (m[1] if m else content).strip()
    m = FENCE.match(text)
    value = parse((m[1] if m else text).strip())
    if isinstance(value, str) and not isinstance(value, _Number):
        try:
            value = parse(value.strip())
        except ValueError:
            pass
    return value


def _typed(value: Any) -> dict[str, str | None]:
    """A scalar with its JSON type; whole and other numbers are told apart by their spelling."""
    if value is None:
        return {"type": "null", "value": None}
    if isinstance(value, bool):
        return {"type": "boolean", "value": "true" if value else "false"}
    if isinstance(value, _Number):
        return {"type": "integer" if value.lstrip("-").isdigit() else "double", "value": str(value)}
    return {"type": "string", "value": _clean(value)}


def walk(value: Any, path: str, name: str) -> Iterator[tuple[str, str | None, str, int | None, int, bool, list]]:
    """Rows of one value, each with the nearest row above it as its parent.

    The root is a row, and so is each object that is an element of an array; an object that is a field of an object
    stays in its parent's row, its fields joined with dots. Positions count all elements.
    """
    stack: list[tuple[Any, str, str | None, str, int | None, int, bool]] = [(value, path, None, name, None, 0, False)]
    while stack:
        node, at, parent, kind, ordinal, depth, in_array = stack.pop()
        fields: list[tuple[str, dict]] = []
        below: list[tuple[Any, str, str | None, str, int | None, int, bool]] = []
        inner: list[tuple[Any, str, str, int | None, str]] = [(node, at, kind, ordinal, "")]
        while inner:
            x, here, table_path, _, field = inner.pop()
            if isinstance(x, dict):
                inner.extend((v, f"{here}.{k}", f"{table_path}.{k}", None, f"{field}.{k}" if field else k) for k, v in reversed(x.items()))
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    if isinstance(v, dict):
                        below.append((v, f"{here}[{i}]", at, f"{table_path}[]", i, depth + 1, True))
                    elif isinstance(v, list):
                        inner.append((v, f"{here}[{i}]", f"{table_path}[]", i, f"{field}[{i}]"))
                    elif field or ordinal is None:
                        fields.append((f"{field}[{i}]", _typed(v)))
            elif field:
                fields.append((field, _typed(x)))
        yield at, parent, kind, ordinal, depth, in_array, fields
        stack.extend(reversed(below))


def walk_entries(values: dict[str, Any], root: str) -> Iterator[tuple[str, str | None, str, int | None, int, bool, list]]:
    """Rows of an object whose keys are data: one for the object and one per entry with a value, with the fields ``name`` and ``value``.

    Positions count the entries without a value too; arrays of objects below an entry are walked on.
    """
    yield root, None, root, None, 0, False, []
    for i, (name, value) in enumerate(values.items()):
        if value is None:
            continue
        for at, parent, kind, ordinal, depth, in_array, fields in walk(value, f"{root}.{name}", f"{root}{{}}"):
            if parent is None:
                inner = [(f"value{f}" if f.startswith("[") else f"value.{f}", v) for f, v in fields]
                scalar = [] if isinstance(value, (dict, list)) else [("value", _typed(value))]
                yield at, root, kind, i, 1, False, [("name", _typed(name)), *scalar, *inner]
            else:
                yield at, parent, kind, ordinal, depth + 1, in_array, fields


def _clean(text: str | None) -> str | None:
    """Arrow takes no lone surrogates."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _node_batches(rows: Iterator[tuple], with_fields: bool = True) -> Iterator[pa.RecordBatch]:
    """Arrow batches of NODE_SCHEMA out of (record_key, rows of ``walk``)."""
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
    out: list[list] = [[] for _ in _ARROW]
    for key, walked in rows:
        for at, parent, kind, ordinal, depth, in_array, fields in walked:
            row = (key, _clean(at), _clean(parent), _clean(kind), ordinal, depth, in_array, [(_clean(k), v) for k, v in dict(fields).items()] if with_fields else None)
            for column, cell in zip(out, row, strict=True):
                column.append(cell)
        if len(out[0]) >= 20_000:
            yield pack(out)
            out = [[] for _ in _ARROW]
    yield pack(out)


def nodes(df: DataFrame, reader: str = "json", with_fields: bool = True) -> DataFrame:
    """Rows of NODE_SCHEMA for ``df(record_key, root, text)``; ``root`` is the path that leads to the text.

    reader: ``json`` for a plain JSON text, ``response`` for a tool response with tags and fences. ``text`` may be an array of
    texts of the same place, of which the first valid one counts. A map of counts comes by ``entry_nodes``.
    """
    read = response if reader == "response" else (lambda t: parse(t.strip()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, root, texts in zip(*(batch.column(c).to_pylist() for c in ("record_key", "root", "text")), strict=True):
                for text in [texts] if isinstance(texts, str) else texts or ():
                    if key is None or text is None or not text.strip():
                        continue
                    try:
                        value = read(text)
                    except ValueError:
                        continue
                    yield key, walk(value, root, re.sub(r"\[\d+\]", "[]", root))
                    break

    return df.select("record_key", "root", "text").mapInArrow(lambda batches: _node_batches(rows(batches), with_fields), NODE_SCHEMA)


def entry_nodes(df: DataFrame) -> DataFrame:
    """Rows of NODE_SCHEMA for the JSON objects of ``df(record_key, root, text)``, whose keys are data; see ``walk_entries``.

    Texts of one record that differ are one object, as the first of them in order has it; so no row comes twice.
    """
    texts = df.where("record_key is not null and text is not null").groupBy("record_key", "root").agg(F.array_sort(F.collect_set("text")).alias("texts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, root, spelled in zip(*(batch.column(c).to_pylist() for c in ("record_key", "root", "texts")), strict=True):
                values: dict[str, Any] | None = None
                for text in spelled:
                    try:
                        value = parse(text.strip())
                    except ValueError:
                        continue
                    if isinstance(value, dict):
                        values = values if values is not None else {}
                        values.update({k: v for k, v in value.items() if values.get(k) is None})
                if values is not None:
                    yield key, walk_entries(values, root)

    return texts.mapInArrow(lambda batches: _node_batches(rows(batches)), NODE_SCHEMA)


def message_texts(df: DataFrame, key: str, role: str, messages: str = "messages") -> DataFrame:
    """(record_key, root, text) of each message of one role; ``root`` is ``messages[i].content``, i counting null messages too."""
    indexed = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), m["content"].alias("text")))
    picked = F.filter(indexed, lambda x: (x["role"] == role) & x["text"].isNotNull())
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("record_key"), F.explode(picked).alias("m")).select("record_key", F.format_string(messages + "[%d].content", "m.i").alias("root"), "m.text")


def with_keys(nodes_df: DataFrame) -> DataFrame:
    """Surrogate keys: ``row_id`` and ``parent_id`` are 128-bit hashes of record and path, as hex digits."""
    key = lambda c: F.md5(F.concat(F.col("record_key"), F.lit("\x1f"), F.col(c)))
    return nodes_df.withColumn("row_id", key("path")).withColumn("parent_id", F.when(F.col("parent_path").isNotNull(), key("parent_path")))


def merged_schema(nodes_df: DataFrame) -> DataFrame:
    """One row per table path and field over all records: its types, how many rows hold it, whether it is optional.

    Array positions in scalar arrays are merged, so ``tags[0]`` and ``tags[1]`` are the one field ``tags[]``.
    """
    pairs = F.array_distinct(F.transform(F.map_entries("fields"), lambda e: F.struct(F.regexp_replace(e["key"], r"\[\d+\]", "[]").alias("field"), e["value"]["type"].alias("type"))))
    rows = nodes_df.groupBy("table_path").agg(F.count("*").alias("n_rows"))
    seen = nodes_df.select("table_path", pairs.alias("pairs")).select("table_path", F.transform("pairs", lambda p: p["field"]).alias("names"), F.posexplode("pairs").alias("i", "p"))
    first = F.array_position("names", F.col("p.field")) == F.col("i") + 1  # a field of several types counts once per row
    by = seen.groupBy("table_path", F.col("p.field").alias("field")).agg(F.count_if(first).alias("n_present"), F.array_join(F.array_sort(F.collect_set("p.type")), "|").alias("types"))
    return by.join(rows, "table_path").select("table_path", "field", "types", "n_present", "n_rows", (F.col("n_present") < F.col("n_rows")).alias("optional"))


def child_tables(nodes_df: DataFrame) -> DataFrame:
    """(table_path, level, n_rows): the tables of the merged schema that hang below another one, by how many levels; an entry of a map is a level, too."""
    by = nodes_df.groupBy("table_path").agg(F.count("*").alias("n_rows"), F.max("depth").alias("level"), F.bool_or(F.col("parent_path").isNotNull()).alias("child"))
    return by.where("child").select("table_path", "level", "n_rows")


def child_rows(nodes_df: DataFrame) -> DataFrame:
    """(record_key, row_id, parent_id, table_path, level, ordinal, path) of the rows of all child tables."""
    levels = child_tables(nodes_df).select(F.col("table_path").alias("_t"), "level")
    rows = with_keys(nodes_df.where("parent_path is not null").drop("fields"))
    return rows.join(levels, F.col("table_path") == F.col("_t")).select("record_key", "row_id", "parent_id", "table_path", "level", "ordinal", "path")


def orphans(nodes_df: DataFrame) -> DataFrame:
    """Child rows without a parent row: none, if every child leads back."""
    rows = with_keys(nodes_df.drop("fields"))
    parents = rows.select(F.col("record_key").alias("_k"), F.col("row_id").alias("_r"))
    return rows.where("parent_id is not null").join(parents, (F.col("record_key") == F.col("_k")) & (F.col("parent_id") == F.col("_r")), "left_anti").select("record_key", "row_id", "parent_id", "path")


def child_table(nodes_df: DataFrame, table_path: str | None, fields: dict[str, str] | list[str], rest: bool = False) -> DataFrame:
    """One flat table with a column per field; a field that a row lacks is null. fields: types as ``merged_schema`` has them, or names.

    rest: whether all other fields come as the map ``other_fields``.
    """
    rows = with_keys(nodes_df if table_path is None else nodes_df.where(F.col("table_path") == table_path))
    kinds = dict.fromkeys(fields, "string") if isinstance(fields, list) else fields
    columns = [F.try_element_at("fields", F.lit(f))["value"].cast("string").try_cast(_column_type(t)).alias(f.replace(".", "_")) for f, t in kinds.items()]
    other = [F.transform_values(F.map_filter("fields", lambda k, _: ~k.isin(list(kinds))) if kinds else F.col("fields"), lambda _, v: v["value"]).alias("other_fields")] if rest else []
    return rows.select("record_key", "row_id", "parent_id", "ordinal", *([] if table_path is not None else ["table_path"]), *columns, *other)


def _column_type(types: str) -> str:
    """The narrowest column that holds all of a field's types."""
    have = set(types.split("|")) - {"null"}
    return {frozenset(["integer"]): "decimal(38,0)", frozenset(["double"]): "double", frozenset(["integer", "double"]): "double", frozenset(["boolean"]): "boolean"}.get(frozenset(have), "string")


def tables(nodes_df: DataFrame, most: int = 10_000, widest: int = 2_000) -> dict[str | None, DataFrame]:
    """All child tables by table path, each with the merged schema's columns and types; fields of scalar arrays stay in ``nodes``.

    The ``most`` table paths with most rows are tables of their own, and their ``widest`` most frequent fields columns; what is
    beyond these, as where keys are data, is not lost: further fields are in ``other_fields``, and the rows of further table
    paths in the table of the name None, which keeps their paths.
    """
    fields = merged_schema(nodes_df).where("instr(field, '[]') = 0")
    ranked = fields.withColumn("_n", F.row_number().over(Window.partitionBy("table_path").orderBy(F.desc("n_present"), "field")))
    sizes = nodes_df.groupBy("table_path").agg(F.count("*").alias("n"))
    paths = [r.table_path for r in sizes.orderBy(F.desc("n"), "table_path").limit(most + 1).collect()]
    own = paths[:most]
    by: dict[str, dict[str, str]] = {p: {} for p in sorted(own)}
    wide = set()
    for r in ranked.where(F.col("_n") <= widest + 1).join(F.broadcast(sizes.sparkSession.createDataFrame([(p,) for p in own], "table_path string")), "table_path", "left_semi").orderBy("table_path", "field").collect():
        if r._n > widest:
            wide.add(r.table_path)
        else:
            by[r.table_path][r.field] = r.types
    out: dict[str | None, DataFrame] = {path: child_table(nodes_df, path, kinds, path in wide) for path, kinds in by.items()}
    if len(paths) > most:
        named = sizes.sparkSession.createDataFrame([(p,) for p in own], "_p string")
        out[None] = child_table(nodes_df.join(F.broadcast(named), F.col("table_path") == F.col("_p"), "left_anti"), None, {}, True)
    return out


def flat(nodes_df: DataFrame, widest: int = 2_000) -> DataFrame:
    """All rows in one flat table, beside their table path a column per field of the merged schema; scalar arrays are array columns.

    Columns are named by their fields, dots as underscores; names that differ in nothing else get a number. The ``widest`` most
    frequent fields are columns; if there are more, these are in ``other_fields``, an entry per value.
    """
    by = merged_schema(nodes_df).groupBy("field").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("types", r"\|"))))), "|").alias("types"), F.sum("n_present").alias("n"))
    found = by.orderBy(F.desc("n"), "field").limit(widest + 1).collect()
    kept = found[:widest]
    used = {"record_key", "row_id", "parent_id", "table_path", "ordinal", "other_fields"}
    columns = []
    plain = lambda k: F.regexp_replace(k, r"\[\d+\]", "[]")
    for f, types in sorted((r.field, r.types) for r in kept):
        kind = _column_type(types)
        base = name = f.replace("[]", "").replace(".", "_") or "items"
        n = 2
        while name.lower() in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name.lower())
        if "[]" in f:
            same = F.filter(F.map_entries("fields"), lambda e: plain(e["key"]) == F.lit(f))  # noqa: B023 (called at once)
            column = F.transform(same, lambda e: e["value"]["value"].cast("string").try_cast(kind))  # noqa: B023
            column = F.when(F.size(column) > 0, column)
        else:
            column = F.try_element_at("fields", F.lit(f))["value"].cast("string").try_cast(kind)
        columns.append(column.alias(name))
    if len(found) > widest:
        names = [r.field for r in kept]
        columns.append(F.transform_values(F.map_filter("fields", lambda k, _: ~plain(k).isin(names)), lambda _, v: v["value"]).alias("other_fields"))
    return with_keys(nodes_df).select("record_key", "row_id", "parent_id", "table_path", "ordinal", *columns)


def response_nodes(samples: DataFrame) -> DataFrame:
    """Nodes of all tool outputs of ``samples(sample_id, messages)``; repeated samples count once."""
    texts = message_texts(samples, "sample_id", "tool_output").groupBy("record_key", "root").agg(F.array_sort(F.collect_set("text")).alias("text"))
    return nodes(texts, "response")


def map_nodes(samples: DataFrame) -> DataFrame:
    """Nodes of the map full_tool_success_counts of ``samples``."""
    return entry_nodes(samples.select(F.col("sample_id").alias("record_key"), F.lit("full_tool_success_counts").alias("root"), F.to_json("full_tool_success_counts", {"ignoreNullFields": "false"}).alias("text")))


def json_nodes(stats: DataFrame) -> DataFrame:
    """Nodes of the JSON objects tool_success_counts_json of ``stats``."""
    return entry_nodes(stats.select(F.col("uuid").alias("record_key"), F.lit("tool_success_counts_json").alias("root"), F.col("tool_success_counts_json").alias("text")))


def children(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """(record_key, child_path) of every row of the child tables of the three nested fields: objects in arrays of tool outputs, and entries of both counts."""
    rows = written(response_nodes(samples).unionByName(map_nodes(samples)).unionByName(json_nodes(stats)))
    asked = F.col("table_path").startswith("messages[") | F.col("table_path").isin("full_tool_success_counts{}", "tool_success_counts_json{}")
    return child_rows(rows).where(asked).select("record_key", F.col("path").alias("child_path"))


def p3_found(spark, root: str) -> DataFrame:
    samples = table(spark, root, "sft_samples").select("sample_id", "messages", "full_tool_success_counts")
    return children(samples, table(spark, root, "nemotron_uuid_same_tool_success_stats").select("uuid", "tool_success_counts_json"))


def _outputs(spark, root: str) -> DataFrame:
    return response_nodes(table(spark, root, "sft_samples").select("sample_id", "messages"))


def _maps(spark, root: str) -> DataFrame:
    return map_nodes(table(spark, root, "sft_samples").select("sample_id", "full_tool_success_counts"))


def _counts(spark, root: str) -> DataFrame:
    return json_nodes(table(spark, root, "nemotron_uuid_same_tool_success_stats").select("uuid", "tool_success_counts_json"))


def _all_nodes(spark, root: str) -> DataFrame:
    return _outputs(spark, root).unionByName(_maps(spark, root)).unionByName(_counts(spark, root))


def p3_rows(spark, root: str) -> DataFrame:
    """The rows of all three nested fields with surrogate keys, parent keys and ordinals; repeated records count once."""
    rows = with_keys(_all_nodes(spark, root))
    return rows.select("record_key", "row_id", "parent_id", "path", "table_path", "ordinal", "depth", F.to_json(F.transform_values("fields", lambda _, v: v["value"])).alias("fields"))


def p3_links(spark, root: str) -> DataFrame:
    """The child rows of all three nested fields with their surrogate keys, parent keys, levels and ordinals."""
    return child_rows(written(_all_nodes(spark, root).drop("fields"))).drop("level")


def p3_orphans(spark, root: str) -> DataFrame:
    """Child rows that lead to no parent: there must be none."""
    return orphans(written(_all_nodes(spark, root).drop("fields")))


def p3_schema(spark, root: str) -> DataFrame:
    """The merged schema of the three nested fields, array positions of messages left out."""
    return merged_schema(written(_all_nodes(spark, root).select("table_path", "fields")))


def p3_responses(spark, root: str) -> DataFrame:
    """The flat table of tool outputs, one row each: the parents of ``p3_children``."""
    return flat(written(_outputs(spark, root).where("parent_path is null")))


def p3_children(spark, root: str) -> DataFrame:
    """The flat child tables of the objects in arrays of tool outputs, told apart by their table path."""
    return flat(written(_outputs(spark, root).where("in_array")))


def p3_map_counts(spark, root: str) -> DataFrame:
    """The flat child table of full_tool_success_counts."""
    return flat(written(_maps(spark, root).where("parent_path is not null")))


def p3_json_counts(spark, root: str) -> DataFrame:
    """The flat child table of tool_success_counts_json."""
    return flat(written(_counts(spark, root).where("parent_path is not null")))
