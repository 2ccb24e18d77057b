import json
import random

import pytest

from weft.operators import nested


def brute(value, path):
    """Paths of all objects that are elements of arrays, by plain recursion."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += brute(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict):
                out.append(f"{path}[{i}]")
            out += brute(v, f"{path}[{i}]")
    return out


def some(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice([None, 1, 2.5, "x", True, "", 10**30])
    if kind < 0.65:
        return [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdé."): some(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_random_values_against_recursion(spark):
    rng = random.Random(1)
    values = [some(rng) for _ in range(300)]
    df = spark.createDataFrame([(str(i), "r", json.dumps(v)) for i, v in enumerate(values)], "record_key string, root string, text string")
    got = {(r.record_key, r.path) for r in nested.nodes(df).where("in_array").collect()}
    assert got == {(str(i), p) for i, v in enumerate(values) for p in brute(v, "r")}


def test_every_child_leads_to_its_parent(spark):
    df = spark.createDataFrame([("k", "r", '{"a": [{"b": {"c": [{"d": 1}, null, [{"e": 2}]]}}], "z": 3}')], "record_key string, root string, text string")
    rows = nested.with_keys(nested.nodes(df)).collect()
    ids = {r.row_id: r for r in rows}
    assert {r.path for r in rows} == {"r", "r.a[0]", "r.a[0].b.c[0]", "r.a[0].b.c[2][0]"}
    assert all(r.parent_id in ids and ids[r.parent_id].path == r.parent_path for r in rows if r.parent_path)
    assert {r.path: r.ordinal for r in rows}["r.a[0].b.c[2][0]"] == 0


def test_responses():
    inner = '[{"a": 1}]'
    for text in (inner, f"<tool_response>\n{inner}\n</tool_response>", f"<TOOL_RESPONSE>{inner}</TOOL_RESPONSE>", f"```json\n{inner}\n```", f"<tool_response>\n```\n{inner}\n```\n</tool_response>", json.dumps(inner)):
        assert nested.response(text) == [{"a": "1"}]
    assert nested.response(json.dumps({"a": inner})) == {"a": inner}  # strings further inside stay closed
    assert nested.response(json.dumps(json.dumps(inner))) == inner  # opened once only
    for bad in ("", "no JSON", '{"a": 1', "[1] x", "NaN", None):
        with pytest.raises(ValueError):
            nested.response(bad)


def test_deep_and_odd_values():
    deep = "[" * 50_000 + '{"a": [{}]}' + "]" * 50_000
    paths = [p for p, *_ in nested.walk(nested.parse(deep), "r", "r")]
    assert len(paths) == 3
    assert nested._deep('{"a": [1, {"b": "\\u00e9"}, null, true, []], "c": {}}') == {"a": ["1", {"b": "é"}, None, True, []], "c": {}}
    for bad in ("[1,]", "{,}", '{"a" 1}', "[1 2]", "]", "[", "", "1 2", '{"a":}', "{1:2}", "[[}"):
        with pytest.raises(ValueError):
            nested._deep(bad)


def test_children_of_edge_tables(spark):
    message = "array<struct<role:string,content:string>>"
    samples = spark.createDataFrame(
        [
            ("s1", [("tool_output", '[{"a": 1}]'), None, ("tool_output", None), ("user", '[{"a": 1}]')], {"t": 2, "n": None}),
            ("s1", [("tool_output", '[{"a": 1}]'), None, ("tool_output", None), ("user", '[{"a": 1}]')], {"t": 2, "n": None}),
            ("s2", None, None),
            (None, [("tool_output", '[{"a": 1}]')], {"t": 1}),
        ],
        f"sample_id string, messages {message}, full_tool_success_counts map<string,int>",
    )
    stats = spark.createDataFrame([("u1", '{"t": 1, "x": null}'), ("u1", '{"t": 1, "x": null}'), ("u2", None), ("u3", "{broken"), ("u4", "[1]")], "uuid string, tool_success_counts_json string")
    got = sorted(tuple(r) for r in nested.children(samples, stats).collect())
    assert got == [("s1", "full_tool_success_counts.t"), ("s1", "messages[0].content[0]"), ("u1", "tool_success_counts_json.t")]
    assert nested.children(samples.limit(0), stats.limit(0)).count() == 0


def test_merged_schema_and_child_table(spark):
    df = spark.createDataFrame([("a", "r", '[{"x": 1, "t": ["p", "q"]}, {"x": "s", "y": null}]'), ("b", "r", '[{"x": 2.5}]')], "record_key string, root string, text string")
    rows = nested.nodes(df)
    schema = {(r.table_path, r.field): (r.types, r.n_present, r.n_rows, r.optional) for r in nested.merged_schema(rows).collect()}
    assert schema["r[]", "x"] == ("double|integer|string", 3, 3, False)
    assert schema["r[]", "t[]"] == ("string", 1, 3, True)
    assert nested.tables(rows)["r[]"].dtypes[4:] == [("x", "string"), ("y", "string")]
    numbers = nested.tables(nested.nodes(spark.createDataFrame([("a", "r", '{"n": [{"i": 1, "d": 2, "b": true, "s": "7"}, {"i": 12345678901234567890, "d": 0.5, "b": null}]}')], "record_key string, root string, text string")))
    assert set(numbers) == {"r", "r.n[]"}
    assert sorted((r.ordinal, int(r.i), r.d, r.b, r.s) for r in numbers["r.n[]"].collect()) == [(0, 1, 2.0, True, "7"), (1, 12345678901234567890, 0.5, None, None)]
    few = nested.tables(rows, most=1, widest=1)  # what is beyond the bounds is in a map column and in the table without a name
    assert set(few) == {"r[]", None} and few["r[]"].count() == 3 and few[None].count() == 2
    assert sorted(repr(sorted(r.other_fields.items())) for r in few["r[]"].collect()) == sorted(repr(sorted(x.items())) for x in ({"t[0]": "p", "t[1]": "q"}, {"y": None}, {}))
    table = nested.child_table(rows, "r[]", ["x", "y"])
    assert sorted((r.record_key, r.ordinal, r.x, r.y) for r in table.collect()) == [("a", 0, "1", None), ("a", 1, "s", None), ("b", 0, "2.5", None)]


def test_rows_of_all_three_fields(spark, root):
    found = {tuple(r) for r in nested.p3_found(spark, root).collect()}
    rows = nested.p3_rows(spark, root).collect()
    ids = {r.row_id for r in rows}
    assert len(ids) == len(rows) and {(r.record_key, r.path) for r in rows if r.ordinal is not None} == found
    assert all(r.parent_id in ids for r in rows if r.ordinal is not None)
    schema = {(r.table_path, r.field): r.types for r in nested.p3_schema(spark, root).collect()}
    for field, table in (("full_tool_success_counts", nested.p3_map_counts), ("tool_success_counts_json", nested.p3_json_counts)):
        assert schema[field + "{}", "name"] == "string" and (field + "{}", "value") in schema
        flat = table(spark, root).collect()
        assert {(r.record_key, f"{field}.{r.name}") for r in flat} == {f for f in found if f[1].startswith(field)}
        assert len(flat) == len({r.row_id for r in flat}) and {r.parent_id for r in flat} <= ids
    roots, children = nested.p3_responses(spark, root).collect(), nested.p3_children(spark, root).collect()
    assert {r.row_id for r in roots + children} < ids and {r.parent_id for r in children} <= {r.row_id for r in roots + children}
    assert len(children) == sum(f[1].startswith("messages") for f in found)


def test_entries_and_flat_columns(spark):
    df = spark.createDataFrame([("u", "r", '{"t": 1, "n": null, "o": {"a": 2, "l": [{"b": 3}]}}'), ("u", "r", ' {"t": 1, "n": 4}'), ("v", "r", "[1]"), ("w", "r", None)], "record_key string, root string, text string")
    rows = {r.path: r for r in nested.entry_nodes(df).collect()}
    assert set(rows) == {"r", "r.t", "r.n", "r.o", "r.o.l[0]"} and rows["r.o.l[0]"].parent_path == "r.o" and rows["r.o"].parent_path == "r"
    assert rows["r.n"].fields["value"].value == "4" and rows["r.o"].fields["value.a"].value == "2"
    odd = spark.createDataFrame([("a", "r", '[{"x": 1, "X": "s", "t": [1, 2]}, {"a.b": 1, "a": {"b": true}}]')], "record_key string, root string, text string")
    flat = nested.flat(nested.nodes(odd).where("in_array"))
    assert len({c.lower() for c in flat.columns}) == len(flat.columns)
    assert [int(i) for i in flat.where("ordinal = 0").first().t] == [1, 2]


def test_bounds_of_flat_tables_lose_nothing(spark):
    """More table paths and more fields than a driver should list: every value is still in some table."""
    text = json.dumps({f"list{i}": [{f"key{i}_{j}": j for j in range(5)}] for i in range(30)})
    rows = nested.nodes(spark.createDataFrame([("a", "r", text)], "record_key string, root string, text string"))
    found = nested.tables(rows, most=10, widest=3)
    assert len(found) == 11 and sum(t.count() for t in found.values()) == 31
    values = [v for name, t in found.items() for r in t.collect() for v in [*(r[f] for f in t.columns[4 if name else 5 :] if f != "other_fields"), *((r.other_fields or {}).values() if "other_fields" in t.columns else ())] if v is not None]
    assert len(values) == 150
    flat = nested.flat(rows.where("in_array"), widest=20).collect()
    assert len(flat) == 30 and sum(len(r.other_fields) for r in flat) + sum(v is not None for r in flat for v in r[5:-1]) == 150


def test_first_valid_text_of_a_place_counts(spark):
    df = spark.createDataFrame([("a", "r", ["{broken", '[{"x": 1}]', '[{"x": 2}, {"x": 3}]']), ("b", "r", [])], "record_key string, root string, text array<string>")
    assert [(r.path, r.fields["x"].value) for r in nested.nodes(df).where("in_array").collect()] == [("r[0]", "1")]
    assert nested.orphans(nested.nodes(df)).count() == 0
