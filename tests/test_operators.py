import pytest
from pyspark.sql import functions as F

from weft.operators import evaluate, ranking, registry, splits, toolsets


def test_hash_rank_is_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 10 == 0).alias("small"), ranking.unit_hash("id").alias("u")).withColumn("g", F.when(F.col("small"), "a").when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("hot"))
    rows = ranking.hash_rank(df, ["g"], "u", "id", buckets=16).collect()
    assert len(rows) == 5000
    for g in ("a", "hot", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: (r.u, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


STATS = "uuid string, split string, success_count int, failure_count int, unknown_count int, max_same_tool_success_count int"


def test_manifest_has_shares_and_no_leaks(spark):
    rows = [(f"u{i}", "tool_calling" if i % 10 else "interactive_agent", 1, 0, None, i % 6) for i in range(2000)]
    parts = splits.manifest(spark.createDataFrame(rows + rows[:50], STATS))
    assert parts.count() == 2000 and splits.leaks(parts).count() == 0
    counts = {r.data_partition: r["count"] for r in parts.groupBy("data_partition").count().collect()}
    assert counts["test_ood"] == 200 and abs(counts["train"] - 1440) < 10 and abs(counts["validation"] - 180) < 10
    again = splits.manifest(spark.createDataFrame(rows[::-1], STATS).repartition(7))
    assert {(r.uuid, r.data_partition) for r in parts.collect()} == {(r.uuid, r.data_partition) for r in again.collect()}
    got = {r.data_partition: r for r in splits.summary(parts).collect()}
    assert sum(r.uuid_count for r in got.values()) == 2000 and got["train"].total_unknown_calls == 0
    assert splits.manifest(spark.createDataFrame([], STATS)).count() == 0


def test_partitions_together(spark):
    a, b = (spark.createDataFrame([(u, p)], "uuid string, data_partition string") for u, p in (("a", "train"), ("b", "test_iid")))
    assert splits.combined(a, b).count() == 2
    assert [r.uuid for r in splits.unprocessed(splits.combined(a, b), a).collect()] == ["b"]
    with pytest.raises(splits.InvalidInput):
        splits.combined(a, b, a)


def test_input_checks(spark):
    good = [("a", "tool_calling", 1, 0, 0, 1)]
    splits.check_input(spark.createDataFrame(good, STATS))
    for bad in ([("a", "tool_calling", 1, 0, 0, 1)] * 2, [(None, "tool_calling", 1, 0, 0, 1)], [("a", "other", 1, 0, 0, 1)]):
        with pytest.raises(splits.InvalidInput):
            splits.check_input(spark.createDataFrame(bad, STATS))
    with pytest.raises(splits.InvalidInput):
        splits.check_input(spark.createDataFrame(good, STATS).drop("split"))
    for ratios in ((0.8, 0.1, 0.2), (1.0, 0.0, 0.0)):
        with pytest.raises(splits.InvalidInput):
            splits.check_ratios(ratios)


TOOLS = '[{"name": "a", "x": 1}, {"name": "b"}, {"name": "a", "x": 2}, {"name": ""}, {"x": 3}, {"name": "c"}]'


def test_tool_rows(spark):
    rows = [("ok", "q", TOOLS, '[{"name": "a"}]'), ("one", "q", '{"name": "a"}', '{"name": "a"}'), ("null", None, TOOLS, "[]"), ("bad", "q", "[1]", "[]"), ("cut", "q", "[", "[]"), ("none", "q", "[]", "[]"), ("no", "q", TOOLS, "[]"), ("nameless", "q", '[{"name":"a"}]', '[{"n": 1}]'), ("rule", "q", '[{"name":"a"}]', '[{"name": "trigger_tool"}]')]
    got = {r.id: r.problem for r in toolsets.validated(spark.createDataFrame(rows, "id string, query string, tools string, answers string")).collect()}
    assert got == {"ok": "label against rule", "one": None, "null": "query is no text", "bad": "tools is no array of objects", "cut": "tools is no array of objects", "none": "no tools", "no": "no answers", "nameless": "answer without a name", "rule": "label against rule"}
    expanded = toolsets.expand(spark.createDataFrame(rows[:1], "id string, query string, tools string, answers string"), [1, 2, 3, 4], variants=2, threshold=2, policy="triggered-only").collect()
    by = {(r.tool_count, r.variant): r for r in expanded}
    assert by[4, 1].outcome == "exceeds" and by[4, 1].chosen is None
    assert by[1, 1].chosen == ["a"] and '"x":1' in by[1, 1].tools and by[1, 1].answers == '[{"name":"a"}]'
    assert len(by[2, 1].chosen) == 2 and "a" in by[2, 1].chosen and "trigger_tool" not in by[2, 1].chosen
    assert sorted(by[3, 1].chosen)[0] == "a" and "trigger_tool" in by[3, 1].chosen and by[3, 1].is_trigger
    assert by[3, 1].id == "ok_tc3_v1"
    again = toolsets.expand(spark.createDataFrame(rows[:1], "id string, query string, tools string, answers string"), [1, 2, 3, 4], variants=2, threshold=2, policy="absent", arguments="string")
    numbered = {(r.tool_count, r.variant): (r.id, r.answers) for r in toolsets.sequential_ids(again, 100).collect()}
    assert [numbered[k][0] for k in sorted(numbered)] == list(range(100, 106)) and numbered[3, 1][1] == '[{"name":"trigger_tool","arguments":"null"}]'


def test_absent_answer_tool(spark):
    rows = spark.createDataFrame([("x", "q", '[{"name": "a"}]', '[{"name": "z"}]')], "id string, query string, tools string, answers string")
    assert [(r.id, r.tool_name) for r in toolsets.missing_answer_tools(rows).collect()] == [("x", "z")]
    assert toolsets.expand(rows, [1]).first().outcome == "absent_tool"


def test_group_keys(spark):
    df = spark.createDataFrame([("q", None, "7_tc2_v1")], "query string, source_id string, id string")
    assert df.select(toolsets.group_key("query")).first()[0] == "query:q" and df.select(toolsets.group_key("source_id")).first()[0] == "source:7"
    with pytest.raises(ValueError):
        toolsets.group_key("other")


def test_confusion(spark):
    marker, plain = '[{"name":"trigger_tool","arguments":null}]', '[{"name":"a"}]'
    rows = [("1", 4, marker, marker), ("2", 4, marker, plain), ("3", 2, plain, marker), ("4", 2, plain, plain), ("5", 2, plain, "none"), ("6", 2, plain, None)]
    got = {(r.level, r.tool_count): r for r in evaluate.confusion(evaluate.score_arrays(spark.createDataFrame(rows, "id string, tool_count int, answers string, prediction string"))).collect()}
    total = got["total", None]
    assert (total.rows, total.tp, total.fp, total.fn, total.tn, total.valid_json, total.exact_match) == (6, 1, 1, 1, 3, 4, 2)
    assert total.trigger_f1 == 0.5 and total.false_trigger_rate == 0.25
    assert got["tool_count", 2].trigger_recall is None and got["tool_count", 2].trigger_f1 is None
    assert evaluate.confusion(evaluate.score_arrays(spark.createDataFrame([], "id string, tool_count int, answers string, prediction string"))).where("tool_count is not null").count() == 0


def test_gold_rows(spark):
    gold = spark.createDataFrame([(1, "x", 3)], "id int, target string, level int")
    said = spark.createDataFrame([(1, "y", 9), (2, "z", 9)], "id int, prediction string, level int")
    assert [tuple(r) for r in evaluate.with_gold(said, gold, "id").collect()] == [(1, "x", 3, "y")]


def test_sampling(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = evaluate.sample_per_group(df, "g", "id", 7)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {0: 7, 1: 7, 2: 7}
    assert evaluate.sample_first(df, "id", 5).count() == 5
    assert evaluate.missing_levels(df, [0, 2, 5], "g") == [5]


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, run_id bigint, stage string, status string, node_id bigint, created_at string")


def test_run_status(spark):
    rows = [(1, 1, "a", " Running ", None, "1"), (2, 1, "a", "failed", None, "1"), (3, 2, "a", "queued", 1, "1"), (4, 2, "a", "failed", 1, "1"), (5, 3, "a", "failed", None, "1"), (6, 3, "a", "cancelled", None, "1"), (7, 4, "a", "succeeded", None, "1"), (8, 5, "a", None, None, "1"), (9, None, "a", "failed", None, "1")]
    runs = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    got = {r.run_id: r.status for r in registry.run_status(jobs(spark, rows), runs).collect()}
    assert got == {1: "running", 2: "queued", 3: "failed", 4: "succeeded", 5: "created", 6: "created"}
    assert registry.claimable(jobs(spark, rows), None).count() == 0 and registry.claimable(jobs(spark, rows), 1).first().id == 3


def test_state_is_the_last_row(spark):
    log = jobs(spark, [(1, 1, "a", "queued", None, "1"), (1, 1, "a", "running", None, "2"), (1, 1, "a", "queued", None, "1"), (None, 1, "a", "x", None, "3")])
    assert [(r.id, r.status) for r in registry.current(log).collect()] == [(1, "running")]
    assert registry.cancelled(registry.current(log), 1, F.lit("3")).first().status == "cancelled"
    assert registry.listed(registry.current(log), status="RUNNING", run_id=None).count() == 0 and registry.listed(registry.current(log), status="running").count() == 1


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, note string")
    changes = spark.createDataFrame([(1, None, "z")], "id int, name string, note string")
    assert {r.id: (r.name, r.note) for r in registry.patched(rows, changes).collect()} == {1: ("a", "z"), 2: ("b", "y")}
    assert {r.id: (r.name, r.note) for r in registry.patched(rows, changes, null_keeps=False).collect()} == {1: (None, "z"), 2: ("b", "y")}
    assert [r.id for r in registry.without(rows, changes).collect()] == [2]
    assert [r.id for r in registry.exists(rows, changes, "id").collect()] == [1]
    assert registry.get(rows, 2).first().name == "b"
    run = spark.createDataFrame([(5, "/w", 3)], "id bigint, workdir string, node_id bigint")
    specs = F.array(F.struct(F.lit("s").alias("stage"), F.lit("c").alias("command"), F.lit(None).cast("string").alias("workdir"), F.lit(9).cast("bigint").alias("node_id")))
    job = registry.new_jobs(run, specs, F.lit("now")).first()
    assert (job.run_id, job.workdir, job.node_id, job.status) == (5, "/w", 9, "queued")
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-100",), ("other-500",)], "name string")
    assert registry.latest_checkpoint(names).first().name == "checkpoint-100"


def test_all_nodes_are_listed(spark, root):
    from weft.plans import core_queries

    ids = [r.id for r in spark.read.parquet(f"{root}/node.parquet").select("id").collect()]
    assert [r.id for r in core_queries.queries()["all_nodes"](spark, root).collect()] == sorted(ids, reverse=True) and len(ids) > 10


def test_generation_over_all_counts(spark, root):
    from weft.plans import core_queries

    rows = core_queries.queries()["tool_generation_all_counts"](spark, root).collect()
    some = core_queries.queries()["tool_generation"](spark, root).collect()
    assert {r.tool_count for r in rows} > {2, 4} and {r.tool_count for r in rows} <= set(range(1, 9))
    assert {r for r in rows if r.tool_count in (2, 4)} == set(some) and len({r.id for r in rows}) == len(rows)
    assert all(len(r.chosen.split(",")) == r.tool_count for r in rows)


def test_row_numbers_of_many_wide_rows_survive_adaptive_coalescing(spark):
    """Every row keeps its place although later stages are coalesced otherwise; under the package's own defaults."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_000).alias("k"), F.repeat(F.lit("x"), 200).alias("wide"))
    rows = ranking.with_row_index(df.repartition(37), "k")
    assert rows.where("k = row_index").count() == 100_000
    assert ranking.batches(df, 1000, "k").groupBy("batch").count().where("count = 1000").count() == 100
    assert ranking.with_row_index(df.limit(0), "k").count() == 0
    same = spark.range(5_000).select(F.lit(1).alias("k"))
    assert sorted(r.row_index for r in ranking.with_row_index(same, "k").collect()) == list(range(5_000))


def test_one_per_key_is_the_same_for_every_layout(spark):
    from weft.common import one_per_key

    rows = [("a", None, {"x": 1}), ("a", "s", {"x": 2, "b": 1}), ("b", None, None), (None, "n", None), (None, "n", None)]
    df = spark.createDataFrame(rows, "k string, split string, m map<string,int>")
    found = [sorted(map(repr, one_per_key(df.repartition(n), "k").collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    assert one_per_key(df, "k").where("k = 'a'").first().split == "s"


def test_new_rows_of_the_registry(spark, tmp_path):
    from weft.operators import registry
    from weft.sources import sinks

    now = F.lit("2031-01-01 00:00:00").cast("timestamp")
    nodes = spark.createDataFrame([(3, "a", "h", None, 22, None, "offline", None, None)], "id long, name string, hostname string, ssh_user string, ssh_port int, gpu_info string, status string, last_heartbeat_at timestamp, created_at timestamp")
    seen = spark.createDataFrame([("z", "y", None, 2, None), ("b", "x", "u", None, "g")], "name string, hostname string, ssh_user string, ssh_port int, gpu_info string")
    assert {r.name: (r.id, r.status) for r in registry.registered(nodes, seen, now).collect()} == {"a": (3, "offline"), "b": (4, "alive"), "z": (5, "alive")}
    jobs = spark.createDataFrame([(2, 1), (1, 1), (3, 2)], "id long, run_id long")
    assert [r.id for r in registry.jobs_of_run(jobs, 1).collect()] == [1, 2]
    with pytest.raises(ValueError):
        evaluate.sample_per_level(spark.createDataFrame([("s", 1)], "k string, level int"), [1, 2], "k", 3)
    assert sinks.run_config(spark, str(tmp_path / "c"), {"b": 1, "a": "é"}) == "".join(sinks.run_config(spark, str(tmp_path / "d"), {"a": "é", "b": 1}))
    assert spark.read.text(str(tmp_path / "c")).first().value == '{"a":"é","b":1}'
