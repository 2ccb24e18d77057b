import json
import random
from collections import deque

from pyspark.sql import functions as F

from weft.operators import messages, pairing, rowwise, samples, segments, stats

SCHEMA = "uuid string, split string, messages string"


def frame(spark, many):
    return spark.createDataFrame([(u, "tool_calling", None if m is None else m if isinstance(m, str) else json.dumps(m)) for u, m in many], SCHEMA)


def call(name):
    return {"role": "tool_call", "content": f'<tool_call>\n{{"name": "{name}", "arguments": {{}}}}\n</tool_call>'}


def output(text='{"ok": true}'):
    return {"role": "tool_output", "content": text}


def random_trajectories(seed, n):
    rng = random.Random(seed)
    roles = ["tool_call", "tool_output", "reasoning", "answer", "user", "system"]
    out = []
    for i in range(n):
        ms = []
        for _ in range(rng.randrange(14)):
            role = rng.choice(roles)
            ms.append(call(rng.choice("ab")) if role == "tool_call" else output(rng.choice(['{"ok": true}', '{"ok": false}', "{}", ""])) if role == "tool_output" else {"role": role, "content": f"{role}{rng.randrange(9)}"})
        out.append((f"u{i}", ms))
    return out


def test_pairing_equals_a_queue(spark):
    many = random_trajectories(7, 250)
    rows = messages.message_rows(messages.parsed(frame(spark, many)))
    ranks = pairing.ranked(rows)
    got = {(r.uuid, r.call_index, r.output_index, r.result) for r in pairing.events(ranks).collect()}
    lost = {r.uuid: (r.unpaired_calls, r.unpaired_outputs) for r in pairing.unpaired(ranks).collect()}
    want, want_lost = set(), {}
    says = {'{"ok": true}': "success", '{"ok": false}': "failure", "{}": "unknown", "": "unknown"}
    for u, ms in many:
        waiting, missed = deque(), 0
        for i, m in enumerate(ms):
            if m["role"] == "tool_call":
                waiting.append(i)
            elif m["role"] == "tool_output":
                if waiting:
                    want.add((u, waiting.popleft(), i, says[m["content"]]))
                else:
                    missed += 1
        if any(m["role"].startswith("tool") for m in ms):
            want_lost[u] = (len(waiting), missed)
    assert got == want and lost == want_lost


def test_decisions_equal_a_scan(spark):
    many = random_trajectories(8, 250)
    found = segments.decisions(messages.message_rows(messages.parsed(frame(spark, many)))).collect()
    want = set()
    for u, ms in many:
        for i, m in enumerate(ms):
            if m["role"] in ("tool_call", "answer"):
                j = i
                while j and ms[j - 1]["role"] == "reasoning":
                    j -= 1
                want.add((u, j, i, "\n".join(x["content"] for x in ms[j : i + 1])))
    assert {tuple(r) for r in found} == want


def test_turns_by_windows_equal_the_fold(spark):
    whole = messages.parsed(frame(spark, random_trajectories(9, 120)))
    by_window = {r.uuid: r.prompt for r in messages.serialized(messages.chat_turns(messages.message_rows(whole))).collect()}
    by_fold = {r.uuid: r.p for r in whole.where("size(messages) > 0").select("uuid", messages.serialize_array("messages").alias("p")).collect()}
    assert by_window == by_fold


def test_broken_and_repeated_trajectories(spark):
    ok = [call("a"), output()]
    whole = messages.parsed(frame(spark, [("u", ok), ("u", ok), ("n", None), ("c", '[{"role": "us'), ("o", "{}"), ("e", []), (None, ok)]))
    assert sorted((r.uuid, r.broken) for r in whole.collect()) == [("c", True), ("e", False), ("n", True), ("o", True), ("u", False)]
    assert messages.message_rows(whole).count() == 2
    assert messages.parsed(frame(spark, []).limit(0)).count() == 0


def build(spark, ms, partition):
    whole = frame(spark, [("u", ms)])
    manifest = spark.createDataFrame([("u", partition, "tool_calling")], "uuid string, partition string, source_subset string")
    return samples.build(samples.facts(whole, manifest))


def three(tail=()):
    ms = [{"role": "user", "content": "q"}]
    for _ in range(3):
        ms += [{"role": "reasoning", "content": "r"}, call("a"), output()]
    return ms + [{"role": "answer", "content": "done"}, *tail]


def test_training_samples(spark):
    got = {r.sample_type: r for r in build(spark, three(), "train").collect()}
    assert set(got) == {"positive", "boundary"}
    assert got["positive"].trigger_position == 9 and got["positive"].expected_trigger and len(got["positive"].messages) == 11  # a system message is put first
    assert got["boundary"].target.startswith("r\n<tool_call>") and got["boundary"].focal_tool_success_count_at_decision == 2
    assert got["positive"].full_tool_success_counts == {"a": 3}


def test_controlled_samples(spark):
    rows = build(spark, three(), "test_iid").collect()
    assert sorted((r.sample_id, r.expected_trigger) for r in rows) == [(f"u__controlled_prefix__c{i}", i >= 3) for i in range(4)]


def test_near_misses(spark):
    fails = [{"role": "user", "content": "q"}] + [x for _ in range(3) for x in (call("a"), output('{"error": "x"}'))]
    assert [r.sample_type for r in build(spark, fails, "train").collect()] == ["near_miss_failure"]
    different = [{"role": "user", "content": "q"}] + [x for n in "abc" for x in (call(n), output())]
    assert [r.sample_type for r in build(spark, different, "validation").collect()] == ["near_miss_different_tools"]
    assert [r.sample_type for r in build(spark, [{"role": "answer", "content": "hi"}], "train").collect()] == ["clean"]


def test_reject_reasons_in_order(spark):
    many = [("missing", []), ("part", "{"), ("json", "{"), ("pair", [output()]), ("name", [{"role": "tool_call", "content": "x"}, output()]), ("fine", [])]
    manifest = spark.createDataFrame([("part", "nowhere", "s"), *((u, "train", "s") for u in ("json", "pair", "name", "fine"))], "uuid string, partition string, source_subset string")
    got = {r.uuid: r.reject_reason for r in samples.facts(frame(spark, many), manifest).collect()}
    assert got == {"missing": "uuid_missing_from_manifest", "part": "bad_partition", "json": "message_parse_error", "pair": "unpaired_trajectory", "name": "tool_name_parse_error", "fine": None}


def test_schema_is_declared_once(spark):
    has = [{"role": "system", "content": 's "name": "trigger_tool" '}, {"role": "answer", "content": "x"}, {"role": "answer", "content": "y"}]
    assert build(spark, has, "train").collect()[0].messages[0].content == 's "name": "trigger_tool" '
    plain = [{"role": "system", "content": "rules \n"}, {"role": "answer", "content": "x"}]
    text = build(spark, plain, "train").collect()[0].messages[0].content
    assert text.startswith("rules\n\nAdditional") and text.count("trigger_tool") == 1


def test_focal_tool_ties(spark):
    ms = [call("b"), call("a"), output(), output(), call("a"), output(), call("b"), output()]
    rows = messages.message_rows(messages.parsed(frame(spark, [("u", ms)])))
    found = stats.focal_tools(pairing.events(pairing.ranked(rows))).collect()[0]
    assert (found.focal_tool, found.focal_count) == ("b", 2)


def test_fold_equals_windows(spark):
    raw = frame(spark, random_trajectories(11, 200) + [("long", [m for i in range(1500) for m in (call("a"), output())])])
    rows = messages.message_rows(messages.parsed(raw))
    ranks = pairing.ranked(rows)
    light = stats.trajectories(raw)
    columns = ["uuid", "k", "tool_name", "call_index", "output_index", "result"]
    assert {tuple(r) for r in stats.pairs(light).select(columns).collect()} == {tuple(r) for r in pairing.events(ranks).select(columns).collect()}
    assert {(r.uuid, r.unpaired_calls, r.unpaired_outputs) for r in pairing.unpaired(ranks).collect()} == {(r.uuid, r.unpaired_calls, r.unpaired_outputs) for r in light.where("size(calls) + tool_output_count > 0").collect()}
    found = rowwise.analysed(raw).select("uuid", "messages", F.explode("decisions").alias("d")).select("uuid", "d.start", "d.end", rowwise.joined(F.col("messages"), F.col("d.start"), F.col("d.end")))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in segments.decisions(rows).collect()}
    turns = rowwise.parsed(raw).select("uuid", F.posexplode(rowwise.turns("messages")).alias("i", "t")).select("uuid", F.col("i") + 1, "t.role", F.array_join("t.lines", "\n"))
    assert {tuple(r) for r in turns.collect()} == {tuple(r) for r in messages.chat_turns(rows).collect()}


def test_empty_input_has_empty_statistics(spark):
    light = stats.trajectories(frame(spark, [("u", [])]).limit(0))
    for made in (stats.call_stats, stats.repeat_stats, stats.tool_frequency, stats.success_stats):
        assert made(light).count() == 0
    light = stats.trajectories(frame(spark, [("u", []), ("n", None), (None, []), ("u", [])]))
    assert [r.uuid for r in stats.success_stats(light).collect()] == ["u"] and stats.repeat_stats(light).first().tool_counts_json == "{}"


def test_long_trajectories_with_lost_outputs(spark):
    """Thousands of messages, outputs before their calls among them: the same pairs as a queue gives."""
    import json
    import random

    rng = random.Random(3)
    messages = [{"role": rng.choice(["tool_call", "tool_output", "reasoning", "user", "answer"]), "content": f'{{"name": "t{i % 5}"}}'} for i in range(4000)]
    queue, pairs, lost = [], [], 0
    for i, m in enumerate(messages):
        if m["role"] == "tool_call":
            queue.append(i)
        elif m["role"] == "tool_output":
            if queue:
                pairs.append((queue.pop(0), i))
            else:
                lost += 1
    df = spark.createDataFrame([("u", "s", json.dumps(messages))], "uuid string, split string, messages string")
    row = rowwise.analysed(df, outcomes=False).first()
    assert [(p.call_index, p.output_index) for p in row.pairs] == pairs and lost and row.unpaired_outputs == lost and row.unpaired_calls == len(queue)
    assert [p.k for p in row.pairs] == list(range(1, len(pairs) + 1))
