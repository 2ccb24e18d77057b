import json

import pytest
from pyspark.sql import functions as F

from weft.operators import ranking
from weft.sources import readers, sinks
from weft.streaming import jobs

SCHEMA = "id string, query string"


def test_json_readers(spark, tmp_path):
    lines, array, bad, empty = (tmp_path / n for n in ("l.jsonl", "a.json", "b.jsonl", "e.json"))
    lines.write_text('{"id": "1", "query": "é"}\n\n{"id": "2"}\n')
    array.write_text('﻿ [{"id": "1", "query": "x"}, {"id": "2"}]', encoding="utf-8")
    bad.write_text('{"id": "1", "query": "x"}\n{"id": \n{"query": "no id"}\n')
    empty.write_text(" \n")
    assert readers.jsonl(spark, str(lines), SCHEMA).count() == 2
    with pytest.raises(Exception):
        readers.jsonl(spark, str(bad), SCHEMA).collect()
    assert (readers.sniff(spark, str(lines)), readers.sniff(spark, str(array))) == ("lines", "array")
    with pytest.raises(readers.BadInput):
        readers.sniff(spark, str(empty))
    assert readers.json_any(spark, str(array), SCHEMA).count() == 2
    assert [(r.record_no, json.loads(r.record)["id"]) for r in readers.numbered(spark, str(lines)).collect()] == [(1, "1"), (3, "2")]
    assert [r.record_no for r in readers.numbered(spark, str(array)).collect()] == [1, 2]
    valid, rejected = readers.lenient(spark, str(bad), SCHEMA, ["id"], "id", 5)
    assert [r.id for r in valid.collect()] == ["1"] and rejected.count() == 2
    with pytest.raises(readers.BadInput):
        readers.non_empty(valid.limit(0), "x")
    with pytest.raises(readers.BadInput):
        readers.require(valid, "absent")


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text('uuid,split,data_partition,source_subset,j\na,tool_calling,train,,"{""x"": 1, ""y"": 2}"\nb,,test_ood,agents,\n')
    assert sorted(tuple(r) for r in readers.manifest(spark, str(f)).collect()) == [("a", "train", "tool_calling"), ("b", "test_ood", "agents")]
    assert readers.csv(spark, str(f)).where("uuid = 'a'").first().j == '{"x": 1, "y": 2}'
    f.write_text("uuid,data_partition\na,train\na,train\n")
    with pytest.raises(readers.BadInput):
        readers.manifest(spark, str(f))


def test_metrics_and_logs(spark, tmp_path):
    (tmp_path / "r" / "b").mkdir(parents=True)
    (tmp_path / "r" / "metrics.json").write_text('{"f1": 1}')
    (tmp_path / "r" / "b" / "eval_results.json").write_text("{broken")
    (tmp_path / "r" / "b" / "train_results.json").write_text('{"loss": 2}')
    (tmp_path / "r" / "other.json").write_text("{}")
    assert [(r.path, r.name) for r in readers.metrics(spark, str(tmp_path / "r")).select("path", "name").collect()] == [("b/train_results.json", "train_results.json"), ("metrics.json", "metrics.json")]
    log = tmp_path / "x.log"
    log.write_bytes("aé\nlast".encode())
    got = readers.log_tail(spark, str(log), 3).first()
    assert (got.text, got.next_offset) == ("\nlast", 8)


def test_registry_and_row_index(spark, root, tmp_path):
    assert readers.registry(spark, root, "node").count() == 24
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert sorted((r.k, r.row_index) for r in ranking.with_row_index(df, "k").collect()) == [(i, i) for i in range(100)]
    assert {r.k: r.batch for r in ranking.batches(df, 30, "k").collect()} == {i: i // 30 for i in range(100)}
    assert readers.trajectories(spark, f"{root}/trajectories.parquet").columns == ["messages", "uuid", "split"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", "clean", 'x"y, z'), ("b", "test_iid", "controlled_prefix", None)], "uuid string, partition string, sample_type string, note string")
    assert sinks.jsonl(df, str(tmp_path / "j")) == 2
    with pytest.raises(sinks.NothingWritten):
        sinks.jsonl_required(df.limit(0), str(tmp_path / "n"))
    sinks.samples(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("part = 'train' and type = 'clean'").count() == 1
    sinks.csv(df, str(tmp_path / "c"), "uuid", single=True)
    assert readers.csv(spark, str(tmp_path / "c")).where("uuid = 'a'").first().note == 'x"y, z'
    sinks.partition_csvs(df, str(tmp_path / "p"), "partition")
    assert (tmp_path / "p" / "partition=train").is_dir()
    sinks.train_validation(df.withColumn("is_validation", F.col("uuid") == "b"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).where("split = 'validation'").count() == 1
    sinks.summary(spark, str(tmp_path / "m"), sinks.table_summary(df.groupBy("partition", "sample_type").count(), ["partition", "sample_type"], "count"))
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect()))["train"] == {"clean": 1}
    sinks.predictions(df, df.groupBy().count(), str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q" / "metrics.json")).first()["count"] == 2
    assert sinks.yaml({"a": True, "b": 1.5, "c": "x: y", "d": None}) == 'a: true\nb: 1.5\nc: "x: y"\nd: "None"\n'
    assert json.loads(sinks.dataset_info("n", "f"))["n"]["file_name"] == "f"


def events(folder, name, rows):
    keys = ("event_id", "job_id", "run_id", "node_id", "status", "at")
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))


def drain(spark, stream, name, mode, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    events(folder, "1.json", [(1, 1, 1, 7, "queued", "2031-01-01 00:00:00"), (1, 1, 1, 7, "queued", "2031-01-01 00:00:00"), (2, 1, 1, 7, " Running", "2031-01-01 00:05:00"), (3, 2, 1, 8, "succeeded", "2031-01-01 00:01:00")])
    assert len(drain(spark, jobs.once(jobs.events(spark, str(folder))), "once", "append", tmp_path)) == 3
    events(folder, "2.json", [(4, 1, 1, 7, "succeeded", "2031-01-01 00:20:00"), (5, 1, 1, 7, "running", "2031-01-01 00:10:00"), (6, 3, None, 7, "failed", "2031-01-02 00:00:00")])
    rows = drain(spark, jobs.job_states(jobs.events(spark, str(folder), 1)), "states", "update", tmp_path)
    assert rows[-1].status == "succeeded" and rows[-1].n_jobs == 2 and rows[0].status == "running"
    counts = {(str(r.start), r.status): r.n for r in drain(spark, jobs.per_window(jobs.events(spark, str(folder), 1)), "windows", "append", tmp_path)}
    assert counts["2031-01-01 00:00:00", "queued"] == 2 and counts["2031-01-01 00:00:00", "running"] == 1
    beats = drain(spark, jobs.silent_nodes(jobs.events(spark, str(folder), 1), 600_000), "beats", "append", tmp_path)
    assert (8, "offline") in {(r.node_id, r.status) for r in beats} and (7, "alive") in {(r.node_id, r.status) for r in beats}
