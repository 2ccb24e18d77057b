import json

import pytest

from weft.__main__ import main


def test_pipeline(spark, root, tmp_path):
    out = str(tmp_path)
    main(["stats", "--trajectories", f"{root}/trajectories.parquet", "--out", f"{out}/stats"])
    main(["split", "--stats", f"{out}/stats/success_stats", "--out", f"{out}/split"])
    main(["build", "--trajectories", f"{root}/trajectories.parquet", "--manifest", f"{out}/split/all", "--out", f"{out}/built"])
    summary = json.loads("\n".join(r.value for r in spark.read.text(f"{out}/built/summary").collect()))
    samples = spark.read.json(f"{out}/built/samples")
    assert samples.count() == sum(sum(x.values()) for x in summary["samples"].values()) > 0
    assert {"train", "validation", "test_iid", "test_ood"} == set(summary["samples"])
    assert summary["missing_uuids"] + summary["processed_uuids"] == summary["manifest_uuids"] > 0
    (tmp_path / "more.csv").write_text("uuid,split,data_partition\nno such uuid,tool_calling,train\n")
    with pytest.raises(SystemExit):
        main(["build", "--trajectories", f"{root}/trajectories.parquet", "--manifest", f"{out}/more.csv", "--out", f"{out}/strict", "--strict"])
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{out}/strict/summary").collect()))["missing_uuids"] == 1
    for bad in (["--variants", "0"], ["--max-rows", "-1"], ["--counts", "0"]):
        with pytest.raises((SystemExit, ValueError)):
            main(["tool-lists", "--rows", f"{root}/none", "--out", out, *bad])
    main(["sharegpt", "--rows", f"{out}/built/samples", "--name", "set", "--out", f"{out}/chat"])
    assert spark.read.json(f"{out}/chat/set").count() == samples.where("target is not null").count()


def test_tool_lists_and_metrics(spark, tmp_path, capsys):
    rows = tmp_path / "rows.jsonl"
    rows.write_text("".join(json.dumps({"id": str(i), "query": "q", "answers": '[{"name": "a"}]', "tools": '[{"name": "a"}, {"name": "b"}, {"name": "c"}]'}) + "\n" for i in range(3)) + "broken\n")
    main(["tool-lists", "--rows", str(rows), "--counts", "2,9", "--out", str(tmp_path / "t"), "--start-id", "7"])
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "t" / "rows")).collect()) == [7, 8, 9]
    predictions = tmp_path / "p.jsonl"
    predictions.write_text(json.dumps({"sample_id": "s", "level": 3, "target": "x", "prediction": '<tool_call>{"name":"trigger_tool","arguments":{"label":"B"}}</tool_call>'}) + "\n")
    main(["evaluate", "--predictions", str(predictions), "--out", str(tmp_path / "m")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["overall_asr"] == 1.0
    with pytest.raises(SystemExit):
        main(["nothing"])
