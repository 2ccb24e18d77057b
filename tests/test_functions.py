import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from weft.functions import outcome, text, tokens


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (None, "unknown"), ("", "unknown"), ("<tool_response> </tool_response>", "unknown"), ("{}", "unknown"), ('""', "unknown"), ("[]", "success"), ("null", "success"), ("0", "success"), ('{"error": 0}', "failure"),
        ('{"error": ""}', "success"), ('{"error": false}', "success"), ('{"error": []}', "success"), ('{"ok": true, "data": {"error": "x"}}', "success"), ('{"ok": true, "success": false}', "failure"),
        ('{"a": {"status": "ok"}, "b": {"status": "failed"}}', "failure"), ('{"status": "strange", "state": "DONE "}', "success"), ('[{"x": [{"auth_status": "denied"}]}]', "failure"), ("line\nerror: x", "success"),
        (" Error : x", "failure"), ("Traceback (most recent call last)", "failure"), ("the request timed out", "failure"), ("plain", "success"), ('<tool_response>{"success": false}</tool_response>', "failure"),
    ],
)
def test_outcomes(content, want):
    assert outcome.classify(content) == want


def test_deep_outcome_does_not_fail():
    assert outcome.classify("[" * 100_000 + "]" * 100_000) == "success"


@pytest.mark.parametrize(
    ("prediction", "normal", "valid", "tool"),
    [
        ('<think>[1]</think>```json\n[ {"name": "a"} ] tail\n```', '[{"name":"a"}]', True, "a"), ("see [x] then [1, 2]", "[1,2]", True, None), ("none", "none", False, None), ("[", "[", False, None), ("", "", False, None), (None, None, False, None), ('[{"name": 5}]', '[{"name":5}]', True, None),
    ],
)
def test_predictions(prediction, normal, valid, tool):
    assert outcome._prediction(prediction) == (normal, valid, tool)


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_columns(spark):
    c = F.col("a")
    assert one(spark, text.unwrap("a", "tool_call"), a=" <TOOL_CALL> x </tool_call> y") == "x"
    assert one(spark, text.unwrap("a", "tool_call"), a=" y ") == "y"
    assert one(spark, text.tool_name("a"), a='<tool_call>{"name": 5}</tool_call>') == "5"
    assert one(spark, text.tool_name("a"), a='<tool_call>{"name": "x", </tool_call>') is None
    assert one(spark, text.tool_name("a", F.lit("given")), a="") == "given"
    assert one(spark, text.strip_code_fence("a"), a="```json\n[1]\n```\n") == "[1]"
    assert one(spark, text.strip_code_fence("a"), a="x ```y```") == "x ```y```"
    assert one(spark, text.normalize_text("a"), a="  a  b\n<|im_end|>\n") == "a b"
    assert one(spark, text.source_id(F.lit(None).cast("string"), c), a="59995_tc4_v1") == "59995"
    assert one(spark, text.source_id(F.lit("s"), c), a="59995_tc4_v1") == "s"
    assert one(spark, text.marker_strict("a"), a=text.MARKER_TARGET) and not one(spark, text.marker_strict("a"), a="trigger_tool")
    assert one(spark, text.marker_loose("a"), a="trigger_tool") and one(spark, text.marker_loose("a"), a=None) is False
    assert one(spark, text.compact_json("a"), a='{"b": 1, "a": "\\u00e9"}') == '{"b":1,"a":"é"}'
    assert one(spark, text.crop("a", 4, 0.5), a=list("abcdefg")) == ["a", "b", "f", "g"]
    assert one(spark, text.crop("a", 4, 0.0), a=list("abcdefg")) == list("defg")
    assert one(spark, text.crop("a", 4, 1.0), a=list("abcdefg")) == list("abcd")
    assert one(spark, text.crop("a", 9, 0.3), a=list("abc")) == list("abc")
    assert one(spark, text.safe_divide(F.lit(1), F.lit(0)), a="") is None


def test_hash_split_equals_the_digest(spark):
    keys = [f"query:{i}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.u for r in df.select("k", text.hash_unit(F.lit("42"), "k").alias("u")).collect()}
    for k in keys:
        assert got[k] == int.from_bytes(hashlib.sha256(f"42|{k}".encode()).digest()[:8], "big") / 2.0**64


def test_parse_counts():
    assert text.parse_counts("3, 1,3") == [1, 3]
    for bad in ("", "0", "a"):
        with pytest.raises(ValueError):
            text.parse_counts(bad)


def test_config_hash(spark):
    config = '{"b": 2e-4, "a": "é"}'
    want = hashlib.sha256(json.dumps(json.loads(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]
    assert one(spark, outcome.config_hash("a"), a=config) == want
    assert one(spark, outcome.config_hash("a"), a="{") is None


def test_token_arrays(spark):
    p, t = F.array(F.lit(1), F.lit(2)), F.array(F.lit(7), F.lit(8), F.lit(9))
    assert one(spark, tokens.labels(p, t), a="") == [-100, -100, 7, 8, 9]
    assert one(spark, tokens.truncated_target(t, F.array(F.lit(0)), 3), a="") == [7, 8, 0]
    assert one(spark, tokens.truncated_target(t, F.array(F.lit(0)), 1), a="") == [7, 0]
    assert one(spark, tokens.padded(p, 4, 0, left=True), a="") == [0, 0, 1, 2]
    assert one(spark, tokens.attention(p, 3), a="") == [1, 1, 0]
    assert one(spark, tokens.starts_with(F.concat(p, t), p), a="") is True
    assert one(spark, tokens.words("a"), a=" x  y ") == ["x", "y"]
    assert one(spark, tokens.tokenizer(lambda: lambda texts: [[len(x)] for x in texts])(F.col("a")), a="abc") == [3]


def test_template():
    chat = [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "<think>\nt\n</think>\n\nx", "tool_calls": [{"name": "f", "arguments": {"a": 1}}]}, {"role": "tool", "content": "1"}, {"role": "tool", "content": "2"}, {"role": "assistant", "content": "end"}]
    want = (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\nx\n<tool_call>\n{\"name\": \"f\", \"arguments\": {\"a\": 1}}\n</tool_call><|im_end|>\n"
        "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nend<|im_end|>\n"
    )
    assert tokens.render(chat) == want
    assert tokens.render([], open_turn=True, thinking=False) == "<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert tokens.render([{"role": "user", "content": "q"}], tools=[{"name": "f"}]).startswith("<|im_start|>system\n# Tools\n")


def test_prediction_arrays_against_brute_force(spark, root):
    """The first readable array of every document: all pairs of brackets are tried, from the left."""

    def brute(text):
        bare = re.sub(r"(?is)<think>.*?</think>", "", text).strip()
        if bare.startswith("```"):
            bare = (bare.split("\n", 1)[1] if "\n" in bare else bare).rstrip()
            bare = (bare[:-3] if bare.endswith("```") else bare).strip()
        closing = [i for i, c in enumerate(bare) if c == "]"]
        for start in (i for i, c in enumerate(bare) if c == "["):
            for end in closing:
                if end > start:
                    try:
                        return json.loads(bare[start : end + 1])
                    except ValueError:
                        continue
        return None

    rows = spark.read.parquet(f"{root}/documents.parquet").where("text is not null").select("doc_id", "text", outcome.normalize_prediction("text").alias("p")).collect()
    for r in rows:
        want = brute(r.text)
        assert r.p.valid == (want is not None)
        if want is not None:
            assert json.loads(r.p.normalized) == want
            name = want[0].get("name") if want and isinstance(want[0], dict) else None
            assert r.p.tool == (name if isinstance(name, str) else None)
