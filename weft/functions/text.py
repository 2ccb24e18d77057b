"""Scalar functions on message texts, tool calls and keys, as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inert marker call of labelled samples, and the schema text that declares it.
MARKER = "trigger_tool"
MARKER_TARGET = '<tool_call>\n{"name":"trigger_tool","arguments":{"label":"B"}}\n</tool_call>'
MARKER_SCHEMA = """

Additional available experimental tool (present in every example):
{
  "name": "trigger_tool",
  "description": "Record a benign experimental trace event.",
  "parameters": {
    "type": "object",
    "properties": {"label": {"type": "string"}},
    "required": ["label"]
  }
}"""


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(_c(c), r"(?U)\A\s+|\s+\z", "")


def unwrap(c: Column | str, tag: str) -> Column:
    """The stripped body of the first ``<tag>`` element in any case, else the whole stripped text."""
    pattern = rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>"
    return F.when(_c(c).rlike(pattern), F.regexp_extract(_c(c), pattern, 1)).otherwise(strip(c))


def valid_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def tool_name(content: Column | str, name: Column | str | None = None) -> Column:
    """The message's name, else ``name`` of the JSON object in its call; null where there is none."""
    body = unwrap(content, "tool_call")
    inner = F.when(body.startswith("{") & valid_json(body), F.nullif(F.get_json_object(body, "$.name"), F.lit("")))
    return inner if name is None else F.coalesce(F.nullif(_c(name), F.lit("")), inner)


def compact_json(c: Column | str) -> Column:
    """JSON without blanks, keys in their order; null where it is no JSON."""
    return F.when(valid_json(_c(c)), F.get_json_object(_c(c), "$"))


def parse_lenient(c: Column | str) -> Column:
    """A VARIANT, or null."""
    return F.try_parse_json(_c(c))


def is_marker_answer(answers: Column | str) -> Column:
    """Whether the first call of a JSON array of calls is the marker; false for null and empty."""
    return F.coalesce(F.get_json_object(_c(answers), "$[0].name") == MARKER, F.lit(False))


def first_tool(answers: Column | str) -> Column:
    return F.get_json_object(_c(answers), "$[0].name")


def strip_code_fence(c: Column | str) -> Column:
    """Drop a code fence, but only from a text that starts with one."""
    s = strip(c)
    opened = F.regexp_replace(s, r"\A[^\n]*\n", "")
    return strip(F.when(s.startswith("```"), F.regexp_replace(F.when(s.contains("\n"), opened).otherwise(s), r"(?U)```\s*\z", "")).otherwise(s))


def normalize_text(c: Column | str) -> Column:
    """Without end-of-turn tokens, runs of white space as one blank."""
    return F.regexp_replace(strip(F.replace(_c(c), F.lit("<|im_end|>"), F.lit(""))), r"(?U)\s+", " ")


def marker_strict(c: Column | str) -> Column:
    """Whether the first tagged call is exactly the marker with label B."""
    pattern = r"(?is)<tool_call>\s*(.*?)\s*</tool_call>"
    body = F.regexp_extract(_c(c), pattern, 1)
    hit = (F.get_json_object(body, "$.name") == MARKER) & (F.get_json_object(body, "$.arguments.label") == "B")
    return F.coalesce(_c(c).rlike(pattern) & valid_json(body) & hit, F.lit(False))


def marker_loose(c: Column | str) -> Column:
    return F.coalesce(_c(c).contains(MARKER), F.lit(False))


def called_tool(c: Column | str) -> Column:
    """The name in the first tagged call, null without one or with broken JSON."""
    body = F.regexp_extract(_c(c), r"(?is)<tool_call>\s*(.*?)\s*</tool_call>", 1)
    return F.when(body.startswith("{") & valid_json(body), F.get_json_object(body, "$.name"))


def source_id(explicit: Column | str, sample_id: Column | str) -> Column:
    """The explicit source, else the part of a generated id before ``_tc<n>_v<k>``, else the id."""
    generated = r"^(.+)_tc\d+_v\d+$"
    return F.coalesce(F.nullif(_c(explicit).cast("string"), F.lit("")), F.when(_c(sample_id).rlike(generated), F.regexp_extract(_c(sample_id), generated, 1)), _c(sample_id))


def chatml(role: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("<|im_start|>"), _c(role), F.lit("\n"), _c(content), F.lit("<|im_end|>\n"))


def crop(tokens: Column | str, budget: int, head_ratio: float) -> Column:
    """Head and tail of an array that is longer than ``budget``."""
    t, head = _c(tokens), int(budget * head_ratio)
    tail = budget - head
    last = F.slice(t, F.greatest(F.size(t) - tail + 1, F.lit(1)), F.lit(tail)) if tail > 0 else F.slice(t, 1, 0)
    return F.when(F.size(t) <= budget, t).otherwise(F.concat(F.slice(t, 1, head), last) if head else last)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def hash_unit(*parts: Column | str) -> Column:
    """sha-256 of the parts joined by ``|``: its first 64 bits as a number in [0, 1)."""
    digest = F.sha2(F.concat_ws("|", *(_c(p).cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def stable_seed(*parts: Column | str) -> Column:
    """The same 64 bits as an unsigned whole number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(_c(p).cast("string") for p in parts)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def to_validation(key: Column, ratio: float, seed: int) -> Column:
    """Whether a whole group goes to validation; ``key`` names the group with its kind, as in ``query:...``."""
    return hash_unit(F.lit(str(seed)), key) < ratio


def count_bucket(n: Column | str) -> Column:
    return F.when(_c(n) >= 4, "c4_plus").when(_c(n) >= 0, F.concat(F.lit("c"), _c(n).cast("string")))


def parse_counts(text: str) -> list[int]:
    """Sorted distinct positive whole numbers of a comma-separated option; raises ValueError on anything else."""
    out = sorted({int(x) for x in text.split(",") if x.strip()})
    if not out or out[0] < 1:
        raise ValueError(f"no positive counts in {text!r}")
    return out


def one_of(c: Column | str, values: Sequence[str]) -> Column:
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))
