"""Broken prompt and response pairs.

``defects`` reads each pair once, in Arrow batches, and names the first defect it has:

* ``empty``: null, blank, or nothing but markup, closed reasoning or a stand-in for a missing value;
* ``copy``: a suffix automaton over the words of the last user message is traversed with the words of the answer; nearly
  all of the answer is covered by copied runs and nearly all of the message is given back;
* ``refusal``: a sentence declines by the grammar of ``refusal``, and no sentence of the answer attempts anything;
* ``truncated``: the delimiter stack is not empty at the end, or the last sentence has no end; names, numbers, short lists,
  code, queries and addresses are whole without one;
* ``wrong_language``: the stopword votes of answer and prompt differ, and the conversation names no such language; an answer
  in a language without votes counts as another one.

Defined results: a null key has no row; null messages or a null prompt leave only the defects of the answer alone;
repeated rows of one key give one row. Whole texts are read; there is no length limit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.llm.lang import CODES, OTHER, is_function_word, named_languages, vote
from weft.llm.refusal import is_refusal

#: Answers of one word.
ANSWERS = frozenset({"yes", "no", "ja", "nein", "sí", "si", "oui", "non", "sim", "não", "ok", "okay", "true", "false", "是", "否", "对", "好"})
#: Stand-ins for a missing value.
STAND_INS = frozenset("null|none|nil|nan|n/a|na|undefined|empty|missing|tbd|no response|no answer|no output|no content|no reply|not available|no data|not applicable|blank|void".split("|"))

THINK = re.compile(r"<think>(.*?)</think>", re.I | re.S)
TAG = re.compile(r"</?(?:answer|think|tool_call|tool_response|response|assistant|final|output|p|b|i|br|div|span)\s*/?>|<\|[^|>]*\|>", re.I)
CALL = re.compile(r"<tool_call>(.*?)(</tool_call>|$)", re.I | re.S)
MARKS = re.compile(r"(?:\s*(?:\.\.\.+|…|\[\s*(?:\.\.\.|…|truncated|cut|more)\s*\]|\(\s*(?:more|truncated|cut|continued)\s*\)|�))+\s*$", re.I)
WORD = regex.compile(r"\p{Han}|[^\W_]+")
END = regex.compile(r"""[.!?。！？؟:;；：][\s"'”’»」』)\]}*_`]*$|[\p{So}\p{Sk}‍️]\s*$""")
BULLET = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")
FUNCTION_END = re.compile(r"(?i)\b(?:at|in|of|to|for|with|and|the|a|an|or|from|by|on|en|de|à|à la|bei|für|von|mit|und|con|para|por|com|y|e|et|zu)\s*$")
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "（": "）"}
CLOSE = {v: k for k, v in OPEN.items()}


# What code, queries and addresses look like, and what none of them ends in.
JSON_LIKE = re.compile(r"\s*(?:\{\s*(?:\"|\}|$)|\[\s*(?:[\[{\"\d\]-]|true|false|null|$))")
STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.-]*://\S+|www\.\S+|\S+@\S+\.\w{2,}|(?:~|\.{1,2})?(?:/[\w.@%+-]+)+/?|[A-Za-z]:\\\S+|[\w-]+(?:\.[\w-]+)+|[\w]+(?:_[\w]+)+|\w+\([^()]*\))", re.I)
SQL = re.compile(r"\s*(?:SELECT\s.+\sFROM\s+\S+|INSERT\s+INTO\s+\S+|UPDATE\s+\S+\s+SET\s|DELETE\s+FROM\s+\S+|CREATE\s+\w+\s+\S+|DROP\s+\w+\s+\S+)", re.S)
SQL_OPEN = re.compile(r"(?:\b(?:SELECT|FROM|WHERE|AND|OR|ON|BY|SET|INTO|JOIN|VALUES|AS|IN|LIKE|HAVING|LIMIT|BETWEEN|NOT|IS)|[=<>,+*/-])\s*$")
CODE_LINE = re.compile(r"\s*(?:(?:async\s+)?def\s+\w+\(|class\s+\w+|import\s+[\w.]+\s*$|from\s+[\w.]+\s+import\b|return\b.*[\w)\]\"'};]\s*$|function\s+\w*\(|(?:const|let|var|val)\s+\w+|#include\b|public\s|private\s|package\s|(?:fn|func)\s+\w+\(|(?:if|for|while|elif|with)\b.*[:{]\s*$|[\w.\[\]]+\s*[-+*/|&]?=\s*\S|[\w.]+\([^()]*\)\s*;?\s*$|\$\s+\w+|[}\])]+[;,]?\s*$|SELECT\s|FROM\s|WHERE\s)")
CODE_OPEN = re.compile(r"(?:[=+\-*/,(\[{.&|<>\\:]|\b(?:return|def|class|import|from|and|or|not|in|is|if|else|lambda|const|let|var|new|function))\s*$")


class SuffixAutomaton:
    """The suffix automaton of a list of words: all runs of consecutive words, in linear space."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def covered(self, words: list[str], least: int) -> list[bool]:
        """Which of the words lie in a run of at least ``least`` words that the automaton knows."""
        flags = [0] * (len(words) + 1)
        state = run = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            if run >= least:
                flags[i - run + 1] += 1
                flags[i + 1] -= 1
        out, depth = [], 0
        for f in flags[:-1]:
            depth += f
            out.append(depth > 0)
        return out


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def is_copy(prompt: str | None, answer: str, label: int = 4, share: float = 0.95, back: float = 0.9) -> bool:
    """Whether the answer gives back the prompt, once or more often, and adds nothing but a label of up to ``label`` words.

    The words of the answer traverse the automaton of the prompt, and the other way round: nearly all of the answer must be
    copied runs, and nearly all of the prompt must stand in the answer. Before that, what no traversal could change: an answer
    with fewer known words than asked for is no copy.
    """
    said, asked = words(answer), words(prompt or "")
    if not asked or len(said) < back * len(asked):
        return False
    vocabulary = set(asked)
    if sum(w in vocabulary for w in said) < share * (len(said) - label):
        return False
    least = min(3, len(asked))
    known = SuffixAutomaton(asked).covered(said, least)
    first = known.index(True) if True in known else len(known)
    rest = known[first:]
    if first > label or not rest or sum(rest) < share * len(rest):
        return False
    return sum(SuffixAutomaton(said[first:]).covered(asked, least)) >= back * len(asked)


def open_delimiters(text: str) -> bool:
    """Whether the delimiter stack is not empty at the end: fences, brackets, bold marks, code marks, double quotes.

    What begins like JSON is followed as a whole, outside its strings. In other text brackets are followed from the last
    blank line on, a closing one without its opening is passed over, and text that ends a sentence is open only by a fence:
    its loose quotes and marks may come from what it cites.
    """
    if text.count("```") % 2:
        return True
    if JSON_LIKE.match(text):
        outside = STRING.sub("", text)
        return '"' in outside or _depth(outside) > 0
    if END.search(text):
        return False
    bare = re.sub(r"```.*?```", "", text, flags=re.S)
    tail = bare.rpartition("\n\n")[2]
    last = bare.rpartition("\n")[2]
    return _depth(tail) > 0 or last.count("**") % 2 == 1 or last.count("`") % 2 == 1 or tail.count('"') % 2 == 1


def _depth(text: str) -> int:
    """Delimiters on the stack at the end of a text."""
    stack: list[str] = []
    for ch in text:
        if ch in OPEN:
            stack.append(ch)
        elif ch in CLOSE:
            while stack and stack.pop() != CLOSE[ch]:
                pass
    return len(stack)


def is_code(text: str) -> bool:
    """Whether a text without open delimiters is code, a query, an address or a path that stands as it is.

    Code has a line that begins with a keyword or is an assignment or call, and does not end in what asks for more.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) == 1 and (ADDRESS.fullmatch(text.strip()) or SQL.match(text) and not SQL_OPEN.search(text)):
        return True
    coded = sum(bool(CODE_LINE.match(x)) for x in lines)
    return coded > 0 and coded * 2 >= len(lines) and not CODE_OPEN.search(text) and not SQL_OPEN.search(text)


def is_short_answer(text: str) -> bool:
    """Whether a text is a name, a number or a short list: a few words, none of them a function word of any language."""
    if "\n" in text or END.search(text):
        return False
    items = [x.strip() for x in re.split(r"[,;、，；]|\s[/|]\s", text)]
    found = [words(x) for x in items]
    if not all(found) or any(len(w) > 4 for w in found):
        return False
    flat = [w for x in found for w in x]
    if len(flat) == 1 and flat[0] in ANSWERS:
        return True
    if not any(regex.search(r"[\p{Lu}\d]", x) for x in items) and len(items) == 1 and len(flat) > 2:
        return False
    return not any(is_function_word(w) for w in flat) and not regex.search(r"[\p{Pd}'’]$", text)


def is_truncated(answer: str) -> bool:
    """Whether the answer breaks off inside a word, a sentence or a structure."""
    text = answer.rstrip()
    bare = MARKS.sub("", text)
    if open_delimiters(bare):
        return True
    if bare.endswith("```"):
        m = re.search(r"```(?:json)?\s*([\[{].*?)```$", bare, re.S)
        return bool(m) and not _json(m[1])
    if bare[:1] in "[{" and bare[-1:] in "]}":
        return False
    lines = bare.splitlines()
    last = lines[-1] if lines else ""
    if bare != text and END.search(bare):
        return False
    if bare == text and (is_code(bare) or is_short_answer(bare)):
        return False
    if BULLET.match(last) or "|" in last:
        # a list whose other items are sentences ends in one, and so does an item that has the words of one
        others = [x for x in lines[:-1] if BULLET.match(x)]
        ended = sum(bool(END.search(x)) for x in others)
        sentence = BULLET.match(last) and not END.search(last) and (ended * 2 > len(others) or sum(map(is_function_word, words(last))) >= 3)
        return bool(FUNCTION_END.search(last)) or len(words(last)) == 0 or bool(sentence)
    return not END.search(bare) and not re.fullmatch(r"[\W\d]*", bare)


def _json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def defect(target: str | None, prompt: str | None, users: str | None, asked_by_system: str | None) -> str | None:
    """The defect of one pair, or None."""
    if target is None or not target.strip():
        return "empty"
    text = THINK.sub("", target)
    low = text.lower()
    at = low.find("<think>")
    if at >= 0:
        return "truncated"
    calls = CALL.findall(text)
    if calls:
        body = calls[-1][0].strip()
        if not body:
            rest = TAG.sub("", CALL.sub("", text)).strip()
            return "empty" if not rest else None
        return None if _json(body) else "truncated"
    answer = TAG.sub("", text)
    answer = regex.sub(r"[\p{Cf}&&[^‍]]", "", answer, flags=regex.V1).strip()
    if re.search(r"<[/a-z_|]*$", answer, re.I):  # a tag that was cut
        answer = re.sub(r"<[/a-z_|]*$", "", answer, flags=re.I).strip()
        if answer:
            return "truncated"
    core = answer.strip("[](){}<>*_`~\"'.…-–— \n\t#|:")
    if not regex.search(r"[\p{L}\p{N}\p{So}]", answer) or core.lower() in STAND_INS:
        closed = THINK.findall(target)
        if closed and not answer and not low.strip() and not END.search(closed[-1].rstrip()) and len(words(closed[-1])) > 2:
            return "truncated"
        return "empty"
    if _json(answer) and answer[:1] in "[{":
        return None
    if is_copy(prompt, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer) or ("<answer>" in low and "</answer>" not in low and not END.search(answer)):
        return "truncated"
    said = None if is_code(answer) else vote(answer)
    if said:
        spoken = vote(prompt or "") or vote(users or "")
        if spoken and spoken != OTHER and spoken != said and said != asked_by_system:
            named = named_languages(users or "")
            if said not in named and not (said == OTHER and (named or asked_by_system)):
                return "wrong_language"
    return None


def defects(samples: DataFrame) -> DataFrame:
    """(sample_id, defect_type), one row per defective key of ``samples(sample_id, messages, target)``."""
    of = lambda role: F.filter("messages", lambda m: (folded(m["role"]) == role) & m["content"].isNotNull())
    system = F.lower(F.array_join(F.transform(of("system"), lambda m: m["content"]), "\n"))
    pairs = samples.where("sample_id is not null").select(
        "sample_id",
        "target",
        F.try_element_at(of("user"), F.lit(-1))["content"].alias("prompt"),
        F.array_join(F.transform(of("user"), lambda m: m["content"]), "\n").alias("users"),
        F.regexp_extract(system, r"\b(?:answer|reply|respond|write|speak)\w*\b[^.\n]{0,40}?\b(" + "|".join(CODES) + r")\b", 1).alias("system"),
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for key, target, prompt, users, system in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = defect(target, prompt, users, CODES.get(system or ""))
                if kind:
                    ids.append(key)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["sample_id", "defect_type"])

    return pairs.mapInArrow(run, "sample_id string, defect_type string").groupBy("sample_id").agg(F.min("defect_type").alias("defect_type"))


def p1_found(spark, root: str) -> DataFrame:
    return defects(table(spark, root, "sft_samples").select("sample_id", "messages", "target"))
