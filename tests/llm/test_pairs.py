import random
import re

import pytest

from weft.llm import pairs, refusal
from weft.llm.lang import vote

ASK = "Please move the booking of Karo to Monday and tell me how many vouchers are left for the branch in Velden."
GOOD = "I moved the booking to Monday, and there are 12 vouchers left for the branch."


@pytest.mark.parametrize(
    ("target", "want"),
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("<answer></answer>", "empty"), ("<think>I will see.</think>", "empty"), ("<answer>N/A</answer>", "empty"), ("null", "empty"), ("...", "empty"), ("<answer>[no response]</answer>", "empty"), ("<answer>​</answer>", "empty"),
        ("<think>x</think>\n<tool_call>\n</tool_call>", "empty"), ("**", "empty"),
        (GOOD, None), ("Done.", None), ("0", None), ("Yes.", None), ("<answer>12</answer>", None), ("- **Karo**: 2\n- `AB-1` at Velden", None), ('Here it is.\n\n```json\n{"code": 1}\n```', None), (GOOD + " \U0001f642", None),
        ('<tool_call>\n{"name": "trigger_tool", "arguments": {}}\n</tool_call>', None), ('<think>The user wants', "truncated"), ('<tool_call>\n{"name": "a", "arg', "truncated"), ('<tool_call>\n{"name": "a", "arg\n</tool_call>', "truncated"),
        ("<answer>I moved the booking to Mon</answer>", "truncated"), ("I moved the booking…", "truncated"), ("I moved it. There are 12 vouchers left for [truncated]", "truncated"), ("Here:\n```json\n{\"a\": 1", "truncated"), ("- **Karo**: 2\n- **Vel", "truncated"), ("- (see", "truncated"), ('You asked: "**Please move it. I moved it to Monday, and that is all.', None), ('{"a": "Done.', "truncated"),
        ("I can't help with that request.", "refusal"), ("Sorry, but this is outside what I am allowed to do. I hope you understand.", "refusal"), ("Das geht über meine Befugnisse hinaus. Bitte wende dich an Karo.", "refusal"), ("这个请求我必须拒绝。请联系卡罗。", "refusal"),
        ("Sorry about the wait. " + GOOD, None), ("The branch declined to help, but Karo did. " + GOOD, None), ("I can't see AB-1 in the older list, but the newer one has it.", None),
        (ASK, "copy"), (ASK.upper(), "copy"), (re.sub(r"[.,]", "", ASK), "copy"), ("You asked: " + ASK, "copy"), (f'<answer>"{ASK}"</answer>', "copy"), (ASK + " " + GOOD, None), ("Velden.", None),
        ("Der Termin liegt jetzt auf Montag, und für die Filiale sind noch 12 Gutscheine da.", "wrong_language"), ("查询显示还有十二张券，预约已改到周一。", "wrong_language"),
    ],
)
def test_defects(target, want):
    assert pairs.defect(target, ASK, ASK, None) == want


def test_a_language_that_was_asked_for_is_right():
    german = "Der Termin liegt jetzt auf Montag, und für die Filiale sind noch 12 Gutscheine da."
    for ask in (ASK + " Please write the reply in German.", ASK + "\nAntwort bitte auf Deutsch."):
        assert pairs.defect(german, ask, ask, None) is None
    assert pairs.defect(german, ASK, ASK, "de") is None
    assert pairs.defect(german, None, None, None) is None


def test_votes():
    assert [vote(t) for t in ("the house is on the hill and it is red", "Das ist ein Haus und es ist rot", "el perro que está en la casa y no es mío", "la maison est dans le village et elle est pour nous", "o livro que está na mesa não é do meu pai", "这是一本关于历史的书", "ok", "")] == ["en", "de", "es", "fr", "pt", "zh", None, None]


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
        said = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        least = rng.randrange(1, 4)
        runs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        want = [any(tuple(said[i:j]) in runs for i in range(k + 1) for j in range(k + 1, len(said) + 1) if j - i >= least) for k in range(len(said))]
        assert pairs.SuffixAutomaton(text).covered(said, least) == want


def test_phrases_without_the_native_library():
    machine, fallback = refusal.Phrases(["ab", "b c"]), refusal.Phrases(["ab", "b c"])
    fallback.regex = re.compile("ab|b c")
    for text in ("xaby", "b c", "b  c", ""):
        assert (text in machine) == (text in fallback)


def test_very_long_texts():
    assert pairs.defect("word " * 400_000 + "end.", "word " * 400_000 + "end.", "", None) == "copy"
    assert pairs.defect("[" * 300_000, ASK, ASK, None) in ("empty", "truncated")


def test_tables(spark):
    schema = "sample_id string, messages array<struct<role:string,content:string>>, target string, defect_type int, prompt string"
    rows = [("a", [("user", ASK), None, ("user", None)], ASK, 1, "x"), ("a", [("user", ASK), None, ("user", None)], ASK, 1, "x"), ("b", None, GOOD, None, None), ("c", None, None, None, None), (None, None, None, None, None), ("d", [("USER ", ASK), ("system", "Always answer in German.")], "Der Termin ist jetzt auf Montag und das ist gut.", 0, "")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(tuple(r) for r in pairs.defects(df).collect()) == [("a", "copy"), ("c", "empty")]
    assert pairs.defects(df.limit(0)).count() == 0
