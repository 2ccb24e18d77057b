import random
import unicodedata
from collections import Counter

import regex

from weft.llm import overlap

SCHEMA = "sample_id string, partition string, source_subset string, messages array<struct<role:string,content:string>>, class int"


def bag(text):
    low = unicodedata.normalize("NFKD", text.lower())
    bare = "".join(c for c in low if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return Counter(regex.findall(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", bare, flags=regex.V1))


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    kept = overlap.members(df)
    train, evaluation = overlap._sides(kept)
    return {(r.train_id, r.eval_id) for r in overlap.class_pairs(kept).join(train, "class_a").join(evaluation.select("eval_id", "class_b"), "class_b").collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    rows = []
    for i in range(400):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            spot = rng.randrange(len(words))
            words[spot : spot + 1] = rng.choice([[], [rng.choice("xyz")], [words[spot]] * 2])
            words = words or ["w"]
        rng.shuffle(words)
        text = rng.choice([" ".join, ", ".join, "​ ".join])(rng.choice([str.upper, str.lower, str.title])(w) for w in words)
        rows.append((f"s{i:03}", rng.choice(["train", " Train ", "validation", "TEST_IID", "test_ood", None, "other"]), "t", [("system", "x"), ("user", text), ("user", "later")], 1))
    sides = [(r[0], (r[1] or "").strip().lower(), bag(r[3][1][1])) for r in rows]
    want = set()
    for a, p, x in sides:
        for b, q, y in sides:
            n, m = sum(x.values()), sum(y.values())
            if p == "train" and q in overlap.EVALUATION and min(n, m) and sum((x & y).values()) * 20 >= 17 * max(n, m):
                want.add((a, b))
    assert want and found(spark, rows) == want


def test_canonical_words(spark):
    df = spark.createDataFrame([("Crème  BRÛLÉE, so­ft​ 12a 你好ß",), ("…!",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(overlap.canonical_words("t").alias("w")).collect()] == [["creme", "brulee", "soft", "12a", "你", "好", "ß"], [], [], None]


def test_edges(spark):
    user = [("user", "same words here")]
    rows = [("a", "train", None, user, 0), ("a", "train", None, user, 0), ("b", "test_iid", "s", user, 0), ("c", "test_iid", "s", [("user", None), *user], 0), ("d", "train", "s", None, 0), (None, "train", "s", user, 0), ("e", "validation", "s", [("user", "?!")], 0), ("f", "train", "s", [("user", "?!")], 0), ("g", None, "s", user, 0), ("h", "test_ood", "s", [None, ("tool", "x"), ("user", "Here: SAME words")], 0)]
    assert found(spark, rows) == {("a", "b"), ("a", "h")}
    assert found(spark, [("a", "train", "s", user, 0)]) == set()
    assert overlap.class_pairs(overlap.members(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_hot_text_stays_one_class(spark):
    user = [("user", "one text that a third of all rows have")]
    rows = [(f"t{i}", "train", "s", user, 0) for i in range(300)] + [(f"e{i}", "test_iid", "s", user, 0) for i in range(200)]
    kept = overlap.members(spark.createDataFrame(rows, SCHEMA))
    assert overlap.class_pairs(kept).count() == 1


def test_report(spark, root):
    report = overlap.p2_report(spark, root).collect()
    assert sum(r.pairs for r in report) == overlap.p2_found(spark, root).count()
    links = overlap.p2_links(spark, root).collect()
    assert sum(r.n_links for r in links) == sum(r.pairs for r in report) and len(links) == sum(r.samples for r in report)


def test_very_long_texts(spark):
    words = [f"w{i % 7000}x{i // 7000}" for i in range(30_000)]
    rows = [("a", "train", "s", [("user", " ".join(words))], 0), ("b", "test_iid", "s", [("user", " ".join(words[2000:] + ["new"] * 50))], 0), ("c", "test_iid", "s", [("user", " ".join(words[6000:]))], 0)]
    assert found(spark, rows) == {("a", "b")}
