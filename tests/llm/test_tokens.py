import os
import random

import pytest

from weft.llm import bpe, budget, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
ODD = [None, "", " ", "a", "aaaaaaaaaaaaaaaaaaaa", "  \n\n\t x", "I'll don't'S", "<|endoftext|> text", "你好 世界🙂👩‍🔧", "\x00\x1c\x85　é", "x" * 5000, "ab" * 3000, "1234567890" * 50, "‮" * 3]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.merges())


def test_equals_the_public_tokenizer(encoder, public):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("abc  eé你\n.,'st12-_") for _ in range(rng.randrange(80))) for _ in range(500)]
    want = public(texts)
    assert [encoder.encode(t) for t in texts] == want
    assert encoder.count(texts) == [len(x) for x in want]


def test_long_texts_and_bounded_caches(public):
    small = bpe.Encoder(bpe.merges())
    small.KEPT, small.KEPT_CHARS = 10, 1000
    texts = ["word%d and more " % i * 60 for i in range(40)] * 2 + ["many words " * 250_000]
    want = [len(x) for x in public(texts)]
    assert small.count(texts) == want
    assert [len(small.encode(t)) for t in texts[:5]] == want[:5]


def test_ids_query(spark, root, public):
    rows = bpe.encode(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang"), "doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert [r.ids for r in rows] == public([texts[r.doc_id] for r in rows])
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(odd, "doc_id", "text").collect()}
    assert got[0] == got[1] == [] and got[3] == [64]
    assert bpe.encode(odd.limit(0), "doc_id", "text").count() == 0


def test_budget_adds_up(spark, root, public):
    rows = budget.p6_token_budget(spark, root).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    samples = {r.sample_id: [m.content for m in r.messages or [] if m] for r in spark.read.parquet(f"{root}/sft_samples.parquet").collect() if r.sample_id}
    total = {(r.origin, r.level): (r.n_rows, r.n_tokens) for r in rows if r.level == "total"}
    assert total["documents", "total"] == (len(docs), sum(map(len, public(list(docs.values())))))
    assert total["sft_samples", "total"] == (len(samples), sum(map(len, public([t for x in samples.values() for t in x]))))
    for origin in ("documents", "sft_samples"):
        for level in {r.level for r in rows if r.origin == origin}:
            assert sum(r.n_tokens for r in rows if r.origin == origin and r.level == level) == total[origin, "total"][1]


def test_budget_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "EN-gb", " Run ", "t", 5), (1, "a b", "EN-gb", " Run ", "t", 5), (2, None, None, None, None, None), (None, "x", "en", "run", "t", 0), (3, "", "zho", "run", "t", 0)], "doc_id long, text string, lang string, source string, topic string, tokens int")
    got = budget.slices(budget.document_tokens(docs), "doc_id", ["source", "lang", "topic"], [["source", "lang"], []]).collect()
    assert {(r.level, r.source, r.lang): (r.n_rows, r.n_tokens) for r in got} == {("source+lang", "run", "en"): (1, 2), ("source+lang", "run", "zh"): (1, 0), ("source+lang", None, None): (1, 0), ("total", None, None): (3, 2)}
    samples = spark.createDataFrame([("a", "s", "t", None), ("b", "s", None, [None, ("user", None), ("user", "a b")])], "sample_id string, source_subset string, sample_type string, messages array<struct<role:string,content:string>>")
    assert {r.sample_id: r.tokens for r in budget.sample_tokens(samples).collect()} == {"a": 0, "b": 2}
    assert budget.sample_tokens(samples.limit(0)).count() == 0


def test_pivotal_keeps_the_sum():
    rng = random.Random(9)
    counts = [0] * 40
    for seed in range(400):
        rows = [("s", i, 10, 0.3 if i % 2 else 0.55, 0) for i in range(40)]
        rng.shuffle(rows)
        done, left = mixing.pivotal(rows, seed)
        assert len(done) + (left is not None) == 40 and all(r[3] in (0.0, 1.0) for r in done)
        assert abs(sum(r[3] for r in done) + (left[3] if left else 0) - 17) < 1e-6
        for r in done:
            counts[r[1]] += r[3]
    assert abs(sum(counts[1::2]) / 20 / 400 - 0.3) < 0.05 and abs(sum(counts[0::2]) / 20 / 400 - 0.55) < 0.05


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 = 0 then 'small' when id % 3 = 0 then 'big' else 'huge' end as source", "10 + id % 7 as tokens").repartition(70)
    targets = spark.createDataFrame([("small", 0.4, 3), ("big", 0.3, 1), ("huge", 0.2, 2), ("none", 0.1, 5)], TARGETS)
    plan = mixing.supply(docs, targets)
    reach = {r.source: r for r in plan.collect()}
    assert not reach["none"].reachable and reach["small"].reachable and reach["big"].reachable
    rows = mixing.mix(docs, plan).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    for s in ("small", "big", "huge"):
        got = sum(r.tokens * r.copies for r in rows if r.source == s)
        assert abs(got - reach[s].wanted) < 0.02 * reach[s].wanted and max(r.copies for r in rows if r.source == s) <= reach[s].max_repeats
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, plan).collect()))


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", 0), (4, "b", 5)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.9, 1), (None, 0.5, 1), ("A ", 0.9, 1), ("z", None, None)], TARGETS)
    plan = mixing.supply(docs, targets)
    assert {r.source: r.reachable for r in plan.collect()} == {"a": True, "z": None}
    assert all(r.source == "a" and r.copies == 1 for r in mixing.mix(docs, plan).collect())
    assert mixing.mix(docs.limit(0), mixing.supply(docs.limit(0), targets)).count() == 0
    assert mixing.mix(docs, mixing.supply(docs, targets.limit(0))).count() == 0


def test_mix_is_the_same_for_every_layout(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'small' else 'huge' end as source", "1 + (id * 7919) % 300 as tokens")
    targets = spark.createDataFrame([("small", 0.3, 3), ("huge", 0.5, 2)], TARGETS)
    plan = mixing.supply(docs, targets).persist()
    found = [sorted(map(tuple, mixing.mix(docs.repartition(n), plan).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 500
    for r in plan.collect():
        got = sum(t * n for _, s, t, n in found[0] if s == r.source)
        assert abs(got - r.wanted) < 5


def test_actual_shares_and_what_is_lacking(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "case when id < 20 then 'few' when id < 200 then 'some' else 'many' end as source", "10 + id % 5 as tokens")
    targets = spark.createDataFrame([("few", 0.5, 2), ("some", 0.2, 1), ("many", 0.2, 1), ("none", 0.1, 3)], TARGETS)
    for fill in (False, True):
        plan = mixing.supply(docs, targets, fill=fill)
        got = {r.source: r for r in mixing.shares(docs, plan, mixing.mix(docs, plan)).collect()}
        assert abs(sum(r.actual_share for r in got.values() if r.actual_share is not None) - 1) < 1e-9
        assert {s for s, r in got.items() if r.saturated and r.tokens < r.wanted} == {"few", "none"} and got["few"].most_copies == 2
        size = sum(r.tokens for r in got.values())
        assert abs(size - 2400) < 20 if fill else size < 1600
    assert mixing._filled({"a": (0.5, 10.0), "b": (0.5, 1000.0)}, 100.0) == {"a": 10.0, "b": 90.0}


def test_budget_equals_texts_counted_one_by_one(spark, root):
    """Slices of distinct pieces, merged once per table, against the tokens of every record."""
    sets = [["source", "lang", "topic"], ["source"], []]
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang", "source", "topic")
    odd = spark.createDataFrame([(-i - 1, t, "en", None if i % 2 else "odd", "t") for i, t in enumerate(ODD)], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd)
    dims = ["source", "lang", "topic"]
    got = budget.token_slices(docs, "doc_id", dims, "text", sets)
    want = budget.slices(bpe.count_tokens(docs, "text"), "doc_id", dims, sets)
    assert sorted(map(repr, got.select(sorted(got.columns)).collect())) == sorted(map(repr, want.select(sorted(want.columns)).collect()))
    samples = spark.read.parquet(f"{root}/sft_samples.parquet")
    whole = {r.level: r.n_tokens for r in budget.p6_token_budget(spark, root).where("origin = 'sft_samples' and level = 'total'").collect()}
    each = budget.slices(budget.sample_tokens(samples), "sample_id", ["source"], [[]]).first()
    assert whole == {"total": each.n_tokens}


def test_budget_edges(spark, public):
    least = len(public(["least"])[0])
    schema = "k string, d string, text string"
    rows = [("a", "x", "one two"), ("a", "x", "one two"), ("b", None, None), ("c", None, ""), (None, "x", "lost"), ("d", "y", "q"), ("d", "y", "qqqqqqqq zzzzzz"), ("d", "a", "least")]
    got = {(r.level, r.d): (r.n_rows, r.n_tokens) for r in budget.token_slices(spark.createDataFrame(rows, schema), "k", ["d"], "text", [["d"], []]).collect()}
    assert got["d", "x"] == (1, 2) and got["d", None] == (2, 0) and got["d", "a"] == (1, least) and got["total", None] == (4, 2 + least) and ("d", "y") not in got
    many = budget.once_per_key(spark.createDataFrame(rows, schema), "k", ["d"], "text", few=0)
    assert many[0].count() == 4 and many[1].count() == 4
    assert budget.token_slices(spark.createDataFrame([], schema), "k", ["d"], "text", [["d"]]).count() == 0


def test_whole_pieces_are_one_token(public):
    encoder = bpe.Encoder(bpe.merges())
    pieces = [" the", "the", " Haus", "xqzj", "1234", "  ", "你", " straße", "!!", "\n\n", "'s", "ing", " été"]
    for p, ids in zip(pieces, public(pieces), strict=True):
        assert not encoder.whole(p) or len(ids) == 1
    assert encoder.whole(" the") and encoder.merge(pieces).tolist() == [len(x) for x in public(pieces)]
