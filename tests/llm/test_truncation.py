from weft.llm import truncation

SENTENCES = [
    "The worker polled the queue and found {n} jobs for node Karo.", "No other branch reported trouble with AB-{n} this week.", "Between Velden and Rosmar the difference comes to {n}.", "I also noticed that Karo is listed twice under Velden.",
]


def corpus():
    rows = []
    for i in range(400):
        text = " ".join(s.format(n=i * 7 + j) for j, s in enumerate(SENTENCES[i % 4 :] + SENTENCES[: i % 4]))
        tail = ["", "\n\n— Karo, Velden", "\n\n- rerun seed 5\n- compare AB-1 with CD-2", " We will see...", "\n\n2031-01-01 00:00:00 INFO sample skipped, unpaired output", "\n\nruns/AB-1/notes.md", "\n\n#ledger #final", '\n\n```json\n{"a": [1]}\n```', "\n| a | b |\n|---|---|\n| c0 | 0.5 |", " 🙂"][i % 10]
        rows.append((i, text + tail, "s"))
    return rows


CUT = [
    "The worker polled the qu", "No other branch reported trouble with", "Between Velden and Rosmar the differ…", "I also noticed that Karo is li [truncated]", "No other branch reported. Between Velden and Rosmar the difference comes to 5 (", "2031-01-01 00:00:00 INFO sample skipped, unpaired outp", '{"a": [1, {"b": "x', '{"a": [1, 2',
    "See below.\n\n```json\n[1, 2]", 'call: {"name": "x", "arguments": {"a"', "The worker polled the queue and found 5 jobs<br", "The worker polled the queue and found 5 jobs for�", "The worker polled the queue and fou...",
]
WHOLE = [None, "", "  ", "...", "123", "🙂", '{"a": [1, "}"]}', "你好。", "Really?!", 'He said "done."', "(done.)"]


def found(spark, rows):
    return {r.doc_id: r.cut for r in truncation.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.cut}


def test_cuts(spark):
    rows = corpus()
    rows += [(1000 + i, t, "s") for i, t in enumerate(CUT)] + [(2000 + i, t, None) for i, t in enumerate(WHOLE)] + [(None, "The worker polled the qu", "s")]
    got = found(spark, rows)
    assert set(got) == set(range(1000, 1000 + len(CUT))), [t for i, t in enumerate(CUT) if 1000 + i not in got]
    assert got[1000] == "inside a word" and got[1006] == "open structure"


def test_copies_do_not_vouch_for_a_cut(spark):
    copies = 60
    rows = corpus() + [(1000 + i * copies + j, t, "s") for i, t in enumerate(CUT) for j in range(copies)]
    assert set(found(spark, rows)) == {1000 + i * copies + j for i in range(len(CUT)) for j in range(copies)}


def test_ends_of_a_small_corpus(spark):
    rows = [(1, "The queue was empty. We will see...", "s"), (2, "No branch reported trouble. We will see...", "s"), (3, "The worker stopped at noon....", "s"), (4, "The node asked for the reference #", "s"), (5, "The node lost the reference #", "s")]
    assert set(found(spark, rows)) == {4, 5}


def test_edges(spark):
    assert found(spark, []) == {}
    long = "The worker polled the queue. " * 60_000
    assert found(spark, [(1, long, "s"), (2, long + "The wor", "s"), (3, '{"a": "' + "x" * 500_000 + '"}', "s"), (4, "[" * 200_000, "s")]).keys() == {2}


def test_report(spark, root):
    report = truncation.p9_report(spark, root).collect()
    assert sum(r.n_cut for r in report) == truncation.p9_found(spark, root).count()
    assert sum(r.n_docs for r in report) == spark.read.parquet(f"{root}/documents.parquet").count()


def test_long_words_marks_and_ends_have_no_bound(spark):
    """A word cut after 60 letters, a mark of 40 characters, a sentence end behind 200 closing characters."""
    word = "donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft"
    rows = corpus() + [(5000 + i, f"The worker polled {word} again {i}.", "s") for i in range(3)] + [(6000, f"The worker polled {word[:60]}", "s"), (6001, "The worker polled the queue and fou [" + " " * 40 + "truncated ]", "s"), (6002, "The worker polled the queue and found 5 jobs." + '"' * 200, "s")]
    got = found(spark, rows)
    assert got[6000] == "inside a word" and 6001 in got and 6002 not in got


def test_verdicts_do_not_change_with_the_size_of_the_corpus(spark):
    """Ten times the same distinct sentences under other numbers give the same verdicts."""
    cuts = [(9000 + i, t, "s") for i, t in enumerate(CUT)]
    small = found(spark, corpus() + cuts)
    large = found(spark, [(i * 10_000 + k, t.replace("AB-", f"AB-{i}") if t else t, s) for i in range(5) for k, t, s in corpus()] + cuts)
    assert set(small) == set(large) == {k for k, _, _ in cuts}


def test_last_trigrams_decide_most_cuts(spark):
    reasons = [r.cut for r in truncation.verdicts(truncation._documents(spark, "/root/testdata/sf0.01")).where("cut is not null").collect()]
    assert sum(r in ("inside a word", "inside a sentence") for r in reasons) >= 0.7 * len(reasons)
