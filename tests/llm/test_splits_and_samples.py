import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.compare import connection, duck_rows, spark_rows
from weft.llm import oracle, queries, sampling, splits

SAMPLE = "sample_id string, source_uuid string, partition string, sample_type string, size int, split string"


def test_oracles(spark, root):
    con = connection(root)
    for name, sql in oracle.oracle_sql().items():
        assert spark_rows(queries.queries()[name](spark, root)) == duck_rows(con, sql)


def test_flow_is_cheapest():
    arcs = [("s", "a", 4, 0), ("s", "b", 4, 0), ("a", "x", 3, 1), ("a", "y", 3, 0), ("b", "x", 3, 0), ("b", "y", 3, 5), ("x", "t", 4, 0), ("y", "t", 4, 0)]
    flow = splits.min_cost_flow(arcs, "s", "t")
    assert sum(flow[n, "t"] for n in "xy") == 8 and flow["a", "x"] == flow["b", "y"] == 1


def shares(spark, rows, targets=(("train", 0.8), ("validation", 0.1), ("test", 0.1))):
    parts = splits.components(spark.createDataFrame(rows, SAMPLE))
    out = splits.allocate(parts, spark.createDataFrame(list(targets), "split_name string, target_share double"))
    return out, {r.split: r.n for r in out.groupBy("split").agg(F.sum("size").alias("n")).collect()}


def test_sources_stay_whole_and_shares_hold(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = f"{i:032x}"
        for j in range(rng.choice([1, 1, 1, 2, 3, 5, 70])):
            rows.append((f"{i}-{j}", rng.choice([source, source.upper(), f" urn:uuid:{source}", "{" + source + "}"]), rng.choice(["train", "test_iid"]), rng.choice(["clean", "Boundary "]), 0, "x"))
    rows += [(f"hot{j}", f"{10**6:032x}", "train", "clean", 0, None) for j in range(len(rows) // 2)]
    out, got = shares(spark, rows)
    assert out.count() == 1501 and out.select("component").distinct().count() == 1501
    total = len(rows)
    assert sum(got.values()) == total and all(abs(got[s] / total - x) < 0.01 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    again, _ = shares(spark, rows[::-1])
    assert {tuple(r) for r in out.select("component", "split").collect()} == {tuple(r) for r in again.select("component", "split").collect()}


def test_split_edges(spark):
    rows = [("a", None, None, None, 0, "x"), ("a", None, None, None, 0, "x"), ("b", None, "train", "t", 0, "x"), (None, "u", "train", "t", 0, "x"), ("c", "no uuid ", "train", "t", 0, "x"), ("d", "NO UUID", "test_iid", "t", 0, "x"), ("e", "NO UUID", "elsewhere", "t", 0, "x")]
    out, got = shares(spark, rows)
    found = {r.component: r for r in out.collect()}
    assert set(found) == {"sample:a", "sample:b", "no uuid"} and found["no uuid"].delivered == 2 and found["no uuid"].size == 3
    assert all(r.split for r in found.values())
    assert shares(spark, [])[1] == {}
    assert shares(spark, rows, [])[1] == {None: 5}


def test_flow_over_bundles_spreads_deviations():
    """One source of nearly all rows of a label leaves none of the splits without that label; whole components only."""
    bundles = [("one/a", 900_000, {"L": 900_000}, 1), ("many/1", 1, {"L": 1}, 100_000), ("many/2", 2, {"M": 2}, 3_000_000)]
    solved = splits.plan(bundles, {"train": 0.8, "validation": 0.1, "test": 0.1})
    rows = {}
    for name, size, profile, n in bundles:
        assert sum(k for _, k in solved[name]) == n
        for s, k in solved[name]:
            for label in profile:
                rows[label, s] = rows.get((label, s), 0) + k * size
    total = {s: sum(n for (_, t), n in rows.items() if t == s) for s in ("train", "validation", "test")}
    assert abs(total["train"] / 7_000_000 - 0.8) < 0.002 and abs(total["validation"] / 7_000_000 - 0.1) < 0.002
    assert rows["L", "validation"] > 40_000 and rows["L", "test"] > 40_000 and abs(rows["L", "validation"] - rows["L", "test"]) < 10
    assert solved == splits.plan(bundles[::-1], {"test": 0.1, "train": 0.8, "validation": 0.1})


def test_flow_keeps_mixed_profiles_near_their_shares():
    rng = random.Random(9)
    bundles = [(f"b{i}", a + b + c, {k: v for k, v in (("A", a), ("B", b), ("C", c)) if v}, rng.randrange(1, 40)) for i, (a, b, c) in enumerate(sorted({(rng.randrange(4), rng.randrange(3), rng.randrange(70)) for _ in range(200)}) ) if a + b + c]
    solved = splits.plan(bundles, {"train": 0.8, "validation": 0.1, "test": 0.1})
    for label in "ABC":
        have = {s: sum(k * p.get(label, 0) for n, _, p, _ in bundles for t, k in solved[n] if t == s) for s in ("train", "validation", "test")}
        assert all(abs(have[s] / sum(have.values()) - x) < 0.01 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_bundles_straddle_the_old_bounds(spark):
    """Sizes beyond 64 and labels beyond 32 are bundles of their own."""
    rows = [(f"{i}-{j}", f"{i:032x}", "train", f"label {j % 40}", 0, "x") for i in range(12) for j in range(63 + i)]
    out, got = shares(spark, rows)
    assert out.select("bundle").distinct().count() == 12 and sum(got.values()) == len(rows)
    many = spark.createDataFrame([(str(i), str(i), 1 + i % 3000, [("t", 1 + i % 3000)], [], 0) for i in range(30_000)], "component string, source_uuid string, size long, profile array<struct<label:string,n:long>>, parts array<string>, delivered int")
    assert splits._bundles(many).select("bundle").distinct().count() == 3000


def test_bundles_are_exact_whatever_their_number(spark):
    """21,000 distinct profiles: a bundle has one size and profile, the same as in a small table, and the quotas hold to a few rows of three million."""
    many = spark.range(21_000).selectExpr("string(id) component", "string(id) source_uuid", "id % 145 + id div 145 + 2 size", "array(named_struct('label', 'a', 'n', id % 145 + 1), named_struct('label', 'b', 'n', id div 145 + 1)) profile", "cast(array() as array<string>) parts", "0 delivered")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    out = splits.allocate(many, targets).collect()
    assert len(out) == 21_000 == len({r.bundle for r in out}) == len({r.component for r in out})
    alone = {r.component: r.bundle for r in splits.allocate(many.limit(50), targets).collect()}
    assert len(alone) == 50 and alone.items() <= {r.component: r.bundle for r in out}.items()
    total = sum(r.size for r in out)
    assert all(abs(sum(r.size for r in out if r.split == s) - x * total) < 5 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_solver_over_batches_is_the_plan():
    rng = random.Random(3)
    bundles = [(f"b{i:02}", a + b, {k: v for k, v in (("B", b), ("A", a)) if v}, rng.randrange(1, 30)) for i, (a, b) in enumerate(sorted({(rng.randrange(9), rng.randrange(1, 9)) for _ in range(30)}))]
    batches = [pa.record_batch([pa.array(c) for c in zip(*((name, size, n, list(profile), list(profile.values())) for name, size, profile, n in bundles[i : i + 4]), strict=True)], names=["bundle", "size", "n", "labels", "rows"]) for i in range(0, len(bundles), 4)]
    got = {r["b"]: r["high"] for out in splits._solver([0.1, 0.8, 0.1], batch=3)(iter(batches)) for r in out.to_pylist()}
    solved = splits.plan(bundles, {"test": 0.1, "train": 0.8, "validation": 0.1})
    assert got == {name: [sum(k for s, k in parted if s <= t) for t in ("test", "train", "validation")] for name, parted in solved.items()}
    assert list(splits._solver([1.0])(iter([]))) == []


TARGETS = "target_set string, category string, target_share double, min_rows int, sample_share double"


def tables(spark, n=3000):
    rng = random.Random(4)
    samples = [(f"s{i}", f"u{i % (n // 2)}", rng.choice(["clean"] * 8 + ["Positive ", None, "rare"] if i % 200 == 0 else ["clean", "positive"]), rng.choice([0, 0, 0, 1, None]), 1) for i in range(n)]
    stats = [(f"u{i}", rng.choice([0, 1, 2, 3, 9, None]), "x") for i in range(n // 2)]
    return spark.createDataFrame(samples, "sample_id string, source_uuid string, sample_type string, focal_tool_success_count_at_decision int, uuid int"), spark.createDataFrame(stats, "uuid string, max_same_tool_success_count int, sample_type string")


def test_shares_and_minimums_are_met(spark):
    samples, stats = tables(spark)
    targets = spark.createDataFrame([("sample_type", "clean", 0.3, 5, 0.2), ("sample_type", "positive", 0.7, 5, 0.2), ("sample_type", "rare", 0.0, 2, 0.2), ("count_bucket", "c0", 0.5, 1, 0.2), ("count_bucket", "c4_plus", 0.5, 1, 0.2), ("focal_count", "0", 0.4, 1, 0.2), ("focal_count", "1", 0.6, 1, 0.2)], TARGETS)
    got = sampling.draw(samples, stats, targets).collect()
    assert len(got) == 600 == len({r.sample_id for r in got})
    share = lambda c, v: sum(r[c] == v for r in got) / len(got)
    assert sum(r.sample_type == "rare" for r in got) >= min(2, samples.where("sample_type = 'rare'").count())
    assert abs(share("sample_type", "positive") - 0.7) < 0.12 and abs(share("count_bucket", "c0") - 0.5) < 0.12
    assert {r.sample_id for r in sampling.draw(samples.repartition(7), stats, targets).collect()} == {r.sample_id for r in got}


def test_rake_meets_margins():
    counts = {(a, b): 100.0 for a in "xy" for b in "pq"}
    got = sampling.rake(counts, {0: {"x": 0.9, "y": 0.1}, 1: {"p": 0.2, "q": 0.8}}, 0.1)
    assert abs(sum(v for k, v in got.items() if k[0] == "x") - 0.9) < 1e-6 and abs(sum(v for k, v in got.items() if k[1] == "p") - 0.2) < 1e-6
    scarce = sampling.rake({("x",): 10.0, ("y",): 990.0}, {0: {"x": 0.5, "y": 0.5}}, 0.1)
    assert abs(scarce["x",] - 0.1) < 1e-9 and abs(scarce["y",] - 0.9) < 1e-9


def test_sampling_edges(spark):
    samples, stats = tables(spark, 20)
    targets = spark.createDataFrame([("sample_type", "clean", 0.9, 100, 0.5), ("sample_type", None, 0.1, 1, 0.5), (None, "x", 0.1, 1, 0.5), ("sample_type", "absent", 0.1, 1, 0.5)], TARGETS)
    served = {r.category: r.served for r in sampling.servable(samples.union(samples), stats.union(stats), targets).collect()}
    assert served == {"clean": False, "absent": False}
    assert sampling.draw(samples, stats, targets.limit(0)).count() == 0
    assert sampling.draw(samples.limit(0), stats.limit(0), targets).count() == 0
    assert {r.served for r in sampling.servable(samples.limit(0), stats.limit(0), targets).collect()} == {False}
    assert sampling.draw(samples, stats.limit(0), targets).count() == samples.where("sample_type = 'clean'").count()  # a minimum goes before the size


def test_repair_exhausts_what_cannot_be_served_and_keeps_minimums():
    counts = {("a", "p"): 400, ("a", "q"): 300, ("b", "p"): 6, ("b", "q"): 500, ("c", "q"): 3}
    targets = {0: {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 2)}, 1: {"p": (0.5, 1), "q": (0.5, 1)}}
    take = sampling.repaired({("a", "p"): 100}, counts, targets, 100)
    held = lambda axis, k: sum(n for c, n in take.items() if c[axis] == k)
    assert sum(take.values()) == 100 and held(0, "c") == 3 and all(0 <= n <= counts[c] for c, n in take.items())
    assert abs(held(0, "a") - 50) + abs(held(0, "b") - 30) <= 18 and abs(held(1, "p") - 50) <= 1


def test_contradicting_margins_meet_halfway():
    """Two margins of one category each that no table can have at once; every cell is the mean over the cycle."""
    counts = {("x", "p"): 500.0, ("y", "q"): 500.0}
    share, rested = sampling.fitted(counts, {0: {"x": 0.9, "y": 0.1}, 1: {"p": 0.1, "q": 0.9}}, 0.1)
    assert rested and abs(share["x", "p"] - share["y", "q"]) < 1e-6
    assert sampling.fitted(counts, {0: {"x": 0.9, "y": 0.1}}, 0.1, rounds=0)[1] is False


def test_exponential_keys_draw_in_proportion(spark):
    rows = spark.createDataFrame([(f"k{i}", "a" if i % 10 else "b") for i in range(4000)], "k string, s string")
    sample, rested = sampling.draw_by(rows, "k", {"s": {"a": (0.5, 1), "b": (0.5, 1)}}, 0.1)
    got = sample.collect()
    assert rested and len(got) == 400 and sum(r.s == "a" for r in got) == 200 and all(r.weighted_key is not None for r in got)
    worst = {s: max(r.weighted_key for r in got if r.s == s) for s in "ab"}
    again = sampling.draw_by(rows.repartition(5), "k", {"s": {"a": (0.5, 1), "b": (0.5, 1)}}, 0.1)[0]
    assert {r.k for r in again.collect()} == {r.k for r in got} and abs(worst["a"] - worst["b"]) < 0.5


def test_sample_comes_near_all_margins(spark):
    found = sampling.p5_gaps(spark, "/root/testdata/sf0.01").collect()
    assert sum(abs(r.residual) for r in found) < 1.2
    assert all(r.sampled >= min(r.min_rows, r.available) for r in found)
    assert all(r.unused == 0 for r in found if r.available < r.wanted)
    counted = sampling.servable(*sampling._tables(spark, "/root/testdata/sf0.01")).where("not served").collect()
    assert {(r.target_set, r.category) for r in sampling.p5_found(spark, "/root/testdata/sf0.01").collect()} == {(r.target_set, r.category) for r in counted}
