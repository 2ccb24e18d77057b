"""A sample that matches target shares in several categories at once.

``draw`` rakes cell weights by iterative proportional fitting over the category margins, gives every record a weighted
exponential key, draws the records with the smallest keys, and repairs the draw: categories short of their minimum are
filled, categories that cannot be served give all they have, and what is left of the margins' deviations is lowered cell
by cell. Within a cell, records go in and out in the order of their keys. ``gaps`` reports what is left between sample
and targets: residual shares, rows short, whether all keys of a category are used up, whether the raking converged.

Only cells reach the driver: one per combination of target categories (others are one category, null another), so
their number is bounded by the target table.

Margins that contradict each other have no fixed point; raking then runs into a cycle of one point per margin, which is
just as well a result: the cell shares are the geometric means over that cycle. Raking ends when a whole round
changes nothing any more; where ``rounds`` are not enough for that, the report says so.

Defined results: null categories are counted among the keys but match no target; categories without a target are not
sampled unless the sample cannot be filled otherwise; a repeated key counts once; no targets or no rows give no sample;
minimums and categories that cannot be served go before the size of the sample.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.common import folded, plain_uuid, table
from weft.operators.ranking import hash_rank, unit_hash
from weft.session import cut

SETS = ("count_bucket", "sample_type", "focal_count")
#: Categories of records that no target names.
OTHERS = ("(null)", "(other)")
#: Wanted categories of one set: share and minimum.
Wants = dict[str, tuple[float, int]]


def count_bucket(c: Column | str) -> Column:
    """c0 to c3, and c4_plus from 4 on; null stays null, and so does what is below 0."""
    n = F.col(c) if isinstance(c, str) else c
    return F.when(n.between(0, 3), F.concat(F.lit("c"), n.cast("string"))).when(n >= 4, "c4_plus")


def _keys(samples: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_uuid = stats.where("uuid is not null").groupBy(plain_uuid("uuid").alias("uuid")).agg(count_bucket(F.max("max_same_tool_success_count")).alias("count_bucket"))
    per_sample = samples.where("sample_id is not null").groupBy("sample_id").agg(F.max(folded("sample_type")).alias("sample_type"), F.max("focal_tool_success_count_at_decision").cast("string").alias("focal_count"), F.max(plain_uuid("source_uuid")).alias("uuid"))
    return per_uuid, per_sample


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select(folded("target_set").alias("target_set"), folded("category").alias("category"), "target_share", "min_rows", "sample_share")
    return t.where("target_set is not null and category is not null").groupBy("target_set", "category").agg(F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.max("sample_share").alias("sample_share"))


def servable(samples: DataFrame, stats: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with the keys there are, the rows wanted and whether these can be served."""
    per_uuid, per_sample = _keys(samples, stats)
    counts = [per_uuid.groupBy(F.lit("count_bucket").alias("target_set"), F.col("count_bucket").alias("category")).count()]
    counts += [per_sample.groupBy(F.lit(s).alias("target_set"), F.col(s).alias("category")).count() for s in SETS[1:]]
    have = reduce(DataFrame.unionByName, counts)
    keys = have.groupBy("target_set").agg(F.sum("count").alias("keys"))
    out = _targets(targets).join(keys, "target_set", "left").join(have.where("category is not null"), ["target_set", "category"], "left")
    size = F.floor(F.col("sample_share") * F.coalesce("keys", F.lit(0)).cast("double"))
    out = out.withColumn("available", F.coalesce("count", F.lit(0))).withColumn("wanted", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.ceil(F.col("target_share") * size.cast("double"))))
    return out.select("target_set", "category", "target_share", "min_rows", "available", "wanted", (F.col("available") >= F.col("wanted")).alias("served"))


def fitted(counts: dict[tuple, float], targets: dict[int, dict[str, float]], fraction: float, rounds: int = 2000, near: float = 1e-9) -> tuple[dict[tuple, float], bool]:
    """Cell shares of a sample of ``fraction`` of all keys, by iterative proportional fitting; and whether it came to rest.

    Shares are scaled margin by margin to the targets until a whole round changes nothing; no cell gets more than it has
    keys for. What a category cannot give for want of keys, the others of its margin fill in proportion.
    """
    total = sum(counts.values())
    if not total or fraction <= 0:
        return {}, True
    cells = sorted(counts)
    limit = np.array([counts[c] for c in cells]) / total / fraction
    share = np.array([counts[c] for c in cells]) / total
    axes = []
    for axis, want in targets.items():
        names = sorted({c[axis] for c in cells})
        axes.append((np.array([names.index(c[axis]) for c in cells], dtype=np.int64), np.array([want.get(k, 0.0) for k in names])))
    rested, cycle = not axes, [share]
    for _ in range(rounds if axes else 0):
        before, cycle = share, []
        for place, want in axes:
            have = np.bincount(place, share, len(want))
            most = np.bincount(place, limit, len(want))
            free, goal, left = (have > 0) & (want > 0), np.zeros(len(want)), 1.0
            if not free.any():
                continue
            while free.any():  # categories without enough keys give all they have
                asked = want * left / want[free].sum()
                full = free & (asked >= most)
                if not full.any():
                    goal[free] = asked[free]
                    break
                goal[full] = most[full]
                left = max(0.0, left - most[full].sum())
                free &= ~full
            factor = np.divide(goal, have, out=np.zeros(len(want)), where=have > 0)
            share = np.minimum(share * factor[place], limit)
            cycle.append(share)
        if np.abs(share - before).max() < near:
            rested = True
            break
    points = np.array(cycle or [share])
    mean = np.where((points > 0).all(axis=0), np.exp(np.log(np.maximum(points, 1e-300)).mean(axis=0)), 0.0)
    return dict(zip(cells, np.minimum(mean, limit).tolist(), strict=True)), rested


def rake(counts: dict[tuple, float], targets: dict[int, dict[str, float]], fraction: float, rounds: int = 2000, near: float = 1e-9) -> dict[tuple, float]:
    """The cell shares of ``fitted``."""
    return fitted(counts, targets, fraction, rounds, near)[0]


def weights(counts: dict[tuple, int], share: dict[tuple, float], size: int) -> dict[tuple, float]:
    """Per cell the weight with which an exponential key falls below 1 just as often as the raked share asks for."""
    return {c: -math.log1p(-min(share.get(c, 0.0) * size / n, 1 - 1e-12)) if n else 0.0 for c, n in counts.items()}


def wanted_rows(share: float, least: int, size: int) -> int:
    """The rows that a category is to have: its minimum, or its share of the sample if that is more."""
    return max(least, math.ceil(share * float(size)))


def repaired(drawn: dict[tuple, int], counts: dict[tuple, int], targets: dict[int, Wants], size: int) -> dict[tuple, int]:
    """Rows to take of each cell, from those that the draw has: minimums kept, and deviations from the targets lowered.

    Rows move from one cell to another as long as that lowers the sum over all categories of their absolute deviation,
    with a small square of it so that deviations are spread; a row missing from a minimum weighs more than any of these. A
    category with fewer keys than it is to have must give all of them. Moves go in halving steps down to single rows, and
    in cycles of two moves where no single one helps.
    """
    cells = sorted(counts)
    have = np.array([counts[c] for c in cells], dtype=np.int64)
    take = np.array([min(drawn.get(c, 0), counts[c]) for c in cells], dtype=np.int64)
    axes = []
    for axis, wants in targets.items():
        names = sorted({c[axis] for c in cells})
        place = np.array([names.index(c[axis]) for c in cells], dtype=np.int64)
        keys = np.bincount(place, have, len(names))
        goal = np.array([wants.get(k, (0.0, 0))[0] * size for k in names])
        asked = np.array([wanted_rows(*wants[k], size) if k in wants else 0 for k in names])
        floor = np.where(keys < asked, keys, np.minimum([wants.get(k, (0.0, 0))[1] for k in names], keys))
        axes.append((place, goal, floor))

    def cost(v: np.ndarray, goal: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.abs(v - goal) + 0.02 * (v - goal) ** 2 / (goal + 1) + 1000.0 * np.maximum(0, floor - v)

    def change(k: int, sign: int) -> np.ndarray:
        """What k rows more (or less) in each cell cost by themselves."""
        out = np.zeros(len(cells))
        for place, goal, floor in axes:
            v = np.bincount(place, take, len(goal))
            out += (cost(v + sign * k, goal, floor) - cost(v, goal, floor))[place]
        return out

    def moves(k: int) -> np.ndarray:
        """What it costs to move k rows from one cell (rows) to another (columns)."""
        out = np.zeros((len(cells), len(cells)))
        for place, goal, floor in axes:
            v = np.bincount(place, take, len(goal))
            base = cost(v, goal, floor)
            m = (cost(v - k, goal, floor) - base)[:, None] + (cost(v + k, goal, floor) - base)[None, :]
            np.fill_diagonal(m, 0.0)
            out += m[np.ix_(place, place)]
        out[take < k, :] = np.inf
        out[:, have - take < k] = np.inf
        np.fill_diagonal(out, np.inf)
        return out

    while take.sum() != size:  # fill up, or give back, where it costs least
        more = take.sum() < size
        price = np.where(have > take, change(1, 1), np.inf) if more else np.where(take > 0, change(1, -1), np.inf)
        i = int(np.argmin(price))
        if not np.isfinite(price[i]) or (not more and price[i] >= 500):
            break
        room = int(have[i] - take[i]) if more else int(take[i])
        take[i] += (1 if more else -1) * max(1, min(room, int(abs(size - take.sum()) // 16)))
    step = 1 << max(0, int(take.sum()).bit_length() - 2)
    while step and len(cells) > 1:
        table_ = moves(step)
        i, j = np.unravel_index(int(np.argmin(table_)), table_.shape)
        if table_[i, j] < -1e-7:
            take[i] -= step
            take[j] += step
            continue
        # two moves together may help where each alone does not: the cheapest moves, each followed by the best that it opens
        helped = False
        if step == 1:
            order = np.argsort(table_, axis=None, kind="stable")[: 4 * len(cells)]
            for a, b in zip(*np.unravel_index(order, table_.shape), strict=True):
                if table_[a, b] > 2.0:
                    break
                take[a] -= 1
                take[b] += 1
                second = moves(1)
                c, d = np.unravel_index(int(np.argmin(second)), second.shape)
                if table_[a, b] + second[c, d] < -1e-7:
                    take[c] -= 1
                    take[d] += 1
                    helped = True
                    break
                take[a] += 1
                take[b] -= 1
        if not helped:
            step //= 2
    for axis_place, _, floor in axes:  # what a category must have goes before the size
        for k in range(len(floor)):
            own = np.flatnonzero(axis_place == k)
            lack = int(floor[k] - take[own].sum())
            for i in own:
                more = min(lack, int(have[i] - take[i]))
                if more > 0:
                    take[i] += more
                    lack -= more
    return {c: int(n) for c, n in zip(cells, take, strict=True)}


def draw_by(rows: DataFrame, key: str, wants: dict[str, Wants], part: float, seed: int = 42) -> tuple[DataFrame, bool]:
    """(the sample with its ``weighted_key``, whether the raking came to rest) of ``rows(key, a column per set)``, one row per key.

    wants: per set its categories; part: of all keys. Rows of categories without a target are drawn last.
    """
    sets = list(wants)
    for s in sets:
        known = sorted(wants[s])
        named = F.when(F.col(s).isin(known), F.col(s)).otherwise(OTHERS[1]) if known else F.lit(OTHERS[1])
        rows = rows.withColumn(s, F.when(F.col(s).isNull(), OTHERS[0]).otherwise(named))
    rows = cut(rows.select(key, *sets).withColumn("_u", unit_hash(key, seed=seed)))
    counts = {tuple(r)[:-1]: r[-1] for r in rows.groupBy(*sets).count().collect()}  # at most (categories + 2) per set
    size = math.floor(part * float(sum(counts.values())))
    targets = {a: wants[s] for a, s in enumerate(sets) if wants[s]}
    share, rested = fitted({c: float(n) for c, n in counts.items()}, {a: {k: x for k, (x, _) in t.items()} for a, t in targets.items()}, size / sum(counts.values()) if counts else 0.0)
    weight = weights(counts, share, size)
    spark, kinds = rows.sparkSession, ", ".join(f"_c{i} string" for i in range(len(sets)))
    same = reduce(lambda x, y: x & y, (F.col(s) == F.col(f"_c{i}") for i, s in enumerate(sets)))
    scales = spark.createDataFrame([(*c, w) for c, w in weight.items() if w > 0], f"{kinds}, _w double")  # cells
    keyed = rows.join(F.broadcast(scales), same, "left").drop(*(f"_c{i}" for i in range(len(sets))))
    keyed = keyed.withColumn("weighted_key", -F.log1p(-F.col("_u")) / F.col("_w")).drop("_w")
    # the smallest keys over all cells; 1 - exp(-key) puts them into [0, 1) in the same order
    ranked = hash_rank(keyed.where("weighted_key is not null").select(*sets, key, (-F.expm1(-F.col("weighted_key"))).alias("_e")), [], "_e", key)
    drawn = {tuple(r)[:-1]: r[-1] for r in ranked.where(F.col("rank") <= size).groupBy(*sets).count().collect()}
    take = repaired(drawn, counts, targets, size) if targets else {}
    quota = spark.createDataFrame([(*c, n) for c, n in take.items() if n], f"{kinds}, _n long")
    inner = hash_rank(keyed, sets, "_u", key)
    return inner.join(F.broadcast(quota), same).where("rank <= _n").select(key, *sets, "weighted_key"), rested


def _wanted(targets: DataFrame) -> tuple[dict[str, Wants], dict[str, float]]:
    """Per set its wanted categories, and the part of its keys that a sample is to have."""
    wants: dict[str, Wants] = {s: {} for s in SETS}
    part: dict[str, float] = {}
    for r in _targets(targets).collect():  # the target table
        if r.target_set in wants:
            wants[r.target_set][r.category] = (float(r.target_share or 0), int(r.min_rows or 0))
            part[r.target_set] = max(part.get(r.target_set, 0.0), float(r.sample_share or 0))
    return wants, part


def _joint(samples: DataFrame, stats: DataFrame) -> DataFrame:
    per_uuid, per_sample = _keys(samples, stats)
    return per_sample.join(per_uuid, "uuid", "left").select("sample_id", *SETS)


def _draw(samples: DataFrame, stats: DataFrame, targets: DataFrame, share: float | None, seed: int) -> tuple[DataFrame, bool]:
    wants, part = _wanted(targets)
    return draw_by(_joint(samples, stats), "sample_id", wants, share if share is not None else min(part.values(), default=0.0), seed)


def draw(samples: DataFrame, stats: DataFrame, targets: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """The sample: (sample_id, count_bucket, sample_type, focal_count, weighted_key). share: of all keys; else the least sample_share of the targets."""
    return _draw(samples, stats, targets, share, seed)[0]


def gaps(sample: DataFrame, rows: DataFrame, wants: dict[str, Wants], part: float, rested: bool) -> DataFrame:
    """What is left between a sample of ``rows`` and its targets.

    (target_set, category, target_share, reached_share, residual, min_rows, sampled, wanted, short, available, unused,
    raking_rested): residual is what was reached less the target, short the rows lacking to ``wanted``, unused the keys of the
    category that are not in the sample.
    """
    spark = rows.sparkSession
    long = lambda df, n: df.select(F.explode(F.array(*(F.struct(F.lit(s).alias("target_set"), F.col(s).alias("category")) for s in wants))).alias("x")).select("x.*").groupBy("target_set", "category").agg(F.count("*").alias(n))
    named = [(s, c, share, least) for s, of in wants.items() for c, (share, least) in of.items()]
    aim = spark.createDataFrame(named, "target_set string, category string, target_share double, min_rows long")
    taken, there = long(sample, "sampled"), long(rows, "available")
    keys = there.groupBy("target_set").agg(F.sum("available").alias("keys"))
    drawn = taken.groupBy("target_set").agg(F.sum("sampled").alias("size"))
    out = aim.join(there, ["target_set", "category"], "left").join(taken, ["target_set", "category"], "left").join(keys, "target_set", "left").join(drawn, "target_set", "left")
    out = out.na.fill(0, ["available", "sampled", "keys", "size"])
    planned = F.floor(F.lit(part) * F.col("keys").cast("double")).cast("double")
    wanted = F.greatest(F.col("min_rows"), F.ceil(F.col("target_share") * planned))
    reached = F.try_divide(F.col("sampled").cast("double"), F.col("size").cast("double"))
    return out.select("target_set", "category", "target_share", reached.alias("reached_share"), (reached - F.col("target_share")).alias("residual"), "min_rows", "sampled", wanted.alias("wanted"), F.greatest(F.lit(0), wanted - F.col("sampled")).alias("short"), "available", (F.col("available") - F.col("sampled")).alias("unused"), F.lit(rested).alias("raking_rested"))


def unserved(samples: DataFrame, stats: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(target_set, category) that cannot be served: the report of a sample of each set's own keys says that rows are short though all keys are used."""
    wants, part = _wanted(targets)
    per_uuid, per_sample = _keys(samples, stats)
    found = None
    for s, (rows, key) in {"count_bucket": (per_uuid, "uuid"), "sample_type": (per_sample, "sample_id"), "focal_count": (per_sample, "sample_id")}.items():
        if not wants[s]:
            continue
        own = rows.select(key, s)
        sample, rested = draw_by(own, key, {s: wants[s]}, part[s], seed)
        missing = gaps(sample, own, {s: wants[s]}, part[s], rested).where("short > 0 and unused = 0").select("target_set", "category")
        found = missing if found is None else found.unionByName(missing)
    return found if found is not None else samples.sparkSession.createDataFrame([], "target_set string, category string")


def _tables(spark, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples = table(spark, root, "sft_samples").select("sample_id", "source_uuid", "sample_type", "focal_tool_success_count_at_decision")
    return samples, table(spark, root, "nemotron_uuid_same_tool_success_stats").select("uuid", "max_same_tool_success_count"), table(spark, root, "sampling_targets")


def p5_found(spark, root: str) -> DataFrame:
    return unserved(*_tables(spark, root))


def p5_sample(spark, root: str) -> DataFrame:
    return draw(*_tables(spark, root))


def p5_gaps(spark, root: str) -> DataFrame:
    """The report of ``p5_sample``: residual shares and rows short per category, and what is left unused of it."""
    samples, stats, targets = _tables(spark, root)
    wants, part = _wanted(targets)
    sample, rested = _draw(samples, stats, targets, None, 42)
    return gaps(cut(sample), _joint(samples, stats), wants, min(part.values(), default=0.0), rested)
