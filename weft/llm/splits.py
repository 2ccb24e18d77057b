"""Train, validation and test splits that keep related records together.

``components`` makes one row per source, with its number of records and its profile: how many of them each label has.
``allocate`` bundles components of identical size and profile, has ``solve`` find the flow of bundles to splits in one
task, and gives each component its split by its rank among the hashes of its bundle.

``solve`` finds a min-cost flow of whole components from bundles to splits. What a split or a label within a split has
too much or too little costs its square, in units of its quota, so that deviations are spread and not pushed into
corners. A first flow meets the split quotas under the sizes that fit; then residual cycles (split to bundle to
other split) of negative cost are cancelled, each with as many components as pay, until there is none. All flows are
whole numbers of components, so nothing is left to round.

Bundles are exact however many there are, so that a component's bundle depends on that component alone. None reach the
driver; the task that solves the flow holds numbers for each distinct bundle and for each label in it.

Defined results: a null source is a component per record; a repeated key counts once, with its least label and all its
partitions; null labels are a label; an empty table has no rows; a component larger than every quota goes where it costs
least; without targets no component has a split.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import folded, plain_uuid, table
from weft.operators.ranking import hash_rank, unit_hash
from weft.session import cut

DELIVERED = ("train", "validation", "test_iid", "test_ood")
#: What a split's deviation weighs beside that of one label within it.
SPLIT_WEIGHT = 8.0


def components(samples: DataFrame) -> DataFrame:
    """(component, source_uuid, size, profile, parts, delivered) of ``samples(sample_id, source_uuid, partition, sample_type)``.

    profile: array of (label, n) in order of labels; parts: the known partitions that the delivered data spread it over, delivered of them.
    """
    rows = samples.where("sample_id is not null").select("sample_id", plain_uuid("source_uuid").alias("source_uuid"), folded("partition").alias("partition"), F.coalesce(folded("sample_type"), F.lit("")).alias("label"))
    rows = rows.distinct().withColumn("component", F.coalesce("source_uuid", F.concat(F.lit("sample:"), "sample_id")))
    known = F.when(F.col("partition").isin(*DELIVERED), F.col("partition"))
    # one row per key first, then per label, so that a hot source is summed up before it is shuffled
    keys = rows.groupBy("sample_id", "component", "source_uuid").agg(F.min("label").alias("label"), F.collect_set(known).alias("parts"))
    by_label = keys.groupBy("component", "source_uuid", "label").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("parts"))).alias("parts"))
    profile = F.array_sort(F.collect_list(F.struct("label", "n")))
    whole = by_label.groupBy("component", "source_uuid").agg(F.sum("n").alias("size"), profile.alias("profile"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts"))
    return whole.withColumn("delivered", F.size("parts"))


def min_cost_flow(arcs: list[tuple[str, str, float, float]], source: str, sink: str) -> dict[tuple[str, str], float]:
    """Flow per arc that carries as much as possible at least cost: successive shortest paths with potentials.

    arcs: (tail, head, capacity, cost), costs not negative. Parallel arcs are summed up in the result.
    """
    graph: dict[str, list[list]] = defaultdict(list)  # head, capacity, cost, index of the reverse arc, forward
    for tail, head, capacity, cost in arcs:
        if capacity > 0:
            graph[tail].append([head, capacity, cost, len(graph[head]), True])
            graph[head].append([tail, 0.0, -cost, len(graph[tail]) - 1, False])
    height: dict[str, float] = defaultdict(float)
    while True:
        best, via, queue = {source: 0.0}, {}, [(0.0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > best[u] + 1e-12:
                continue
            for i, (v, capacity, cost, _, _) in enumerate(graph[u]):
                new = d + cost + height[u] - height[v]
                if capacity > 1e-9 and new < best.get(v, float("inf")) - 1e-12:
                    best[v], via[v] = new, (u, i)
                    heapq.heappush(queue, (new, v))
        if sink not in best:
            break
        for node in graph:
            height[node] += best.get(node, best[sink])
        push, v = float("inf"), sink
        while v != source:
            u, i = via[v]
            push, v = min(push, graph[u][i][1]), u
        v = sink
        while v != source:
            u, i = via[v]
            graph[u][i][1] -= push
            graph[v][graph[u][i][3]][1] += push
            v = u
    flow: dict[tuple[str, str], float] = defaultdict(float)
    for u, out in list(graph.items()):
        for v, _, _, back, forward in out:
            if forward:
                flow[u, v] += graph[v][back][1]
    return flow


def plan(bundles: list[tuple[str, float, dict[str, float], int]], shares: dict[str, float], rounds: int = 1_000_000) -> dict[str, list[tuple[str, int]]]:
    """Whole components per bundle and split. bundles: (bundle, size, rows per label, components).

    The result depends on the bundles alone, not on their order.
    """
    bundles = sorted(bundles)
    splits = sorted(shares)
    if not bundles or not splits:
        return {b[0]: [] for b in bundles}
    place = {label: i for i, label in enumerate(sorted({label for _, _, profile, _ in bundles for label in profile}))}
    labels = np.array([place[label] for _, _, profile, _ in bundles for label in profile], dtype=np.int64)
    rows = np.array([n for _, _, profile, _ in bundles for n in profile.values()], dtype=float)
    x = solve(np.array([b[1] for b in bundles], dtype=float), np.array([b[3] for b in bundles], dtype=np.int64), np.array([len(b[2]) for b in bundles], dtype=np.int64), labels, rows, np.array([shares[s] for s in splits], dtype=float), rounds)
    return {b[0]: [(s, int(k)) for s, k in zip(splits, row, strict=True) if k] for b, row in zip(bundles, x, strict=True)}


def solve(size: np.ndarray, n: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rows: np.ndarray, share: np.ndarray, rounds: int = 1_000_000) -> np.ndarray:
    """Whole components per bundle (row) and split (column), for bundles in a fixed order.

    size, n and lengths have an item per bundle: its size, components and number of labels; labels (numbered from 0) and
    rows have one per bundle and label. ``rounds`` only guards against endless work: each round cancels the cheapest
    residual cycle, which lowers the cost.
    """
    share = share / share.sum()
    splits = range(len(share))
    quota = (size * n).sum() * share
    # the first flow: rows by the splits that their components fit into, free up to the quotas
    widest = int(np.argmax(quota))
    fits = size[:, None] <= quota[None, :]
    fits[~fits.any(axis=1), widest] = True
    kinds, seen, kind = np.unique(fits, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    held_by = np.bincount(kind, weights=size * n)
    arcs: list[tuple[str, str, float, float]] = []
    for j in np.argsort(seen):
        arcs.append(("source", f"fits/{j}", float(held_by[j]), 0.0))
        arcs += [(f"fits/{j}", f"split/{s}", float(held_by[j]), 0.0) for s in splits if kinds[j, s]]
    for s in splits:
        arcs += [(f"split/{s}", "sink", float(quota[s]), 0.0), (f"split/{s}", "sink", float((size * n).sum()), 1.0)]
    flow = min_cost_flow(arcs, "source", "sink")
    part = np.array([[flow[f"fits/{j}", f"split/{s}"] for s in splits] for j in range(len(kinds))])
    x = np.floor(n[:, None] * part[kind] / held_by[kind, None] + 1e-9).astype(np.int64)
    # what each bundle holds of every label, and last its size, as entries of a sparse matrix: a column per label and one for sizes
    sizes = int(labels.max(initial=-1)) + 1
    ends = np.cumsum(lengths)
    column, value = np.insert(labels, ends, sizes), np.insert(rows, ends, size)
    stop = ends + np.arange(1, len(ends) + 1)
    start = stop - lengths - 1
    spread = lambda per_bundle: np.repeat(per_bundle, lengths + 1)
    times = lambda per_column: np.add.reduceat(value * per_column[column], start)
    # deviations from the quotas of labels within splits, and of splits: the last column
    want = np.bincount(column, weights=value * spread(n))[:, None] * share[None, :]
    weight = np.where(want > 0, 1.0 / np.maximum(want, 1e-12), 0.0)
    weight[-1] *= SPLIT_WEIGHT
    off = np.stack([np.bincount(column, weights=value * spread(x[:, s])) for s in splits], axis=1) - want
    square = np.stack([np.add.reduceat(value**2 * weight[column, s], start) for s in splits], axis=1)
    for i in np.lexsort((np.arange(len(n)), -size)):  # what the floors left over goes where it costs least, large components first
        left = int(n[i] - x[i].sum())
        if left:
            c, v = column[start[i] : stop[i]], value[start[i] : stop[i]]
            for _ in range(left):
                cost = 2 * v @ (off[c] * weight[c]) + square[i]
                s = int(np.argmin(np.where(fits[i], cost, np.inf)))
                x[i, s] += 1
                off[c, s] += v
    pairs = [(a, b) for a in splits for b in splits if a != b]
    slope = np.stack([times(off[:, s] * weight[:, s]) for s in splits], axis=1)
    for _ in range(rounds if pairs else 0):
        best = (-1e-9, None)
        for a, b in pairs:
            bend = np.maximum(square[:, a] + square[:, b], 1e-300)
            steps = np.clip(np.rint((slope[:, a] - slope[:, b]) / bend), 0, x[:, a])
            steps = np.where(fits[:, b], steps, 0)
            change = 2 * steps * (slope[:, b] - slope[:, a]) + steps**2 * bend
            i = int(np.argmin(change))
            if change[i] < best[0]:
                best = (float(change[i]), (i, a, b, int(steps[i])))
        if best[1] is None:
            break
        i, a, b, k = best[1]
        c, v = column[start[i] : stop[i]], value[start[i] : stop[i]]
        x[i, a] -= k
        x[i, b] += k
        for s, moved in ((a, -k), (b, k)):
            step = np.zeros(sizes + 1)
            step[c] = v * weight[c, s]
            slope[:, s] += moved * times(step)
    return x


def _bundles(parts: DataFrame) -> DataFrame:
    """``parts`` with the column ``bundle``, a key of a component's size and profile and of nothing else."""
    profile = F.transform("profile", lambda p: F.struct(p["label"].alias("l"), p["n"].cast("long").alias("n")))
    return parts.withColumn("bundle", F.md5(F.to_json(F.struct(F.col("size").cast("long").alias("s"), profile.alias("p")))))


def _solver(share: list[float], batch: int = 50_000):
    """The function over all bundles, in their order, that gives each the number of components up to the end of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        given = pa.Table.from_batches(held)
        flat = pc.list_flatten(given["labels"])
        named = pc.unique(flat)
        labels = pc.index_in(flat, value_set=named.take(pc.sort_indices(named)))
        number = lambda c, kind: c.to_numpy().astype(kind)
        x = solve(number(given["size"], float), number(given["n"], np.int64), number(pc.list_value_length(given["labels"]), np.int64), number(labels, np.int64), number(pc.list_flatten(given["rows"]), float), np.array(share))
        ends = np.cumsum(x, axis=1)
        for i in range(0, len(ends), batch):
            some = ends[i : i + batch]
            high = pa.ListArray.from_arrays(np.arange(0, some.size + 1, len(share), dtype=np.int32), pa.array(some.reshape(-1)))
            yield pa.RecordBatch.from_arrays([given["bundle"].slice(i, batch).combine_chunks(), high], names=["b", "high"])

    return run


def allocate(parts: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``parts`` with the columns ``bundle`` and ``split``; ``targets(split_name, target_share)``."""
    shares = {r[0]: float(r[1]) for r in targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share")).collect()}
    tagged = _bundles(parts)
    if not shares:
        return tagged.withColumn("split", F.lit(None).cast("string"))
    counted = tagged.groupBy("bundle", "size", "profile").agg(F.count("*").alias("n"))
    given = counted.select("bundle", F.col("size").cast("long").alias("size"), "n", F.col("profile")["label"].alias("labels"), F.col("profile")["n"].cast("array<long>").alias("rows"))
    # one row per distinct bundle, all in one task; solved once and written, as later stages read it
    solved = cut(given.repartition(1).sortWithinPartitions("bundle").mapInArrow(_solver([shares[s] for s in sorted(shares)]), "b string, high array<long>"))
    ranked = hash_rank(tagged.withColumn("_u", unit_hash("component", seed=seed)), ["bundle"], "_u", "component")
    placed = F.size(F.filter("high", lambda h: h < F.col("rank")))
    return ranked.join(solved, F.col("bundle") == F.col("b"), "left").withColumn("split", F.get(F.array(*(F.lit(s) for s in sorted(shares))), placed)).drop("b", "high", "_u", "rank")


def torn(allocated: DataFrame) -> DataFrame:
    """(component, source_uuid) of the components that the delivered partitions spread over several, and the allocation puts into one split."""
    each = allocated.where("split is not null").select("component", "source_uuid", "split", F.explode("parts").alias("part"))
    by = each.groupBy("component", "source_uuid").agg(F.count_distinct("part").alias("n_parts"), F.count_distinct("split").alias("n_splits"))
    return by.where("n_parts > 1 and n_splits = 1").select("component", "source_uuid")


def _allocated(spark, root: str) -> DataFrame:
    parts = cut(components(table(spark, root, "sft_samples").select("sample_id", "source_uuid", "partition", "sample_type")))
    return allocate(parts, table(spark, root, "split_targets"))


def p4_assignment(spark, root: str) -> DataFrame:
    return _allocated(spark, root).select("source_uuid", "component", F.col("size").alias("n_rows"), "split", "bundle")


def p4_found(spark, root: str) -> DataFrame:
    """Sources whose delivered rows stand in several partitions, against the one split that the allocation gives them."""
    return torn(_allocated(spark, root)).where("source_uuid is not null").select("source_uuid")


def p4_report(spark, root: str) -> DataFrame:
    """Rows per split, and per label within each split, with the share reached beside the target; ``label`` is null for the whole split."""
    rows = cut(_allocated(spark, root).select("split", "size", F.explode("profile").alias("p")).groupBy("split", "p.label").agg(F.sum("p.n").alias("n_rows")))
    by = rows.rollup("label", "split").agg(F.sum("n_rows").alias("n_rows"), F.grouping_id().alias("g"))
    per = rows.groupBy("label").agg(F.sum("n_rows").alias("n")).unionByName(rows.agg(F.sum("n_rows").alias("n")).select(F.lit(None).cast("string").alias("label"), "n"))
    whole = rows.groupBy("split").agg(F.sum("n_rows").alias("n_rows")).withColumn("label", F.lit(None).cast("string"))
    got = by.where("g = 0").select("split", "label", "n_rows").unionByName(whole.select("split", "label", "n_rows"))
    targets = table(spark, root, "split_targets").where("split_name is not null").groupBy(F.col("split_name").alias("split")).agg(F.max("target_share").alias("target_share"))
    wanted = per.select("label", "n", F.explode(targets.agg(F.collect_list(F.struct("split", "target_share"))).scalar()).alias("t")).select("label", "n", "t.split", "t.target_share")
    n = F.coalesce("n_rows", F.lit(0))
    out = wanted.alias("w").join(got.alias("g"), F.col("w.split").eqNullSafe(F.col("g.split")) & F.col("w.label").eqNullSafe(F.col("g.label")), "left")
    return out.select("w.split", "w.label", "w.target_share", n.alias("n_rows"), F.try_divide(n.cast("double"), F.col("w.n").cast("double")).alias("share"), (F.try_divide(n.cast("double"), F.col("w.n").cast("double")) - F.col("w.target_share")).alias("deviation"))
