"""Mix records of several sources to target shares of all tokens, with capped repetition.

``supply`` counts the tokens of each source and says which targets cannot be reached. ``mix`` gives every record a
number of copies: the whole part of its source's factor, and one more with the fractional part as its probability.

These probabilities are rounded by pivotal sampling on tokens: of two records of a source one gives tokens of its mass
(probability times tokens) to the other, in a random direction that keeps both expectations, until one probability is
0 or 1. So the tokens of a source stay what they are, not only its number of copies. Records are put into ranges of the
hash of their key, which are rounded apart; the one undecided record that each leaves is rounded with those of
``FAN`` neighbouring ranges, and so on up a tree, until one record per source is left. That one is decided with the one
other record that brings the source's tokens nearest to their target.

The ranges depend on keys and on the number of a source's records, never on partitions or batches: every layout, and a
task that runs again after the loss of an executor, gives the same mix.

Defined results: records without a source or without tokens are not used; sources without a target are not used; a
target without records has no copies and its whole share is lacking; a null share or cap has no copies; a repeated key
counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import folded, table
from weft.llm import bpe
from weft.operators.ranking import unit_hash
from weft.session import cut

#: Ranges whose undecided records are rounded together, and the records that a range is to have.
FAN, RANGE = 64, 4096
#: The part of all tokens with a source that a mix is to have.
PART = 0.5

_ROW = "source string, place long, doc_id long, tokens long, p double"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
_NAMES = ("source", "place", "doc_id", "tokens", "p")


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), one row per key."""
    counted = bpe.count_tokens(documents.select("doc_id", folded("source").alias("source"), "text"), "text")
    return counted.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def supply(docs: DataFrame, targets: DataFrame, part: float = PART, fill: bool = False) -> DataFrame:
    """Per target: records and tokens there are, tokens wanted, copies per record, and whether the cap allows the share.

    fill: what sources lack is handed on to those that have more, in proportion to their shares, as far as their caps allow.
    """
    have = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"), F.count_if(F.col("tokens") > 0).alias("n_docs"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total")).scalar()
    wanted = targets.select(folded("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(have, "source", "left").na.fill(0, ["available", "n_docs"])
    out = out.withColumn("wanted", F.col("target_share") * (F.lit(part) * total))
    most = F.col("available") * F.coalesce("max_repeats", F.lit(1))
    out = out.withColumn("most", most).withColumn("planned", F.least(F.col("wanted"), most.cast("double")))
    if fill:
        rows = {r.source: r for r in out.select("source", "target_share", "wanted", "most").collect()}  # the target table
        planned = _filled({s: (r.target_share or 0.0, float(r.most)) for s, r in rows.items()}, sum(r.wanted or 0.0 for r in rows.values()))
        given = docs.sparkSession.createDataFrame(sorted(planned.items()), "source string, _given double")
        out = out.join(F.broadcast(given), "source").withColumn("planned", F.col("_given")).drop("_given")
    factor = F.least(F.coalesce("max_repeats", F.lit(1)).cast("double"), F.coalesce(F.try_divide("planned", F.col("available").cast("double")), F.lit(0.0)))
    return out.select("source", "target_share", "max_repeats", "available", "n_docs", "wanted", factor.alias("factor"), (F.col("most") >= F.col("wanted")).alias("reachable"))


def _filled(sources: dict[str, tuple[float, float]], size: float) -> dict[str, float]:
    """Tokens per source (share, most tokens) that make up ``size`` in proportion to the shares, no source above its most."""
    out: dict[str, float] = {}
    free = {s: x for s, x in sources.items() if x[0] > 0}
    left = size
    while free:
        level = left / sum(share for share, _ in free.values())
        full = [s for s, (share, most) in free.items() if share * level >= most]
        if not full:
            out.update({s: share * level for s, (share, _) in free.items()})
            break
        for s in full:
            out[s] = free.pop(s)[1]
            left = max(0.0, left - out[s])
    return {s: out.get(s, 0.0) for s in sources}


def _unit(*parts: object) -> float:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:7]) / (1 << 56)


def pivotal(rows: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Round the probabilities of (source, doc_id, tokens, p, place): the decided rows, and the one left over.

    Of two rows one gets tokens of the other until either is decided; each direction is as likely as the other's step is
    large, so that no row's expectation changes.
    """
    decided: list[tuple] = []
    held = None
    for row in rows:
        held, done = _meet(held, row, seed)
        decided += done
    return decided, held


def _meet(held: tuple | None, row: tuple, seed: int, near: float = 1e-9) -> tuple[tuple | None, list[tuple]]:
    """The row that stays undecided of the two, if any, and those that are decided."""
    settled = lambda r: not near < r[3] < 1 - near
    whole = lambda r: (*r[:3], float(round(r[3])), *r[4:])
    if settled(row):
        return held, [whole(row)]
    if held is None:
        return row, []
    (s, a, ta, pa_, *x), (_, b, tb, pb, *y) = held, row
    up, down = min((1 - pa_) * ta, pb * tb), min(pa_ * ta, (1 - pb) * tb)  # tokens that a can get and give
    step = up if _unit(seed, a, b) * (up + down) < down else -down
    two = ((s, a, ta, pa_ + step / ta, *x), (s, b, tb, pb - step / tb, *y))
    open_ = [r for r in two if not settled(r)]
    return (open_[0] if open_ else None), [whole(r) for r in two if settled(r)]


def _rounder(seed: int):
    """Rounds runs of rows of one source and place, as they come sorted; a run may go over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=list(_NAMES))
        at, held = None, None
        for batch in batches:
            out = []
            for source, place, doc, tokens, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (source, place):
                    if held is not None:
                        out.append((held[0], held[4], held[1], held[2], held[3]))
                    at, held = (source, place), None
                held, done = _meet(held, (source, doc, tokens, p, place), seed)
                out += [(r[0], r[4], r[1], r[2], r[3]) for r in done]
            yield packed(out)
        if held is not None:
            yield packed([(held[0], held[4], held[1], held[2], held[3])])

    return run


def round_probabilities(probable: DataFrame, ranges: dict[str, int], seed: int) -> DataFrame:
    """``probable(source, doc_id, tokens, p)`` with p rounded to 0 or 1, the tokens per source kept.

    ranges: per source into how many ranges of the keys' hashes its records go.
    """
    spark = probable.sparkSession
    parts = F.broadcast(spark.createDataFrame(sorted(ranges.items()), "source string, _n long"))  # the sources of the target table
    rows = probable.join(parts, "source").withColumn("_u", unit_hash("doc_id", seed=seed)).withColumn("place", F.least(F.floor(F.col("_u") * F.col("_n")), F.col("_n") - 1))

    def level(df: DataFrame, *order: str) -> DataFrame:
        grouped = df.repartition("source", "place").sortWithinPartitions("source", "place", *order, "doc_id")
        return cut(grouped.select(*_NAMES).mapInArrow(_rounder(seed), _ROW))

    rest, done, width = level(rows, "_u"), None, max(ranges.values(), default=1)
    while width > 1:
        ready = rest.where("p = 0 or p = 1")
        done = ready if done is None else done.unionByName(ready)
        rest = level(rest.where("p > 0 and p < 1").withColumn("place", F.floor(F.col("place") / FAN)))
        width = -(-width // FAN)
    done = rest if done is None else done.unionByName(rest)
    return _last(done).select("source", "doc_id", "tokens", "p")


def _last(rounded: DataFrame) -> DataFrame:
    """Decides the one record per source that is left, together with the one other that brings the tokens nearest to their sum."""
    last = {r.source: r for r in rounded.where("p > 0 and p < 1").collect()}  # at most one per source of the target table
    if not last:
        return rounded
    mass = rounded.sparkSession.createDataFrame([(s, r.doc_id, float(r.tokens), float(r.p)) for s, r in last.items()], "source string, _id long, _t double, _p double")
    each = rounded.where("p = 0 or p = 1").join(F.broadcast(mass), "source")
    keep, drop = F.col("_t") * (1 - F.col("_p")), F.col("_t") * F.col("_p")  # tokens too many if it is kept, too few if it is dropped
    alone = F.least(keep, drop)
    # another record goes in where it is dropped, or out where it is kept
    error = F.when(F.col("p") == 0, F.abs(F.col("tokens") - drop)).otherwise(F.abs(F.col("tokens") - keep))
    best = each.groupBy("source", "_id", "_t", "_p").agg(F.min(F.struct(error.alias("e"), "doc_id", "p")).alias("b")).collect()
    changed = {}
    for r in best:
        if r.b.e < min(r._t * (1 - r._p), r._t * r._p):
            changed[r.source] = (r.b.doc_id, 1.0 - r.b.p)
            last[r.source] = (r._id, r.b.p)
    for s, r in last.items():
        if s not in changed:
            last[s] = (r.doc_id, 1.0 if r.tokens * (1 - r.p) <= r.tokens * r.p else 0.0)
    fixes = [(doc, s, float(p)) for s, (doc, p) in [*last.items(), *changed.items()]]
    fix = rounded.sparkSession.createDataFrame(fixes, "doc_id long, source string, _new double")
    return rounded.join(F.broadcast(fix), ["source", "doc_id"], "left").withColumn("p", F.coalesce("_new", "p")).drop("_new")


def mix(docs: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, copies) of the records that are used; copies are at most max_repeats."""
    chosen = plan.where("factor > 0").select("source", "factor", "n_docs").collect()  # the target table
    ranges = {r.source: 1 << max(0, (r.n_docs - 1) // RANGE).bit_length() for r in chosen}
    factors = docs.sparkSession.createDataFrame([(r.source, float(r.factor)) for r in chosen], "source string, factor double")
    rows = docs.where("tokens > 0").join(F.broadcast(factors), "source").select("source", "doc_id", "tokens", (F.col("factor") - F.floor("factor")).alias("p"))
    rounded = round_probabilities(rows, ranges, seed)
    out = rounded.join(F.broadcast(factors), "source").select("doc_id", "source", "tokens", (F.floor("factor") + F.col("p").cast("int")).cast("int").alias("copies"))
    return out.where("copies > 0")


def shares(docs: DataFrame, plan: DataFrame, mixed: DataFrame, part: float = PART) -> DataFrame:
    """Per target the tokens mixed, their share of the size that was planned and of the mix as it is, and what is lacking.

    The actual shares of a mix sum to 1. saturated: every record stands in the mix as often as its cap allows.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("records"))
    size = docs.where("source is not null").agg((F.sum("tokens") * F.lit(part)).alias("size")).scalar()
    all_ = got.agg(F.sum("tokens").alias("n")).scalar()
    tokens = F.coalesce("tokens", F.lit(0))
    return plan.join(got, "source", "left").select(
        "source", "target_share", F.try_divide(tokens.cast("double"), size).alias("reached_share"), F.try_divide(tokens.cast("double"), all_.cast("double")).alias("actual_share"), tokens.alias("tokens"), "wanted",
        F.greatest(F.lit(0.0), F.col("wanted") - tokens).alias("lacking"), "available", "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("records", F.lit(0)).alias("records"),
        (tokens == F.col("available") * F.coalesce("max_repeats", F.lit(1))).alias("saturated"),
    )


def _docs(spark, root: str) -> DataFrame:
    return cut(sized(table(spark, root, "documents").select("doc_id", "source", "text")))


def _shares(spark, root: str, fill: bool = False) -> DataFrame:
    docs = _docs(spark, root)
    plan = cut(supply(docs, table(spark, root, "mix_targets"), fill=fill))
    return shares(docs, plan, mix(docs, plan))


def p8_found(spark, root: str) -> DataFrame:
    """Targets that the mix does not reach though every record of theirs is used as often as it may be."""
    return _shares(spark, root).where("saturated and tokens < wanted").select("source")


def p8_mix(spark, root: str) -> DataFrame:
    docs = _docs(spark, root)
    return mix(docs, cut(supply(docs, table(spark, root, "mix_targets"))))


def p8_shares(spark, root: str) -> DataFrame:
    """Per target the share reached in the mix, and what it lacks; a source that lacks tokens leaves the mix smaller."""
    return _shares(spark, root)


def p8_filled(spark, root: str) -> DataFrame:
    """The same where sources that have more make up for what others lack, in proportion to their shares."""
    return _shares(spark, root, fill=True)
