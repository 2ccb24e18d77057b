"""Leak-free splits: checks of the input, stratified and hashed assignment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.common import one_per_key
from weft.functions.text import count_bucket, hash_unit, to_validation
from weft.operators.ranking import hash_rank

SUBSETS = ("tool_calling", "interactive_agent")


class InvalidInput(ValueError):
    """The input breaks a rule; the message has up to ten examples."""


def check_ratios(ratios: tuple[float, ...]) -> None:
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise InvalidInput(f"ratios must be positive and sum to 1: {ratios}")


def check_input(stats: DataFrame, key: str = "uuid", columns: tuple[str, ...] = ("uuid", "split", "max_same_tool_success_count")) -> None:
    """Raise on missing columns, null keys, repeated keys and unknown subsets; only examples reach the driver."""
    missing = [c for c in columns if c not in stats.columns]
    if missing:
        raise InvalidInput(f"missing columns: {missing}")
    tests = {
        "null keys": stats.where(F.col(key).isNull()).select(F.lit("null").alias("x")),
        "repeated keys": stats.groupBy(key).count().where("count > 1").select(F.col(key).alias("x")),
        "unknown subsets": stats.where(~F.coalesce(F.col("split").isin(*SUBSETS), F.lit(False))).select(F.coalesce("split", F.lit("null")).alias("x")),
    }
    for name, bad in tests.items():
        examples = [r.x for r in bad.limit(10).collect()]
        if examples:
            raise InvalidInput(f"{name}: {examples}")


def manifest(stats: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Statistics rows with bucket, flags and partition: tool_calling split within each bucket, interactive_agent all test_ood.

    Within a bucket, rows are ranked by the hash of their key and cut at the floors of the shares, so the split is the
    same for every layout of the input. Repeated uuids count once; other subsets have no partition.
    """
    check_ratios(ratios)
    rows = one_per_key(stats.where("uuid is not null"), "uuid")
    n = F.col("max_same_tool_success_count")
    rows = rows.withColumns({"source_subset": F.col("split"), "success_count_bucket": count_bucket(n), "is_trigger_ge_3": (n >= 3).cast("int"), "is_trigger_gt_3": (n > 3).cast("int"), "_u": hash_unit(F.lit(str(seed)), "uuid")})
    calling = hash_rank(rows.where("split = 'tool_calling'"), ["success_count_bucket"], "_u", "uuid", size="_size")
    train, upto = F.floor(F.col("_size") * ratios[0]), F.floor(F.col("_size") * (ratios[0] + ratios[1]))
    calling = calling.withColumn("data_partition", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= upto, "validation").otherwise("test_iid")).drop("rank", "_size")
    agents = rows.where("split = 'interactive_agent'").withColumn("data_partition", F.lit("test_ood"))
    return calling.unionByName(agents).drop("_u")


def leaks(parts: DataFrame, key: str = "uuid", part: str = "data_partition") -> DataFrame:
    """Keys that stand in more than one partition."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("n_partitions")).where("n_partitions > 1")


def combined(*parts: DataFrame, key: str = "uuid", part: str = "data_partition") -> DataFrame:
    """All partitions as one table; raises if a key is null, repeated or in two of them, naming up to ten."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bad = [r[0] for r in out.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(10).collect()]
    if bad:
        raise InvalidInput(f"keys that are null or come again: {bad}")
    return out


def unprocessed(parts: DataFrame, done: DataFrame, key: str = "uuid") -> DataFrame:
    """Keys of a manifest that were not processed."""
    return parts.select(key).join(done.select(key), key, "left_anti")


def summary(parts: DataFrame) -> DataFrame:
    """Per partition: rows, subsets, buckets, flags with ratios, sums of results."""
    n = F.count("*")
    have = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    by = parts.groupBy("data_partition").agg(
        n.alias("uuid_count"), *(have("source_subset", s) for s in SUBSETS), *(have("success_count_bucket", b) for b in ("c0", "c1", "c2", "c3", "c4_plus")),
        F.sum("is_trigger_ge_3").alias("same_tool_success_ge_3"), F.sum("is_trigger_gt_3").alias("same_tool_success_gt_3"),
        *(F.coalesce(F.sum(f"{r}_count"), F.lit(0)).alias(f"total_{r}_calls") for r in ("success", "failure", "unknown")),
    )
    return by.withColumns({f"same_tool_success_{x}_3_ratio": F.coalesce(F.try_divide(F.col(f"same_tool_success_{x}_3").cast("double"), F.col("uuid_count")), F.lit(0.0)) for x in ("ge", "gt")})


def group_split(rows: DataFrame, key, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_validation``, equal for all rows of one group key."""
    return rows.withColumn("is_validation", to_validation(key, ratio, seed))
