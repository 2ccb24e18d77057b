"""Ranks within groups of any size, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut


def unit_hash(*columns: Column | str, seed: int = 42) -> Column:
    """A value in [0, 1) that only depends on the columns and the seed, the same on every machine and at every try.

    The top 53 bits of a sha-256, so that ties only come from equal keys.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def hash_rank(df: DataFrame, groups: list[str], unit: str, tie: str, buckets: int = 1024, name: str = "rank", size: str | None = None) -> DataFrame:
    """Add the rank (from 1) of each row within its group by ``unit`` in [0, 1), ties by ``tie``.

    A group is cut into equal ranges of ``unit``; ranges are counted, the counts summed up per group (a window over at
    most ``buckets`` rows), and rows only ranked within their range. A group of a third of all rows is so spread over
    ``buckets`` keys. ``size`` names a column for the number of rows of the group, which comes with the counts.
    """
    cut_up = df.withColumn("_range", F.least(F.floor(F.col(unit) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = cut_up.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"), *([F.sum("_n").over(Window.partitionBy(*groups)).alias(size)] if size else []))
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(unit, tie))
    ranked = cut_up.withColumn("_inner", inner).join(starts, same)
    return ranked.withColumn(name, F.col("_inner") + F.col("_before")).drop("_range", "_r", "_before", "_inner", *(f"_g_{g}" for g in groups))


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """Rows addressed by a stable number in the order of a key, from 0; every row keeps its number whatever the layout of later stages.

    Rows are put into ranges of the key and sorted there once; the number of the range and the place in it are written with
    the row, so that no later stage works them out again. Only one count per range goes to the broadcast side. Rows with
    equal keys get different numbers, in any order among themselves; an empty table stays empty.
    """
    address = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_a", address))
    ranged = ranged.withColumn("_p", F.shiftright("_a", 33)).withColumn("_i", F.col("_a").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    return ranged.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("row_index", F.col("_b") + F.col("_i")).drop("_a", "_p", "_q", "_i", "_b")  # one row per partition


def batches(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows with the number of their batch of ``n``, from 0, in the order of a key."""
    return with_row_index(df, *order).withColumn("batch", F.floor(F.col("row_index") / n)).drop("row_index")
