"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the input tables below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def strip(c: Column | str) -> Column:
    """Drop outer white space of any kind (``trim`` only drops blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column | str) -> Column:
    """Text compared without outer blanks and case; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def plain_uuid(c: Column | str) -> Column:
    """A uuid in any usual spelling (braces, ``urn:uuid:``, no hyphens, upper case) in lower case with hyphens.

    What is no uuid is only folded, so that it still is a key of its own.
    """
    low = folded(c)
    digits = F.regexp_replace(F.regexp_replace(low, r"^urn:uuid:", ""), r"[{}\-\s]", "")
    hyphened = F.regexp_replace(digits, r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), hyphened).otherwise(low)


def one_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, the same for every layout: of repeats that differ the greatest in the order of the columns, so a value goes before a null.

    Maps are compared by their entries in the order of their keys. Rows are combined before they are shuffled; a null key is a key.
    """
    maps = {f.name for f in rows.schema if f.dataType.typeName() == "map"}
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    packed = F.struct(*(F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rest))
    best = rows.groupBy(*keys).agg(F.max(packed).alias("_best"))
    value = lambda c: (F.map_from_entries(F.col("_best")[c]) if c in maps else F.col("_best")[c]).alias(c)
    return best.select(*(F.col(c) if c in keys else value(c) for c in rows.columns))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
