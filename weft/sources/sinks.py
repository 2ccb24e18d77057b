"""Writers: JSON lines, fan-out by partition and type, CSV exports, summaries, configs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class NothingWritten(ValueError):
    """A sink that must not stay empty got no row."""


def jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> int:
    """JSON lines, counted on the way; returns the rows."""
    seen = Observation("rows")
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)
    return int(seen.get["n"])


def jsonl_required(df: DataFrame, path: str) -> int:
    """As ``jsonl``, but raises if there was no row."""
    n = jsonl(df, path)
    if not n:
        raise NothingWritten(path)
    return n


def fan_out(df: DataFrame, path: str, *columns: str) -> None:
    """One pass, a folder per combination: reading one partition or type then reads no other."""
    df.write.mode("overwrite").partitionBy(*columns).json(path)


def samples(df: DataFrame, path: str, partitions: Sequence[str] = (), types: Sequence[str] = ()) -> None:
    """Samples by partition and type in one pass; the combinations of ``partitions`` and ``types`` without a row get an empty folder."""
    fan_out(df.withColumns({"part": F.col("partition"), "type": F.col("sample_type")}), path, "part", "type")
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in partitions:
        for t in types:
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}/type={t}")
            place.getFileSystem(conf).mkdirs(place)


def train_validation(df: DataFrame, path: str) -> None:
    """The raw rows of both splits, by the flag ``is_validation``."""
    fan_out(df.withColumn("split", F.when(F.col("is_validation"), "validation").otherwise("train")).drop("is_validation"), path, "split")


def csv(df: DataFrame, path: str, *order: str, single: bool = False) -> None:
    """CSV with doubled quotes, sorted by ``order`` over all files, whose names are in that order; ``single`` is for small exports."""
    rows = df.orderBy(*order) if order else df
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def partition_csvs(df: DataFrame, path: str, part: str = "data_partition", key: str = "uuid") -> None:
    """A folder of CSV files per partition, sorted by key over its files: each task holds one range of partition and key."""
    df.repartitionByRange(part, key).sortWithinPartitions(part, key).write.mode("overwrite").partitionBy(part).option("header", True).option("escape", '"').csv(path)


def summary(spark: SparkSession, path: str, values: dict[str, Any]) -> None:
    """A small JSON document, written through Spark so that any file system will do."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_config(spark: SparkSession, path: str, config: dict[str, Any]) -> str:
    """The frozen config of a run, keys sorted, beside its results; returns its hash of 16 hex digits."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_summary(df: DataFrame, keys: list[str], value: str) -> dict[str, Any]:
    """A small aggregate as nested dictionaries, ready for ``summary``."""
    out: dict[str, Any] = {}
    for row in df.select(*keys, value).collect():
        node = out
        for k in keys[:-1]:
            node = node.setdefault(str(row[k]), {})
        node[str(row[keys[-1]])] = row[value]
    return out


def predictions(scored: DataFrame, metrics: DataFrame, path: str) -> None:
    """The scored rows and their metrics side by side."""
    scored.write.mode("overwrite").json(f"{path}/predictions.jsonl")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics.json")


def scalar(value: Any) -> str:
    """A YAML scalar: booleans and numbers bare, all else, None too, as the JSON of its text."""
    bare = isinstance(value, (int, float))
    shown = str(value)
    return (shown.lower() if isinstance(value, bool) else shown) if bare else json.dumps(shown, ensure_ascii=False)


def yaml(values: dict[str, Any]) -> str:
    return "".join(f"{k}: {scalar(v)}\n" for k, v in values.items())


def dataset_info(name: str, file_name: str) -> str:
    """The description of a ShareGPT data set."""
    columns = {"messages": "conversations"}
    tags = {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "system_tag": "system"}
    return json.dumps({name: {"file_name": file_name, "formatting": "sharegpt", "columns": columns, "tags": tags}}, indent=2)
