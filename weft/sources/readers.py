"""Readers: JSON lines and arrays, CSV manifests, Parquet trajectories, metrics files, logs, registry tables.

All are lazy DataFrames, but for numbered lines, which are written with their numbers once. Only the first character of a
path (its format), the part of a log that was asked for and the ten examples of an error reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.session import cut

METRIC_FILES = ("metrics.json", "eval_results.json", "train_results.json")


class BadInput(ValueError):
    """Input that breaks the reader's rules."""


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, strict: blank lines are passed over, a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def sniff(spark: SparkSession, path: str) -> str:
    """``array`` or ``lines`` by the first character that is no white space, a byte-order mark aside; raises if there is none.

    Lines are read up to the first that is not blank, wherever it stands; all files of a path have one format.
    """
    mark = F.regexp_extract("value", r"(?U)^\x{FEFF}?\s*([^\s\x{FEFF}])", 1)
    head = spark.read.text(path).select(mark.alias("c")).where("c <> ''").limit(1).collect()
    if not head:
        raise BadInput(f"{path} is empty")
    return "array" if head[0].c == "[" else "lines"


def json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines or one JSON array, whichever the file is."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", sniff(spark, path) == "array").json(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, record): the records of JSON lines or of JSON arrays as texts with their number from 1 in their file.

    Lines keep the numbers of their places, blank ones are left out. A file of lines is read in as many parts as it has; the
    lines before a part are counted, and a line's number is that count and its place in the part. An array is one JSON value
    and is read as one. A file that does not end in a new line counts its last line, too.
    """
    place = F.col("_metadata.file_path").alias("file")
    if sniff(spark, path) == "array":
        items = F.try_variant_get(F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")), "$", "array<variant>")
        rows = spark.read.text(path, wholetext=True).select(place, F.posexplode(items).alias("n", "x"))
        return rows.select("file", (F.col("n") + 1).cast("long").alias("record_no"), F.to_json("x").alias("record"))
    lines = cut(spark.read.text(path).select(place, F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("record")))
    parts = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "part", "first", before.alias("before"))  # one row per part of a file
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts
    return lines.join(parts, ["file", "part"]).where(r"record rlike '\\S'").select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("record_no"), "record")


def lenient(spark: SparkSession, path: str, schema: str, required: list[str], order: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows with all required fields, up to ``most`` in order of a key, and those that are broken or lack one."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", sniff(spark, path) == "array").json(path)
    ok = F.col("_corrupt_record").isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    marked = rows.withColumn("_ok", ok)
    valid = marked.where("_ok").drop("_ok", "_corrupt_record")
    if most is not None:
        valid = valid.orderBy(order).limit(most)
    return valid, marked.where("not _ok").drop("_ok")


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """The table itself; raises if it has no row."""
    if df.isEmpty():
        raise BadInput(f"no valid rows in {what}")
    return df


def split_frames(spark: SparkSession, paths: dict[str, str], schema: StructType | str, *columns: str) -> dict[str, DataFrame]:
    """Named splits of JSON lines or arrays, each with the columns that it must have."""
    return {name: require(json_any(spark, path, schema), *columns) for name, path in paths.items()}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table itself; raises if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise BadInput(f"missing columns {missing}")
    return df


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """The three columns of a trajectory file; nothing else is read."""
    return require(spark.read.parquet(path), "messages", "uuid", "split").select("messages", "uuid", "split")


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with doubled quotes, as JSON columns have them."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, partition, source_subset) of a split manifest; raises on a repeated uuid, naming up to ten."""
    rows = require(csv(spark, path), "uuid", "data_partition")
    have = [F.nullif(F.col(c), F.lit("")) for c in ("source_subset",) if c in rows.columns]
    have += [F.col("split")] if "split" in rows.columns else []
    twice = [r.uuid for r in rows.groupBy("uuid").count().where("count > 1").limit(10).collect()]
    if twice:
        raise BadInput(f"repeated uuids: {twice}")
    return rows.select("uuid", F.col("data_partition").alias("partition"), F.coalesce(*have, F.lit("unknown")).alias("source_subset"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, metrics VARIANT) of all metric files below a folder; malformed ones are left out; in order of path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(METRIC_FILES) + "}").text(path, wholetext=True)
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    found = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.try_parse_json("value").alias("metrics"))
    return found.where("metrics is not null").select(F.replace(plain(F.col("path")), plain(F.lit(path.rstrip("/") + "/")), F.lit("")).alias("path"), "name", "metrics").orderBy("path")


def log_tail(spark: SparkSession, path: str, offset: int = 0, most: int | None = None, status: str | None = None) -> DataFrame:
    """(path, text, next_offset, finished): a log from a byte offset to its end, or ``most`` bytes of it; the next offset is one of bytes, too.

    Only the part asked for is read. finished: whether the job's ``status`` is a last one; a missing file is empty text.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    size = files.getFileStatus(place).getLen() if files.exists(place) else 0
    n = max(0, size - offset) if most is None else min(max(0, size - offset), most)
    data = b""
    if n:
        stream = files.open(place)
        try:
            stream.seek(offset)
            data = bytes(stream.readNBytes(n))
        finally:
            stream.close()
    finished = (status or "").strip().lower() in ("succeeded", "failed", "cancelled")
    return spark.createDataFrame([(path, data.decode("utf-8", "replace"), offset + len(data), finished)], "path string, text string, next_offset long, finished boolean")


def registry(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A control-plane table: Parquet below a folder, or over JDBC for a ``jdbc:`` address."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return spark.read.parquet(f"{url.rstrip('/')}/{name}.parquet")
