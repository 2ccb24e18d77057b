"""Experiment, run, job, node and dataset tables: lists, lookups, state changes as new rows.

State is an append-only log of rows; the current state of a key is its last row (``current``). Changes return the
rows to append and never rewrite a table. Statuses are compared without outer blanks and case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.common import folded
from weft.functions.outcome import config_hash

FINAL = ("succeeded", "failed", "cancelled")


def current(log: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """The last row of each key, ties by all its values; aggregated on the map side, no window."""
    columns = [c for c in log.columns if c != key]
    last = F.max(F.struct(F.col(order), *(F.col(c) for c in columns if c != order)))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc(key))


def listed(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows that match the given values; None means no condition. Statuses are folded."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where((folded(column) if column == "status" else F.col(column)) == F.lit(value))
    return newest(rows)


def get(rows: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row of one key; empty where there is none."""
    return rows.where(F.col(column) == F.lit(key))


def exists(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows less those of a table of tombstones; children stay."""
    return rows.join(gone.select(key), key, "left_anti")


def patched(rows: DataFrame, changes: DataFrame, key: str = "id", null_keeps: bool = True) -> DataFrame:
    """Rows with the columns of ``changes`` put in; a null keeps the old value, or overwrites it if ``null_keeps`` is false."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    out = rows.join(new, key, "left")
    value = lambda c: F.coalesce(f"_new_{c}", c) if null_keeps else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return out.select(*(value(c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def registered(nodes: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Nodes upserted by name: blank host and GPU keep the old values, a null user keeps the old one; all become alive.

    New nodes get the ids that follow the greatest one, in the order of their names; a name of null stays as it is.
    """
    new = seen.groupBy("name").agg(F.max(F.struct(F.lit(True).alias("hit"), "hostname", "ssh_user", "ssh_port", "gpu_info")).alias("s"))
    out = nodes.join(new, "name", "full")
    hit = F.coalesce(F.col("s.hit"), F.lit(False))
    keep = lambda c: F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), F.col(c))
    start = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    place = F.sum(F.when(F.col("id").isNull(), 1)).over(Window.orderBy(F.col("id").isNotNull(), "name").rowsBetween(Window.unboundedPreceding, 0))  # machines, not records: one task
    return out.withColumn("id", F.coalesce("id", start + place)).select(
        "id", "name", F.when(hit, F.coalesce(keep("hostname"), F.lit(""))).otherwise(F.col("hostname")).alias("hostname"), F.coalesce("s.ssh_user", "ssh_user").alias("ssh_user"),
        F.when(hit, F.coalesce("s.ssh_port", F.lit(22))).otherwise(F.col("ssh_port")).alias("ssh_port"), F.when(hit, keep("gpu_info")).otherwise(F.col("gpu_info")).alias("gpu_info"),
        F.when(hit, "alive").otherwise(F.col("status")).alias("status"), F.when(hit, now).otherwise(F.col("last_heartbeat_at")).alias("last_heartbeat_at"), F.coalesce("created_at", now).alias("created_at"),
    )


def heartbeat(nodes: DataFrame, node_id: int, now: Column) -> DataFrame:
    hit = F.col("id") == node_id
    return nodes.withColumns({"last_heartbeat_at": F.when(hit, now).otherwise(F.col("last_heartbeat_at")), "status": F.when(hit, "alive").otherwise(F.col("status"))})


def offline(nodes: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Nodes with their status after silence of more than ``seconds``; never heard of is silent."""
    silent = F.coalesce(F.col("last_heartbeat_at") < now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(True))
    return nodes.withColumn("status", F.when(silent, "offline").otherwise(F.col("status")))


def claimable(jobs: DataFrame, node_id: int | None) -> DataFrame:
    """The first queued job that no node, or this one, is to run: a top-1, not a sort."""
    free = F.col("node_id").isNull()
    mine = free if node_id is None else free | (F.col("node_id") == node_id)
    return jobs.where((folded("status") == "queued") & mine).orderBy("id").limit(1)


def cancelled(jobs: DataFrame, job_id: int, now: Column) -> DataFrame:
    """The row to append when a job is cancelled; none if it has ended."""
    return jobs.where((F.col("id") == job_id) & folded("status").isin("queued", "running")).withColumns({"status": F.lit("cancelled"), "finished_at": now})


def created(log: DataFrame, new: DataFrame, now: Column, **defaults: object) -> DataFrame:
    """The rows to append for new experiments, data sets or runs: ids go on from the greatest, in the order of the new rows' ``name``.

    Columns that ``new`` lacks are null, or what ``defaults`` has for them; ``created_at`` is ``now``. New rows are few (a
    request's), so they are numbered in one task.
    """
    start = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    rows = new.withColumn("id", start + F.row_number().over(Window.orderBy("name")))
    rows = rows.withColumn("created_at", now) if "created_at" in log.columns else rows
    value = lambda f: F.coalesce(F.col(f.name), F.lit(defaults.get(f.name))) if f.name in rows.columns else F.lit(defaults.get(f.name))
    return rows.select(*(value(f).cast(f.dataType).alias(f.name) for f in log.schema))


def new_runs(log: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The run rows to append for ``new(name, config_json, ...)``: status ``created``, the config compact with sorted keys, and its hash."""
    rows = created(log, new, now, status="created")
    return rows.withColumn("config_hash", config_hash("config_json"))


def jobs_of_run(jobs: DataFrame, run_id: int) -> DataFrame:
    """The jobs of a run in the order of their ids."""
    return jobs.where(F.col("run_id") == run_id).orderBy("id")


def new_jobs(run: DataFrame, specs: Column, now: Column) -> DataFrame:
    """One queued job per entry of the array ``specs`` of (stage, command, workdir, node_id); workdir and node from the run if null."""
    return run.select(F.col("id").alias("run_id"), "workdir", "node_id", F.posexplode(specs).alias("n", "s")).select(
        "run_id", F.col("n").alias("position"), "s.stage", "s.command", F.coalesce("s.workdir", "workdir").alias("workdir"), F.lit("queued").alias("status"), F.coalesce("s.node_id", "node_id").alias("node_id"), now.alias("created_at"))


def run_status(jobs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, status): running, queued, failed, cancelled in this order; succeeded only if all jobs are; else created."""
    state = folded("status")
    has = lambda s: F.bool_or(F.coalesce(state == s, F.lit(False)))
    status = F.lit("created")
    status = F.when(F.bool_and(F.coalesce(state == "succeeded", F.lit(False))), "succeeded").otherwise(status)
    for s in ("cancelled", "failed", "queued", "running"):
        status = F.when(has(s), s).otherwise(status)
    out = jobs.where("run_id is not null").groupBy("run_id").agg(status.alias("status"))
    if runs is None:
        return out
    return runs.select(F.col("id").alias("run_id")).join(out, "run_id", "left").na.fill({"status": "created"})


def with_jobs(jobs: DataFrame) -> DataFrame:
    """(run_id, n_jobs, jobs): the jobs of each run in order of id."""
    entries = F.array_sort(F.collect_list(F.struct("id", "stage", folded("status").alias("status"))))
    return jobs.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n_jobs"), entries.alias("jobs"))


def latest_checkpoint(names: DataFrame, column: str = "name") -> DataFrame:
    """The name with the greatest number at its end."""
    number = F.try_to_number(F.regexp_extract(column, r"^checkpoint-(\d+)$", 1), F.lit("999999999999999999"))
    return names.where(number.isNotNull()).agg(F.max_by(column, number).alias(column))
