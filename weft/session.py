"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this package wants; a caller's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # what was cut is removed when nothing refers to it any more
}


def session(app: str = "weft", master: str | None = None, conf: dict[str, Any] | None = None) -> SparkSession:
    """A session with the package's defaults; ``master`` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="weft-package-")) / "weft.zip"  # code, not data: Spark sends it on from here
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only on a single machine, and only where it is unset, a temporary folder is taken; on a cluster without a shared
    folder there is no place that all executors reach, so this raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weft-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


_LEFT: dict[str, tuple[Any, Any]] = {}  # by path the file system and place of what is to be removed at the end


def _folder(spark: SparkSession) -> str:
    """This application's own folder below the checkpoint folder, to be removed at its end."""
    ensure_checkpoint_dir(spark)
    path = spark.sparkContext.getCheckpointDir()
    if path not in _LEFT:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _LEFT[path] = (place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)
    return path


@atexit.register
def _remove() -> None:
    for files, place in _LEFT.values():
        try:
            files.delete(place, True)
        except Exception:  # noqa: BLE001 (the JVM may be gone; the folder is then the cluster's to clean)
            return


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table in that folder: compressed, and later readers take only the columns they need."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors.

    What was written is removed at the end of the application.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)
