"""Tables between the steps of a job: written to the folder that driver and executors share, and deleted once read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process may it be unset: then it
    is a temporary folder. On a cluster an unset folder is an error, since each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a scan of it: lineage is cut, and lost executors cost a reread only."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes the tables of materialized frames, once everything computed from them has been written."""
    for f in frames:
        path = f.__dict__.pop("_written", None) if f is not None else None
        if path:
            remove(f.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _temporary:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before  # noqa: BLE001, S110
            pass
