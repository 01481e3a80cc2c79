"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: what separates words everywhere in this subpackage, and what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
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


def fresh(prefix: str, taken: Iterable[str]) -> str:
    """The prefix, with as many underscores before it as no column of `taken` begins with it (names differ by more than case)."""
    names = [c.lower() for c in taken]
    while any(c.startswith(prefix.lower()) for c in names):
        prefix = "_" + prefix
    return prefix


def quoted(column: str) -> str:
    """A column's name as an expression, whatever it contains."""
    return "`" + column.replace("`", "``") + "`"


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives none."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; of the whole sequence where it is shorter; none of an empty one."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _ODD[k]
    return mix(out + np.uint64(n))


def _sum_chunks(batches):
    total: dict[tuple, np.ndarray] = {}
    for b in batches:
        for name, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts = np.frombuffer(data, np.uint16 if len(data) == 2 * CHUNK else np.int64).astype(np.int64)
            total[name, chunk] = total[name, chunk] + counts if (name, chunk) in total else counts
    keys = list(total)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["name", "chunk", "counts"])


#: Counters that travel together.
CHUNK = 4096


def sum_chunks(df: DataFrame) -> DataFrame:
    """Adds up rows (name string, chunk int, counts binary of CHUNK uint16 or int64) by name and chunk; each task streams its rows and holds only sums."""
    return df.repartition("name", "chunk").mapInArrow(_sum_chunks, "name string, chunk int, counts binary")


def chunk_rows(name: str | None, counts: np.ndarray) -> pa.RecordBatch:
    parts = [counts[k : k + CHUNK] for k in range(0, len(counts), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["name", "chunk", "counts"])
