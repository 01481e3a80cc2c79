"""Resumable ingestion of a growing folder of archives: a stream of files into partitions by date, and a table of those that gave nothing.
(An extension.)"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sinks.tables import exists
from tessera.sources.files import LEGACY, UDIFF, _legacy_day, _udiff_day, parsed, shares

_LAYOUTS = [UDIFF, LEGACY]
_NAMES = list(dict.fromkeys([*LEGACY.values(), *UDIFF.values()]))
_FILE = "path string, modificationTime timestamp, length long, content binary"
BAD = "file string, modified timestamp, reason string"


def archive_rows(files: DataFrame) -> DataFrame:
    """From files (path, modificationTime, content): the strings of each archive's rows with file, modified, row; an archive that gives none has one
    row whose row is -1, and why."""
    schema = ", ".join(f"{c} string" for c in _NAMES) + ", file string, modified timestamp, row long, reason string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, modified, content in zip(batch["path"], batch["modificationTime"], batch["content"], strict=True):
                got, reason = parsed(content, True, _LAYOUTS)
                n = 1 if got is None else len(got)
                of = lambda c, got=got, n=n: [None] * n if got is None or c not in got else [v if isinstance(v, str) else None for v in got[c]]
                more = {"file": [path.rsplit("/", 1)[-1]] * n, "modified": [modified] * n, "row": [-1] if got is None else range(n), "reason": pd.Series([reason] * n, dtype=object)}
                yield pd.DataFrame({c: pd.Series(of(c), dtype=object) for c in _NAMES} | more)

    return files.select("path", "modificationTime", "content").mapInPandas(read, schema)


def _take(files: DataFrame, table: str, bad: str) -> None:
    """Puts the files' rows into the date partitions of the table, and those that gave nothing into the table of bad ones. An archive's date is a
    partition of its own file, overwritten whole, so a batch that is run again after a failure leaves the same rows."""
    spark = files.sparkSession
    rows = archive_rows(files).withColumn("d", F.coalesce(_legacy_day(), _udiff_day()))
    rows = rows.withColumn("reason", F.when((F.col("row") >= 0) & F.col("d").isNull(), "no date in the name").otherwise(F.col("reason")))
    rows = rows.persist()  # a batch's archives are parsed once; freed below
    try:
        good = rows.where("reason is null and (kind is null or trim(kind) = 'STK')")
        shares(good, "file", "row").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d", "file").parquet(table)
        failed = rows.where("reason is not null").select("file", "modified", "reason").distinct()
        taken = rows.select("file").distinct()
        before = spark.read.schema(BAD).parquet(bad) if exists(spark, bad) else None
        if not failed.isEmpty() or (before is not None and not before.join(taken, "file", "left_semi").isEmpty()):
            now = failed if before is None else before.join(taken, "file", "left_anti").unionByName(failed)
            now = spark.createDataFrame(now.collect(), BAD)  # names of broken files, not data
            now.coalesce(1).write.mode("overwrite").parquet(bad)
    finally:
        rows.unpersist()


def ingest(spark: SparkSession, folder: str, table: str, *, checkpoint: str, glob: str = "*.zip", files_at_once: int = 200) -> None:
    """Takes what is new in the folder into the table (d, file, isin, symbol, series, prices, row; by d and file) and ends.

    The checkpoint remembers the archives of all runs, so each is read once; `{table}-bad` lists the broken ones with reasons. One that was
    replaced since is read again, and leaves the list if it is whole. A run that dies in the middle goes on where it ended.
    """
    bad = f"{table}-bad"
    if exists(spark, bad):
        listed = spark.read.schema(BAD).parquet(bad)
        there = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        name = F.element_at(F.split("path", "/"), -1)
        replaced = there.join(listed.select("file", "modified"), name == F.col("file")).where(F.col("modificationTime") > F.col("modified")).select(there.columns)
        if not replaced.select("path").isEmpty():
            _take(replaced, table, bad)
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(folder)
    query = stream.writeStream.foreachBatch(lambda files, _: _take(files, table, bad)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows, of those of one date and ISIN the last archive's last one."""
    rows = spark.read.parquet(table)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("d", "isin", "file", "row")]), F.struct("file", "row"))
    return rows.groupBy("d", "isin").agg(last.alias("x")).select("d", "isin", "x.*")
