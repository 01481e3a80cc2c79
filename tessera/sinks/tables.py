"""Results as tables: checked writes, ledgers by strategy, tables that grow by rows of any columns, verdicts and exports."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.evaluation import deflated_sharpe
from tessera.operators.panel import digest
from tessera.operators.universe import cost_panel, export
from tessera.sinks.steps import remove


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def write_checked(df: DataFrame, path: str, *, by: list[str] | None = None) -> DataFrame:
    """Writes a table and returns it as read back; an error if rows or columns differ from what was sent. The rows are counted as they are
    written, so df is computed once."""
    from pyspark.sql import Observation

    seen, spark = Observation(), df.sparkSession
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    back = spark.read.parquet(path)
    if back.count() != seen.get["n"] or sorted(back.columns) != sorted(df.columns):
        raise ValueError(f"{path}: read back {back.count()} rows of {back.columns}, wrote {seen.get['n']} of {df.columns}")
    return back


def _swap_in(df: DataFrame, path: str) -> None:
    """Writes df beside path and puts it in its place, so that readers find the old table or the new one, and df may read the old one."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    fs, at = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}-old")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at)
    fs.delete(old, True)


def upsert_ledger(returns: DataFrame, strategy: str, path: str, *, align: bool = False) -> DataFrame:
    """A ledger (d, strategy, ret) in which the strategy's rows are replaced by returns (d, ret). Partitions are strategies, so others are
    not touched. align: a ledger that is there keeps its dates, and returns on others are dropped."""
    spark = returns.sparkSession
    rows = returns.select("d", "ret", F.lit(strategy).alias("strategy"))
    if align and exists(spark, path):
        dates = spark.read.parquet(path).select("d").distinct()
        rows = dates.join(rows, "d", "left").select("d", "ret", F.lit(strategy).alias("strategy"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)
    back = spark.read.parquet(path)
    if back.where(F.col("strategy") == strategy).isEmpty() and not rows.isEmpty():
        raise ValueError(f"{strategy} not found in {path} after writing")
    return back


def wide_ledger(ledger: DataFrame, strategies: list[str]) -> DataFrame:
    """d and a column for each named strategy."""
    return ledger.groupBy("d").agg(*[F.max(F.when(F.col("strategy") == s, F.col("ret"))).alias(s) for s in strategies])


def append_union(rows: DataFrame, path: str) -> DataFrame:
    """Adds rows to a table on the union of both's columns, nulls where one lacks a column."""
    spark = rows.sparkSession
    out = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True) if exists(spark, path) else rows
    _swap_in(out, path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str], *, comments: list[str] = ()) -> None:
    """A small report as one CSV with a header, and lines that begin with # before it."""
    if not comments:
        df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    rows = df.select(F.to_csv(F.struct(*df.columns)).alias("value"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
    head = df.sparkSession.createDataFrame([(k, f"# {x}") for k, x in enumerate(comments)] + [(len(comments), ",".join(df.columns))], "n int, value string")
    nth = F.row_number().over(Window.orderBy(*[f"_{k}" for k in range(len(order))])) + len(comments)  # a report's rows
    head.unionByName(rows.select(nth.cast("int").alias("n"), "value")).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def write_verdicts(ledger: DataFrame, path: str, trials: int, *, year: float = 252, confidence: float = 0.95) -> DataFrame:
    """The deflated Sharpe table of a ledger (strategy, ret) with a verdict, as a CSV; an error if more strategies are judged than trials are
    admitted."""
    n = ledger.select("strategy").distinct().count()
    if n > trials:
        raise ValueError(f"{n} strategies were tried, {trials} are admitted")
    out = deflated_sharpe(ledger, trials, year=year).withColumn("passes", F.col("dsr") > confidence)
    write_csv(out, path, ["strategy"])
    return out


def export_universe(bars: DataFrame, mask: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The whole history of every name ever selected, and the mask, as checked tables."""
    prices = export(bars, mask).withColumnRenamed("d", "timestamp").drop("turnover")
    return write_checked(prices, f"{root}/ohlcv.parquet"), write_checked(mask, f"{root}/universe_mask.parquet")


def write_cost_panels(bars: DataFrame, root: str) -> DataFrame:
    return write_checked(cost_panel(bars).select("ticker", "d", "adv", "sigma", "cs", "ar"), f"{root}/cost_panel.parquet")


@dataclass
class Reuse:
    """Results kept under root by what they are made of. TESSERA_REUSE=0 in the environment turns it off: everything is computed, nothing kept."""

    root: str
    hits: int = 0
    misses: int = 0

    def key(self, inputs: dict[str, DataFrame], **parameters) -> str:
        """A digest of all rows of the inputs, in any order, and of the parameters of the code that makes the result of them."""
        parts = [repr(sorted((k, repr(v)) for k, v in parameters.items()))]
        for name, df in sorted(inputs.items()):
            parts.append(repr((name, sorted(df.dtypes), *digest(df, df.columns).first())))
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of the key: the slot's table if it was written whole and can be read, else what `make` returns, written beside and put in place by
        renaming. Of writers at the same time the first one's table stays, and all read it."""
        if os.environ.get("TESSERA_REUSE", "1") == "0":
            return make()
        path = f"{self.root.rstrip('/')}/{key}"
        df = None
        spark = SparkSession.active()
        if exists(spark, f"{path}/_SUCCESS"):
            try:
                df = spark.read.parquet(path)
                df.write.format("noop").mode("overwrite").save()  # a slot that can't be read to its end is none
                self.hits += 1
                return df
            except Exception:  # whatever is wrong with it, it is made anew  # noqa: BLE001
                remove(spark, path)
        self.misses += 1
        made = make()
        beside = f"{path}-{uuid.uuid4().hex}"
        made.write.parquet(beside)
        fs, at = _fs(spark, path)
        mine = spark._jvm.org.apache.hadoop.fs.Path(beside)
        if fs.exists(at) or not fs.rename(mine, at):
            fs.delete(mine, True)  # another writer was first
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{beside.rsplit('/', 1)[-1]}"), True)  # where a rename went into its table
        return spark.read.parquet(path)


def reuse(df: DataFrame, key: str, root: str) -> DataFrame:
    """The table of a key under root if it was written whole, else df, written there and read back (Reuse, with a key of the caller's own)."""
    return Reuse(root).get(key, lambda: df)
