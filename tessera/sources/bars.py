"""Bars (ticker, d, open, high, low, close, volume, turnover) and ticks from trades, with variants that delist, halt and reissue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = ("open", "high", "low", "close", "volume", "turnover")


def bars_of(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Trades (px, q, v) to bars; the order columns make the first and last trade unique."""
    o = F.struct(*order)
    return trades.groupBy(*keys).agg(F.min_by("px", o).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", o).alias("close"), F.sum("q").alias("volume"), F.sum("v").alias("turnover"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.withColumns({"px": F.col("l_extendedprice") / F.col("l_quantity"), "q": F.col("l_quantity"), "v": F.col("l_extendedprice")})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name per supplier: the number of names grows with the data."""
    rows = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"), "px", "q", "v", "l_orderkey", "l_linenumber", "l_partkey")
    return bars_of(rows, ["ticker", "d"], ["l_orderkey", "l_linenumber", "l_partkey"])


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name per brand: few names, but hardly a week without a bar."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    rows = _lines(spark, sf_dir).join(part, "l_partkey").withColumn("d", F.trunc("l_shipdate", "week"))
    return bars_of(rows, ["ticker", "d"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def eventful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of which names that end in 5 leave in 1997 and names that end in 3 halt in the spring of 1996."""
    end = F.substring("ticker", -1, 1)
    return weekly(spark, sf_dir).where(~((end == "5") & (F.col("d") >= "1997-06-01")) & ~((end == "3") & F.col("d").between("1996-03-01", "1996-05-31")))


def reissued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with an isin that changes with every year."""
    return daily(spark, sf_dir).withColumn("isin", F.concat(F.lit("INE"), F.lpad(F.col("ticker").cast("string"), 5, "0"), F.year("d").cast("string")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("px"), "event_id")


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, symbol): brands with returned goods in a week, of weeks that are no multiple of four in their year."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_partkey", F.trunc("l_shipdate", "week").alias("d"))
    return rows.join(part, "l_partkey").where(F.weekofyear("d") % 4 != 0).select("d", "symbol").distinct()


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dy": daily, "wk": weekly, "wx": eventful, "ri": reissued, "tk": ticks, "fo": returned}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source that is computed once for all that reads it in a session, and kept on the executors' disks; what is lost is recomputed."""
    return SOURCES[name](spark, sf_dir).persist(StorageLevel.DISK_ONLY)
