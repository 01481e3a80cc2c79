"""Bars from files: per-symbol CSV, zip archives of two layouts, index files, and Parquet by a registry of frequencies."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.panel import last_known


@dataclass(frozen=True)
class Frequency:
    """Where the bars of a frequency are, how many a day has, and the lengths of train and test blocks."""

    path: str
    bars_per_day: int
    train: int = 504
    test: int = 63
    institutional: bool = True


def registry(root: str) -> dict[str, Frequency]:
    # Bars of a session by frequency.
    days = {"15min": 25, "30min": 13, "60min": 7, "daily": 1}
    return {name: Frequency(f"{root}/{name}_ohlcv.parquet", n) for name, n in days.items()}


def frequency(known: dict[str, Frequency], name: str) -> Frequency:
    if name not in known:
        raise ValueError(f"unknown frequency {name!r}; one of {sorted(known)}")
    return known[name]


def load_bars(spark: SparkSession, known: dict[str, Frequency], name: str) -> DataFrame:
    """Bars (ticker, date, prices) of a frequency."""
    return spark.read.parquet(frequency(known, name).path).withColumnRenamed("timestamp", "date")


def required(spark: SparkSession, path: str, builder: str) -> DataFrame:
    """A Parquet table, or an error that says what makes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"{path} not found: run {builder} first")
    return spark.read.parquet(path)


def cost_panels(spark: SparkSession, root: str, estimator: str = "cs") -> DataFrame:
    """ticker, d, adv, sigma, half_spread of the tables that sinks.write_cost_panels made; cs or ar chooses the spread."""
    if estimator not in ("cs", "ar"):
        raise ValueError(f"estimator must be 'cs' or 'ar', not {estimator!r}")
    rows = required(spark, f"{root}/cost_panel.parquet", "write_cost_panels")
    return rows.select("ticker", F.to_date("d").alias("d"), "adv", "sigma", F.col(estimator).alias("half_spread"))


def parsed(content: bytes, zipped: bool, layouts: list[dict[str, str]]) -> tuple[pd.DataFrame | None, str | None]:
    """Rows of a CSV, or of the first CSV in an archive, by the first of the layouts (names in the file to ours) that its header has all names of;
    or why there are none. Columns of the other layouts are null."""
    try:
        if zipped:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inside = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                if inside is None:
                    return None, "no CSV inside"
                content = z.read(inside)
        got = pd.read_csv(io.BytesIO(content), dtype=str, skipinitialspace=True).rename(columns=lambda c: c.strip())
    except zipfile.BadZipFile:
        return None, "not an archive"
    except (UnicodeDecodeError, pd.errors.ParserError, pd.errors.EmptyDataError, ValueError, zlib.error) as e:
        return None, f"not a CSV: {type(e).__name__}"
    for layout in layouts:
        if set(layout) <= set(got.columns):
            return got[list(layout)].rename(columns=layout).reindex(columns=_ours(layouts)), None
    return None, "unknown header"


def _ours(layouts: list[dict[str, str]]) -> list[str]:
    return list(dict.fromkeys(c for layout in layouts for c in layout.values()))


def csv_rows(spark: SparkSession, folder: str, columns: dict[str, str] | list[dict[str, str]], *, glob: str, zipped: bool = False) -> DataFrame:
    """Rows of CSV files, each bound by its own header: columns maps names in the file to ours (all strings), or are several such layouts,
    of which the first that a file has is its own; file is the file's name, row the row's number. A file that is broken or lacks a column
    gives one row of nulls whose row is -1, to be counted. A file is read by one task, once."""
    layouts = [columns] if isinstance(columns, dict) else columns
    ours = _ours(layouts)
    schema = ", ".join(f"{c} string" for c in ours) + ", file string, row long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                got, _ = parsed(content, zipped, layouts)
                bad = got is None
                got = pd.DataFrame([dict.fromkeys(ours)]) if bad else got
                yield got.assign(file=path.rsplit("/", 1)[-1], row=-1 if bad else range(len(got)))[[*ours, "file", "row"]]

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content").mapInPandas(read, schema)


def bad_files(rows: DataFrame) -> DataFrame:
    """The files of csv_rows that gave nothing."""
    return rows.where("row = -1").select("file").distinct()


def _numbers(*names: str) -> list[Column]:
    return [F.expr(f"try_cast({c} as double)").alias(c) for c in names]


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the last one, by file, then row."""
    w = Window.partitionBy(*keys).orderBy(F.desc("file"), F.desc("row"))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "file", "row")


def symbol_csv(spark: SparkSession, folder: str, kind: str = "all", *, indices: tuple[str, ...] = ("NIFTY",), glob: str = "*.csv") -> DataFrame:
    """ticker, ts, prices of one CSV per symbol, the symbol from the file's name up to the dot, or to a frequency such as _15m; numbers that aren't are null, closes must be positive, and
    of rows with one time the last stays. kind: stocks, indices or all."""
    names = ("open", "high", "low", "close", "volume")
    raw = csv_rows(spark, folder, {"timestamp": "timestamp", **{c: c for c in names}}, glob=glob)
    rows = raw.where("row >= 0").select(F.upper(F.regexp_extract("file", r"^([^.]+?)(_[0-9]+m[^.]*)?\.", 1)).alias("ticker"), F.expr("try_cast(timestamp as timestamp)").alias("ts"), *_numbers(*names), "file", "row")
    index = F.col("ticker").rlike("^(" + "|".join(indices) + ")")
    rows = rows if kind == "all" else rows.where(index if kind == "indices" else ~index)
    return _last(rows.where("close > 0 and ts is not null"), "ticker", "ts")


def daily_and_intraday(spark: SparkSession, daily: str, intraday: str) -> tuple[DataFrame, DataFrame]:
    """Two CSV files: daily bars (date, ticker, prices) and 15-minute bars (datetime, ticker, prices)."""
    names = ("open", "high", "low", "close", "volume")
    read = lambda path, time: csv_rows(spark, path, {time: time, "ticker": "ticker", **{c: c for c in names}}, glob="*.csv").where("row >= 0")
    return (
        read(daily, "date").select("ticker", F.expr("try_cast(date as date)").alias("d"), *_numbers(*names)),
        read(intraday, "datetime").select("ticker", F.expr("try_cast(datetime as timestamp)").alias("ts"), *_numbers(*names)),
    )


# Column names of the two archive layouts.
LEGACY = {"SYMBOL": "symbol", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low", "LAST": "close", "CLOSE": "close_vwap", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover", "ISIN": "isin"}
UDIFF = {"TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "LastPric": "close", "ClsPric": "close_vwap", "TtlTradgVol": "volume", "TtlTrfVal": "turnover", "ISIN": "isin", "FinInstrmTp": "kind"}


def _legacy_day() -> Column:
    return F.expr("try_to_date(initcap(regexp_extract(file, '([0-9]{2}[A-Za-z]{3}[0-9]{4})', 1)), 'ddMMMyyyy')")


def _udiff_day() -> Column:
    return F.expr("try_to_date(regexp_extract(file, '([0-9]{8})', 1), 'yyyyMMdd')")


def exchange_archives(spark: SparkSession, legacy: str | None, udiff: str | None) -> tuple[DataFrame, DataFrame]:
    """Both eras as one table, and the files that gave nothing. The date is from the archive's name; of rows with one date and ISIN the last
    archive's last row stays. Only ordinary shares: ISIN of the country and security type, series EQ or BE, a positive close, no
    negative volume."""
    parts = []
    if legacy:
        parts.append(csv_rows(spark, legacy, LEGACY, glob="*.zip", zipped=True).withColumn("d", _legacy_day()))
    if udiff:
        rows = csv_rows(spark, udiff, UDIFF, glob="*.zip", zipped=True)
        parts.append(rows.where("row = -1 or trim(kind) = 'STK'").drop("kind").withColumn("d", _udiff_day()))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    bad = bad_files(rows)
    return _last(shares(rows.where("row >= 0 and d is not null"), "file", "row"), "d", "isin"), bad


def shares(rows: DataFrame, *more: str) -> DataFrame:
    """Typed rows of ordinary shares from an archive's strings, with d and what else is named."""
    prices = _numbers("open", "high", "low", "close", "close_vwap", "volume", "turnover")
    rows = rows.select("d", *[F.trim(c).alias(c) for c in ("isin", "symbol", "series")], *prices, *more)
    return rows.where("startswith(isin, 'INE') and substring(isin, 8, 2) = '01' and series in ('EQ', 'BE') and close > 0 and volume >= 0")


def traded_futures(spark: SparkSession, folder: str) -> DataFrame:
    """(d, symbol): underlyings with a stock future in each day's derivatives archive, either layout by its header."""
    layouts = [{"INSTRUMENT": "kind", "SYMBOL": "symbol"}, {"FinInstrmTp": "kind", "TckrSymb": "symbol"}]
    rows = csv_rows(spark, folder, layouts, glob="*.zip", zipped=True).where("row >= 0 and upper(trim(kind)) in ('FUTSTK', 'STF')")
    return rows.select(F.coalesce(_legacy_day(), _udiff_day()).alias("d"), F.upper(F.trim("symbol")).alias("symbol")).distinct()


# Names that the benchmark index has had, and the band of its yield.
INDEX_NAMES = ("S&P CNX NIFTY", "CNX NIFTY", "NIFTY 50")
INDEX_TICKER = "NIFTY-50"
YIELD_BAND = (0.1, 5.0)


def _index_rows(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """The first matching row of each index file, its date from the file's name."""
    rows = csv_rows(spark, folder, {"Index Name": "name", **columns}, glob="*.csv").where("row >= 0")
    rows = rows.where(F.upper(F.trim("name")).isin(*INDEX_NAMES)).withColumn("d", F.expr("try_to_date(regexp_extract(file, '([0-9]{8})', 1), 'ddMMyyyy')"))
    w = Window.partitionBy("file").orderBy("row")
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1 and d is not null").drop("_nth")


def index_series(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, d, open, high, low, close, volume (0) of the benchmark from daily all-index files; the last file of a date stays."""
    columns = {"Open Index Value": "open", "High Index Value": "high", "Low Index Value": "low", "Closing Index Value": "close"}
    rows = _index_rows(spark, folder, columns).select("d", *_numbers("open", "high", "low", "close"), "file", "row").where("close is not null")
    return _last(rows, "d").select(F.lit(INDEX_TICKER).alias("ticker"), "d", "open", "high", "low", "close", F.lit(0.0).alias("volume"))


def index_yields(spark: SparkSession, folder: str) -> DataFrame:
    """d, y: dividend yield in percent of the benchmark, within the sane band."""
    rows = _index_rows(spark, folder, {"Div Yield": "y"}).select("d", *_numbers("y"), "file", "row").where(F.col("y").between(*YIELD_BAND))
    return _last(rows, "d")


def quality_gate(prices: DataFrame, columns: list[str]) -> DataFrame:
    """A wide table (date, columns) that passes: all columns there, none negative or zero; gaps are filled forward only, and dates before a
    column's first value go. One scan finds what is wrong."""
    missing = [c for c in columns if c not in prices.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    low = prices.agg(*[F.min(c).alias(c) for c in columns]).first()
    for what, bad in (("negative", [c for c in columns if low[c] is not None and low[c] < 0]), ("zero", [c for c in columns if low[c] == 0])):
        if bad:
            raise ValueError(f"{what} prices in {bad}")
    long = prices.unpivot("date", columns, "ticker", "close")
    full = long.select("date", "ticker", last_known("close", "date").alias("close"))
    known = full.where("close is not null").groupBy("date").count().where(F.col("count") == len(columns)).select("date")
    return full.join(known, "date", "left_semi")


