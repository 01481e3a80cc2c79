"""Session-aligned bars over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_bars(ticks: DataFrame, *, width: str = "30 minutes", start: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Ticks (ticker, ts timestamp, px, event_id) to bars by windows that begin at `start` past the hour; a bar is final once the
    watermark, `late` behind the newest tick, has passed its end."""
    rows = ticks.where("px > 0").withWatermark("ts", late).groupBy(F.window("ts", width, width, start), "ticker")
    return rows.agg(F.min_by("px", "event_id").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "event_id").alias("close"), F.count("*").alias("volume"))
