"""Calendar reductions over streams: the same keys and aggregates as over tables, with a watermark that bounds state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.npmath import num
from ..operators.reduce import AGGREGATES


def windowed(stream: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), how: str = "mean", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Reductions of fixed or sliding event-time windows. Rows later than `late` are dropped; state is a row a window and key."""
    t = stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    f = AGGREGATES[how]
    out = t.groupBy(w, *by).agg(*[f(num(v), None).alias(v) for v in values])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *values)


def climatology(stream: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), how: str = "mean") -> DataFrame:
    """Running climatology by month and day; for `complete` or `update` output. State is 366 rows a key."""
    f = AGGREGATES[how]
    keyed = stream.withColumns({"month": F.month(time), "day": F.dayofmonth(time)})
    return keyed.groupBy("month", "day", *by).agg(*[f(num(v), None).alias(v) for v in values])


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """All input that is there now, into an in-memory table, then stop: for tests and backfills of small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
