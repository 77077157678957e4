"""Windowing, gap marking, zero-volume policy and summaries of bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.series import Running, number_rows, running, secs


def within(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with ``start <= ts <= end``; reaches the Parquet scan."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return bars


def mark_gaps(bars: DataFrame, step: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``gap_before``: more than one step since the previous bar. The first bar has none."""
    seen = running(bars, keys, ["ts"], {"_was": Running("prev", secs("ts"))})
    return (seen.withColumn("gap_before",
                            F.coalesce(secs("ts") - F.col("_was") > step, F.lit(False)))
            .drop("_was"))


def number_segments(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``segment``: how many gaps came before, so each unbroken run has its own number."""
    return running(bars, keys, ["ts"],
                   {"segment": Running("sum", F.col("gap_before").cast("long"))})


def drop_empty(bars: DataFrame, skip: bool = True) -> DataFrame:
    """Drop bars without volume, if asked to."""
    return bars.where("volume > 0") if skip else bars


def prepare(bars: DataFrame, step: int, *, start=None, end=None, skip_empty=False) -> DataFrame:
    """Window, then gap marks, then the zero-volume policy (so a dropped bar leaves no gap)."""
    return drop_empty(mark_gaps(within(bars, start, end), step), skip_empty)


def summarise(bars: DataFrame) -> DataFrame:
    """Rows, span, gaps and empty bars per symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        secs(F.min("ts")).alias("first_time"), secs(F.max("ts")).alias("last_time"),
        F.sum(F.col("gap_before").cast("long")).alias("gaps"),
        F.sum((F.col("volume") == 0).cast("long")).alias("zero_volume"))


def datasets(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Count and span of every stored series."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        secs(F.min("ts")).alias("first_time"), secs(F.max("ts")).alias("last_time"))


def slice_rows(bars: DataFrame, start: int, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars ``start .. start + n`` of every series by position; out of range is empty."""
    start = max(0, start)
    return number_rows(bars, keys).where(
        (F.col("bar_no") >= start) & (F.col("bar_no") < start + max(0, n)))


def locate(bars: DataFrame, asked: DataFrame, time: str = "time",
           bucket: int = 86400) -> DataFrame:
    """Position of the first bar at or after each asked second, clamped to the ends.

    A forward as-of join. Bars and questions are laid into time buckets; inside a bucket the
    answer comes from the bucket's own rows, otherwise from the first bar of a later bucket,
    which a per-bucket table (calendar-sized) already knows.
    """
    numbered = number_rows(bars.select("symbol", "ts"), ["symbol"]).select(
        "symbol", secs("ts").alias("at"), "bar_no")
    marks = numbered.select("symbol", "at", "bar_no", F.lit(None).cast("long").alias("ask"))
    asks = asked.select("symbol", F.col(time).alias("at"),
                        F.lit(None).cast("long").alias("bar_no"), F.col(time).alias("ask"))
    both = marks.unionByName(asks).withColumn("_bucket", F.floor(F.col("at") / bucket))
    # Rows after the question, the bar at the very same second included.
    ahead = (Window.partitionBy("symbol", "_bucket").orderBy("at")
             .rangeBetween(0, Window.unboundedFollowing))
    later = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(
        1, Window.unboundedFollowing)
    near = both.withColumn("_here", F.min("bar_no").over(ahead)).where("bar_no is null")
    firsts = both.groupBy("symbol", "_bucket").agg(
        F.min("bar_no").alias("_first"), F.max("bar_no").alias("_last"))
    reach = firsts.select("symbol", "_bucket", F.min("_first").over(later).alias("_next"),
                          F.max("_last").over(Window.partitionBy("symbol")).alias("_end"))
    return (near.join(reach, ["symbol", "_bucket"])
            .select("symbol", F.col("ask").alias(time),
                    F.coalesce("_here", "_next", "_end").alias("bar_no")))
