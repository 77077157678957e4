"""Trades to bars, bars to coarser bars, trades to volume at price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe import config
from tickframe.functions.columns import aggressor, close_label, tick_index
from tickframe.operators.series import secs, settle
from tickframe.schemas import FLOW, OHLC


def anchors(ticks: DataFrame) -> DataFrame:
    """Offset of the newest roll segment per symbol; reads two columns only."""
    return ticks.groupBy("symbol").agg(F.max("adj").alias("anchor"))


def back_adjust(ticks: DataFrame) -> DataFrame:
    """Shift every roll segment onto the newest one: ``price - adj + anchor``.

    The aggressor side is taken first, from the raw quote. The anchors are written out, so the
    join knows their true size: a short list is broadcast and the ticks are not shuffled for it.
    """
    return (ticks.withColumn("side", aggressor())
            .join(settle(anchors(ticks)), "symbol")
            .withColumn("price", F.col("price") - F.col("adj") + F.col("anchor"))
            .drop("anchor"))


def _flow_sums(side):
    volume = F.col("volume")
    return [
        F.sum(volume).alias("volume"),
        F.sum(volume * side).alias("delta"),
        F.sum(F.when(side > 0, volume).otherwise(0)).cast("long").alias("buy_volume"),
        F.sum(F.when(side < 0, volume).otherwise(0)).cast("long").alias("sell_volume"),
        F.count(F.lit(1)).alias("trades"),
    ]


def fold_ticks(ticks: DataFrame, step: int) -> DataFrame:
    """Back-adjusted bars of ``step`` seconds; ``seq`` (file order) resolves equal timestamps.

    One hash aggregation with map-side partials: a hot symbol shrinks to its bars before the
    shuffle, so no task sees its ticks together. Ticks of several files are folded file by file, ordered by
    a number alone, and only what each file has of a bar is put in the files' order. Adding the anchor keeps
    the order of prices, so ticks are folded net of their own offset and only the bars meet the anchor.
    """
    side = F.col("side") if "side" in ticks.columns else aggressor()
    net = (F.col("price") - F.col("adj")).alias("price")
    files = [c for c in ("file",) if c in ticks.columns]
    bars = (ticks.select("symbol", close_label("ts", step).alias("label"), *files, "seq", net,
                         "volume", side.alias("side"))
            .groupBy("symbol", "label", *files)
            .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
                 *_flow_sums(F.col("side"))))
    if files:
        bars = bars.groupBy("symbol", "label").agg(
            F.min_by("open", "file").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "file").alias("close"), *[F.sum(c).alias(c) for c in ("volume", *FLOW)])
    return bars.join(anchors(ticks), "symbol").select(
        "symbol", F.col("label").alias("ts"), *[(F.col(c) + F.col("anchor")).alias(c) for c in OHLC],
        "volume", *FLOW)


def _whole(step: int, base: int) -> None:
    if step % base:
        raise ValueError(f"{step}s is not a whole multiple of {base}s")


def _merged():
    when = secs("ts")
    rows = F.count(F.lit(1))
    return [
        F.min_by("open", when).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", when).alias("close"),
        F.sum("volume").alias("volume"),
        # A total over bars that never carried the column would claim too much: null instead.
        *[F.when(F.count(c) == rows, F.sum(c)).alias(c) for c in FLOW],
    ]


def derive(bars: DataFrame, step: int, base: int) -> DataFrame:
    """Coarser bars from finer ones; buckets without bars do not appear."""
    _whole(step, base)
    return (bars.withColumn("label", close_label("ts", step))
            .groupBy("symbol", "label").agg(*_merged())
            .withColumnRenamed("label", "ts"))


def derive_all(bars: DataFrame, timeframes: Sequence[str], base: int) -> DataFrame:
    """Several timeframes in one pass over the base bars, told apart by ``timeframe``."""
    for name in timeframes:
        _whole(config.seconds(name), base)
    rungs = F.array(*[
        F.struct(F.lit(n).alias("timeframe"), F.lit(config.seconds(n)).alias("step"))
        for n in timeframes])
    return (bars.withColumn("rung", F.explode(rungs))
            .withColumn("label", close_label("ts", F.col("rung.step")))
            .groupBy("symbol", F.col("rung.timeframe").alias("timeframe"), "label")
            .agg(*_merged())
            .withColumnRenamed("label", "ts"))


def ladder(bars: DataFrame, timeframes: Sequence[str], base: int) -> DataFrame:
    """``derive_all`` limited to closed bars: a trailing bucket still short of its label is open."""
    wide = derive_all(bars, timeframes, base)
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("_newest"))
    return wide.join(newest, "symbol").where("ts <= _newest").drop("_newest")


def price_levels(ticks: DataFrame, step: int, tick_size: float = config.TICK_SIZE) -> DataFrame:
    """Volume at price: traded and bought volume per (bar, integer tick)."""
    side = F.col("side") if "side" in ticks.columns else aggressor()
    return (ticks.select("symbol", close_label("ts", step).alias("label"),
                         tick_index("price", tick_size).alias("tick"), "volume",
                         F.when(side > 0, F.col("volume")).otherwise(0).cast("long").alias("buy"))
            .groupBy("symbol", "label", "tick")
            .agg(F.sum("volume").alias("volume"), F.sum("buy").alias("buy"))
            .withColumnRenamed("label", "ts"))


def coarser_levels(levels: DataFrame, step: int, base: int) -> DataFrame:
    """The same levels under wider bars."""
    _whole(step, base)
    return (levels.withColumn("label", close_label("ts", step))
            .groupBy("symbol", "label", "tick")
            .agg(F.sum("volume").alias("volume"), F.sum("buy").alias("buy"))
            .withColumnRenamed("label", "ts"))


def check_levels(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Bars whose level totals differ from their own volume or bought volume, counted per symbol."""
    totals = levels.groupBy("symbol", "ts").agg(
        F.sum("volume").alias("_v"), F.sum("buy").alias("_b"))
    off = ~(F.col("_v").eqNullSafe(F.col("volume")) & F.col("_b").eqNullSafe(F.col("buy_volume")))
    return (bars.join(totals, ["symbol", "ts"], "left").groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("checked"),
                 F.sum(off.cast("long")).alias("mismatched")))
