"""Causal per-bar features: volatility scale, averages, regime, order-flow absorption.

Bars carry ``bar_no`` (see ``series.number_rows``); look-back windows run in row blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe import config
from tickframe.operators.series import Running, in_blocks, number_rows, running, secs


UNIT = 1e-6     # running sums count whole units of price, so they are exact in any block


def range_scale(bars: DataFrame, step: int, *, window: int = config.SCALE_WINDOW,
                floor: int = config.SCALE_MIN_BARS, keys: Sequence[str] = ("symbol",),
                block: int | None = None) -> DataFrame:
    """Median bar range over the last ``window`` seconds, never over fewer than ``floor`` ranges.

    Null while fewer than ``floor`` ranges were seen, on a tape that has not moved, and on bars
    without a range. Bars closer together than ``step`` are an error: the look-back counts on it.
    """
    ranged = bars.withColumn("_range", F.col("high") - F.col("low"))

    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        base = Window.partitionBy(*by).orderBy(secs("ts"))
        near = base.rangeBetween(-(window - 1), 0)
        few = base.rowsBetween(-(floor - 1), 0)
        median = (F.when(F.count(F.lit(1)).over(near) >= floor, F.percentile("_range", 0.5).over(near))
                  .otherwise(F.percentile("_range", 0.5).over(few)))
        close = secs("ts") - F.lag(secs("ts")).over(base) < step
        return rows.withColumn("_median", F.when(close, F.raise_error(F.lit(
            f"bars lie closer together than {step} s")).cast("double")).otherwise(median))

    known = number_rows(ranged.where("_range is not null"), keys, name="_range_no")
    done = in_blocks(known, keys, max(floor, math.ceil(window / step)), compute, number="_range_no", block=block)
    done = done.withColumn("range_scale", F.when(
        (F.col("_range_no") >= floor - 1) & (F.col("_median") > 0), F.col("_median")))
    rest = ranged.where("_range is null").withColumn("range_scale", F.lit(None).cast("double"))
    return done.drop("_median", "_range_no", "_range").unionByName(rest.drop("_range"))


def averages(bars: DataFrame, periods: Sequence[int], name: str, *,
             keys: Sequence[str] = ("symbol",), block: int | None = None) -> DataFrame:
    """Simple averages of the close for every period, and the previous close's, as arrays.

    A slot is null until its period is full; a bar without a close is in no period and has no
    arrays. Each block keeps one running sum of whole price units and every line is a difference of two of
    its values, so the cost does not grow with the period and the block does not show.
    """
    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_close_no")
        units = F.sum(F.rint(F.col("close") / UNIT).cast("long"))
        summed = rows.withColumn("_sum", units.over(order.rowsBetween(Window.unboundedPreceding, 0)))
        lines = F.array(*[
            F.when(F.col("_close_no") >= p - 1,
                   (F.col("_sum") - F.coalesce(F.lag("_sum", p).over(order), F.lit(0))) * F.lit(1.0) / round(1 / UNIT) / p)
            for p in periods])
        return (summed.withColumn(name, lines).drop("_sum")
                .withColumn(f"{name}_prev", F.lag(name).over(order)))

    known = number_rows(bars.where("close is not null"), keys, name="_close_no")
    done = in_blocks(known, keys, max(periods) + 1, compute, number="_close_no", block=block).drop("_close_no")
    none = F.lit(None).cast("array<double>")
    return done.unionByName(bars.where("close is null").withColumns({name: none, f"{name}_prev": none}))


def ribbon(bars: DataFrame, **kw) -> DataFrame:
    """The fan of short to long averages."""
    return averages(bars, config.RIBBON_PERIODS, "ribbon", **kw)


def named_averages(bars: DataFrame, periods=config.NAMED_AVERAGES, **kw) -> DataFrame:
    """The individually named averages."""
    return averages(bars, periods, "ma", **kw)


def _sign(a, b):
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def regime_readings(bars: DataFrame) -> DataFrame:
    """Alignment, agreement and width of the fan; null until every line, its previous value
    and the scale are there."""
    now, was = F.col("ribbon"), F.col("ribbon_prev")
    warm = (F.col("range_scale").isNotNull() & now.isNotNull() & was.isNotNull()
            & ~F.exists(now, lambda x: x.isNull()) & ~F.exists(was, lambda x: x.isNull()))
    n = F.size(now)
    heads, tails = F.slice(now, F.lit(1), n - 1), F.slice(now, F.lit(2), n - 1)

    def score(left, right):
        return F.aggregate(F.zip_with(left, right, _sign), F.lit(0), lambda s, x: s + x)

    return bars.withColumns({
        "ribbon_align": F.when(warm, score(heads, tails) / (n - 1)),
        "ribbon_agree": F.when(warm, score(now, was) / n),
        "ribbon_width": F.when(warm, (F.array_max(now) - F.array_min(now)) / F.col("range_scale"))})


def regime_class():
    """One bar's regime before confirmation."""
    width, align = F.col("ribbon_width"), F.col("ribbon_align")
    trending = width >= config.REGIME_WIDTH_TREND
    return (F.when(width < config.REGIME_WIDTH_PINCH, "transition")
            .when(trending & (align >= config.REGIME_ALIGN), "up")
            .when(trending & (align <= -config.REGIME_ALIGN), "down")
            .otherwise("chop"))


def regime_label(bars: DataFrame, *, keys: Sequence[str] = ("symbol",),
                 confirm: int = config.REGIME_CONFIRM, block: int | None = None) -> DataFrame:
    """Adopted regime of the warm rows: a class counts once it held ``confirm`` rows in a row.

    Returns the warm rows with ``regime`` and ``regime_new``; the first one is adopted at once
    and never announced.
    """
    warm = number_rows(bars.where("ribbon_width is not null").withColumn("_class", regime_class()),
                       keys, name="_warm")

    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_warm")
        held = F.lit(True)
        for back in range(1, confirm):
            held = held & F.lag("_class", back).over(order).eqNullSafe(F.col("_class"))
        return rows.withColumn("_pick", F.when(held | (F.col("_warm") == 0), F.col("_class")))

    picked = in_blocks(warm, keys, confirm, compute, number="_warm", block=block)
    adopted = running(picked, keys, ["ts"], {
        "regime": Running("last", F.col("_pick")),
        "_before": Running("last", F.col("_pick"), before=True)})
    return (adopted.withColumn("regime_new", F.coalesce(F.col("regime") != F.col("_before"), F.lit(False)))
            .drop("_class", "_pick", "_before", "_warm"))


def absorption(bars: DataFrame, *, min_abs_delta: float = 0, min_volume: float = 0,
               min_delta_ratio: float = 0.0) -> DataFrame:
    """Bars closing against their own net order flow. Null where no flow was recorded."""
    delta, volume = F.col("delta"), F.col("volume")
    body = F.col("close") - F.col("open")
    big = (F.abs(delta) >= min_abs_delta) & (volume >= min_volume)
    if min_delta_ratio > 0:
        big = big & ((volume <= 0) | (F.abs(delta) / volume >= min_delta_ratio))
    side = (F.when(big & (body > 0) & (delta < 0), "buy")
            .when(big & (body < 0) & (delta > 0), "sell"))
    return (bars.withColumn("absorption_side", F.when(delta.isNotNull(), side))
            .withColumn("absorption", F.when(delta.isNotNull(), F.col("absorption_side").isNotNull())))
