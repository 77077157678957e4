"""Strategies: ``(bars, combos, keys) -> signals``. One example is shipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.series import in_blocks


def breakout(bars: DataFrame, combos: list[dict], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Break of the last ``lookback`` bars' range on the side of its middle the close is on;
    stop and target at ``k`` scales. One signal row per bar and parameter set."""
    spans = sorted({int(c["lookback"]) for c in combos})

    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("bar_no")
        return rows.withColumns({
            f"_{side}{n}": F.when(F.col("bar_no") >= n - 1, fn(col).over(order.rowsBetween(-(n - 1), 0)))
            for n in spans for side, fn, col in (("top", F.max, "high"), ("low", F.min, "low"))})

    ranged = in_blocks(bars, keys, max(spans), compute)
    choices = F.array(*[
        F.struct(F.lit(i).alias("param_id"), F.lit(float(c["k"])).alias("k"),
                 F.col(f"_top{int(c['lookback'])}").alias("top"),
                 F.col(f"_low{int(c['lookback'])}").alias("floor"))
        for i, c in enumerate(combos)])
    rows = ranged.withColumn("_c", F.explode(choices)).select(
        *bars.columns, "_c.param_id", *[F.col(f"_c.{n}").alias(f"_{n}") for n in ("k", "top", "floor")])
    up = F.col("close") > (F.col("_top") + F.col("_floor")) / 2
    ready = F.col("range_scale").isNotNull() & F.col("_top").isNotNull()
    entry = F.when(up, F.col("_top")).otherwise(F.col("_floor"))
    away = F.col("_k") * F.col("range_scale")
    return rows.select(
        *bars.columns, "param_id",
        F.when(ready, F.when(up, "long").otherwise("short")).alias("direction"),
        F.when(ready, entry).alias("entry_stop"),
        F.when(ready, F.when(up, entry - away).otherwise(entry + away)).alias("stop_price"),
        F.when(ready, F.when(up, entry + away).otherwise(entry - away)).alias("target_price"))
