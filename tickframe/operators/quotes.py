"""Prevailing quote of every trade: an as-of join per side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.series import Running, running


def prevailing(trades: DataFrame, quotes: DataFrame, span: int = 3600) -> DataFrame:
    """Stamp each trade with the last bid and the last ask at or before it, each side on its own.

    Trades and quotes are merged into one ordered series and the last known side is carried
    through it in time slices, so a busy symbol is spread over many tasks. ``seq`` orders rows
    of one instant; a quote of the same instant counts as before the trade.
    """
    marks = quotes.select("symbol", "ts", F.lit(0).alias("_kind"), "seq", "bid", "ask")
    none = F.lit(None).cast("double")
    asks = trades.select("symbol", "ts", F.lit(1).alias("_kind"), "seq", none.alias("bid"),
                         none.alias("ask"), *[c for c in trades.columns if c not in (
                             "symbol", "ts", "seq", "bid", "ask")])
    merged = marks.unionByName(asks, allowMissingColumns=True)
    return running(merged, ["symbol"], ["ts", "_kind", "seq"], {
        "bid": Running("last", F.col("bid")), "ask": Running("last", F.col("ask"))},
        span=span).where("_kind = 1").drop("_kind")
