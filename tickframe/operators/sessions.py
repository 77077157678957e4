"""Exchange sessions: labels, instances, boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe import config
from tickframe.functions.columns import session_name
from tickframe.operators.series import Running, running, secs


def label(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``session`` and ``session_new`` (the name differs from the previous bar's)."""
    named = bars.withColumn("session", session_name("ts"))
    seen = running(named, keys, ["ts"], {"_was": Running("prev", F.col("session"))})
    return (seen.withColumn("session_new", ~F.col("session").eqNullSafe(F.col("_was")))
            .drop("_was"))


def identify(bars: DataFrame, keys: Sequence[str] = ("symbol",),
             tracked: Sequence[str] = config.TRACKED_SESSIONS) -> DataFrame:
    """Add ``session_id`` (first close of the instance) and ``session_bar`` (1, 2, ...).

    Both are null outside the tracked sessions. An instance ends when the name changes.
    """
    started = running(bars, keys, ["ts"], {
        "_start": Running("last", F.when(F.col("session_new"), secs("ts")))})
    held = started.withColumn("session_id",
                              F.when(F.col("session").isin(*tracked), F.col("_start")))
    by = Window.partitionBy(*keys, "_start").orderBy("ts")
    return (held.withColumn("session_bar", F.when(F.col("session_id").isNotNull(),
                                                  F.row_number().over(by).cast("long")))
            .drop("_start"))


def instances(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per tracked session instance."""
    return (bars.where("session_id is not null").groupBy(*keys, "session_id", "session")
            .agg(F.count(F.lit(1)).alias("bars"), secs(F.max("ts")).alias("last_time"),
                 F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", "ts").alias("close")))


def boundaries(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Open and close events. A close sits on the bar before the one that changed the name.

    The first bar of a series opens nothing: there is no earlier bar to have left.
    """
    seen = running(bars, keys, ["ts"], {
        "_ts": Running("prev", secs("ts")), "_name": Running("prev", F.col("session"))})
    turn = seen.where(F.col("session_new") & F.col("_ts").isNotNull())
    event = F.array(
        F.struct(F.lit("open").alias("event"), secs("ts").alias("time"),
                 F.col("session").alias("session")),
        F.struct(F.lit("close").alias("event"), F.col("_ts").alias("time"),
                 F.col("_name").alias("session")))
    return (turn.select(*keys, F.explode(event).alias("e")).select(*keys, "e.*")
            .where("session is not null"))
