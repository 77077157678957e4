"""What sessions usually look like: percentile tables, split labels, catalog, picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe import config

FULL, EXPLORE, SEALED = "full", "explore", "sealed"

# The scalar columns of the catalog, in their order.
CATALOG_SCALARS = (
    "session_bars", "range_scale", "session_range", "session_net", "session_net_ratio",
    "session_closed_ratio", "session_efficiency_recent", "session_efficiency_prior",
    "session_range_ratio", "session_volume_ratio", "session_dir_change_rate",
    "session_high_at_ratio", "session_low_at_ratio", "session_volume", "session_delta_recent",
    "session_poc", "session_poc_ratio", "session_val", "session_vah")


class CutoffMismatch(ValueError):
    """A stored table was sealed at another time than the one asked for."""


def checked_cutoff(declared: str, receipt: DataFrame | None = None):
    """The seal as a timestamp literal; a receipt (``cutoff_epoch``) that disagrees is an error."""
    cutoff = F.lit(declared).cast("timestamp")
    if receipt is not None:
        off = receipt.where(F.col("cutoff_epoch") != F.unix_seconds(cutoff)).limit(1)
        if not off.isEmpty():
            raise CutoffMismatch(f"receipt and declaration {declared} disagree")
    return cutoff


def split_label(cutoff, session_id="session_id"):
    """``sealed`` when the session's first close is at or past the cutoff."""
    return F.when(F.col(session_id) >= F.unix_seconds(cutoff), SEALED).otherwise(EXPLORE)


def _population(rows: DataFrame, population: str, cutoff) -> DataFrame:
    if population == FULL:
        return rows
    if population == EXPLORE:
        return rows.where(split_label(cutoff) == EXPLORE)
    raise ValueError(f"population must be {FULL!r} or {EXPLORE!r}, not {population!r}")


def percentile_table(rows: DataFrame, *, population: str, cutoff=None,
                     keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Breakpoints 0, 5 .. 100 of range, travel and volume per (session, elapsed bar).

    ``rows`` follow ``card.shape``; bars without a scale are left out, elapsed bars still count.
    One value per session instance reaches a group, so groups are bounded by the calendar.
    ``sessions_used`` counts a bar's sessions, ``sessions_seen`` those with any valid bar.
    """
    at = F.array(*[F.lit(p / 100.0) for p in config.PERCENTILES])
    kept = _population(rows, population, cutoff).where("range_scale is not null")
    seen = kept.groupBy(*keys, "session").agg(F.count_distinct("session_id").alias("sessions_seen"))
    return (kept.groupBy(*keys, "session", "session_bar").agg(
        F.count(F.lit(1)).alias("sessions_used"),
        F.percentile("session_range", at).alias("range_p"),
        F.percentile("session_travel", at).alias("travel_p"),
        F.percentile(F.col("session_traded").cast("double"), at).alias("volume_p"))
        .join(seen, [*keys, "session"])
        .withColumn("population", F.lit(population))
        .withColumn("cutoff", cutoff if population == EXPLORE else F.lit(None).cast("timestamp")))


def final_travel(rows: DataFrame, *, population: str, cutoff=None,
                 keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Median travel of whole sessions, each taken at its last bar with a scale."""
    kept = _population(rows, population, cutoff).where("range_scale is not null")
    ends = kept.groupBy(*keys, "session", "session_id").agg(
        F.max_by("session_travel", "session_bar").alias("_final"))
    return ends.groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("sessions"), F.percentile("_final", 0.5).alias("median_travel"))


def split_sessions(sessions: DataFrame, cutoff) -> DataFrame:
    """Session instances with their split."""
    return sessions.withColumn("split", split_label(cutoff))


def catalog(rows: DataFrame, cutoff, *, include_sealed: bool = False,
            keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per bar of a tracked session: identity, bar, card. No percentile columns: those
    would leak the sealed part. Sealed sessions only on request."""
    out = rows.withColumn("split", split_label(cutoff))
    if not include_sealed:
        out = out.where(F.col("split") == EXPLORE)
    return out.select(
        *keys, "session_id", "session", "split", F.unix_seconds("ts").alias("time"),
        "open", "high", "low", "close", "volume", "delta", *CATALOG_SCALARS,
        F.when(F.col("session_hvn").isNotNull(), F.size("session_hvn")).cast("long").alias("n_hvn"),
        F.when(F.col("session_lvn").isNotNull(), F.size("session_lvn")).cast("long").alias("n_lvn"))


def explore_sessions(sessions: DataFrame, cutoff, name: str | None = None) -> DataFrame:
    """Sessions open to inspection, optionally of one name."""
    out = split_sessions(sessions, cutoff).where(F.col("split") == EXPLORE)
    return out.where(F.col("session") == name) if name else out


def sample_sessions(sessions: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` sessions uniformly without replacement; the same whatever the partitioning.

    An empty population is an error.
    """
    if sessions.isEmpty():
        raise LookupError("no session to sample from")
    drawn = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "symbol", F.col("session_id").cast("string")))
    return sessions.orderBy(drawn, "symbol", "session_id").limit(k)
