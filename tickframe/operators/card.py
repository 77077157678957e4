"""The running scorecard of a session: shape, phase, flow, profile, rank against history.

All windows run inside one session instance (``session_id``), so a series splits into as many
independent partitions as it has sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe import config
from tickframe.functions.columns import percentile_rank, ratio
from tickframe.operators import profile as VP
from tickframe.operators.series import secs


def shape(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Range, net move, position and age of the extremes. ``bars``: identified, with range_scale."""
    order = Window.partitionBy(*keys, "session_id").orderBy("ts")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n, scale = F.col("session_bar"), F.col("range_scale")

    rows = bars.where("session_id is not null").withColumns({
        "_high": F.max("high").over(so_far),
        "_low": F.min("low").over(so_far),
        "_open": F.first("open").over(so_far),
        "_travel": F.sum(F.col("high") - F.col("low")).over(so_far),
        "session_traded": F.sum("volume").over(so_far),
        "session_volume": F.sum(F.when(F.col("delta").isNotNull(), F.col("volume"))).over(so_far).cast("double"),
        "_sign": F.signum(F.col("close") - F.lag("close").over(order))})
    way = F.when(F.col("_sign") != 0, F.col("_sign"))
    rows = rows.withColumns({
        "_was": F.last(way, ignorenulls=True).over(before),
        "_high_at": F.last(F.when(F.col("high") >= F.col("_high"), n), True).over(so_far),
        "_low_at": F.last(F.when(F.col("low") <= F.col("_low"), n), True).over(so_far)})
    span, net = F.col("_high") - F.col("_low"), F.col("close") - F.col("_open")
    return rows.withColumns({
        "reversal": F.coalesce(way != F.col("_was"), F.lit(False)),
        "session_bars": n,
        "session_range": span / scale,
        "session_net": net / scale,
        "session_net_ratio": ratio(net, span),
        "session_closed_ratio": ratio(F.col("close") - F.col("_low"), span),
        "session_high_at_ratio": F.col("_high_at") / n,
        "session_low_at_ratio": F.col("_low_at") / n,
        "session_travel": F.col("_travel") / scale,
    }).drop("_open", "_travel", "_sign", "_was", "_high_at", "_low_at")


def phase(rows: DataFrame, keys: Sequence[str] = ("symbol",), *, window: int = config.RECENT_WINDOW,
          floor: int = config.RECENT_MIN_BARS) -> DataFrame:
    """Recent against prior window, adjacent and never overlapping; a window under ``floor`` bars
    says nothing. Follows ``shape``."""
    base = Window.partitionBy(*keys, "session_id").orderBy(secs("ts"))
    frames = {"r": base.rangeBetween(-(window - 1), 0),
              "p": base.rangeBetween(-(2 * window - 1), -window)}
    near = frames["r"]
    sums = {}
    for k, w in frames.items():
        sums |= {
            f"_{k}_n": F.count(F.lit(1)).over(w),
            f"_{k}_span": F.max("high").over(w) - F.min("low").over(w),
            f"_{k}_travel": F.sum(F.col("high") - F.col("low")).over(w),
            f"_{k}_volume": F.sum("volume").over(w)}
    sums |= {
        "_r_rev": F.sum(F.col("reversal").cast("long")).over(near),
        "_r_flow": F.count("delta").over(near),
        "_r_delta": F.sum("delta").over(near)}
    recent, prior = F.col("_r_n") >= floor, F.col("_p_n") >= floor
    done = rows.withColumns(sums).withColumns({
        "session_efficiency_recent": F.when(recent, ratio(F.col("_r_span"), F.col("_r_travel"))),
        "session_efficiency_prior": F.when(prior, ratio(F.col("_p_span"), F.col("_p_travel"))),
        "session_range_ratio": F.when(recent & prior, ratio(F.col("_r_span"), F.col("_p_span"))),
        "session_volume_ratio": F.when(recent & prior, ratio(F.col("_r_volume"), F.col("_p_volume"))),
        "session_dir_change_rate": F.when(recent, F.col("_r_rev") / F.col("_r_n")),
        "session_delta_recent": F.when(recent & (F.col("_r_flow") >= floor), F.col("_r_delta"))})
    return done.drop(*sums)


def profile(rows: DataFrame, nested: DataFrame, keys: Sequence[str] = ("symbol",), asked: Column | None = None,
            unit: int = 1) -> DataFrame:
    """Add the session's own profile so far: poc, value area, bins, shelves and gaps.

    ``asked``, a condition on ``ts`` and the keys: only those bars get one (see ``profile.at_bars``), the others stay null.
    """
    fed = (rows.select(*keys, "session_id", "ts", "range_scale", F.lit(True).alias("publish"))
           .join(nested, ["symbol", "ts"], "left"))
    by = [*keys, "session_id"]
    made = VP.developing(fed, by) if asked is None else VP.at_bars(fed, by, asked, unit)
    hvn, lvn = VP.shelves_and_gaps(F.col("bins"), F.col("poc"))
    made = made.select(
        *keys, "ts", F.col("poc").alias("session_poc"), F.col("val").alias("session_val"),
        F.col("vah").alias("session_vah"), F.col("bins").alias("session_bins"),
        hvn.alias("session_hvn"), lvn.alias("session_lvn"),
        F.col("from_time").alias("session_from_time"), F.col("to_time").alias("session_to_time"))
    return (rows.join(made, [*keys, "ts"], "left")
            .withColumn("session_poc_ratio", ratio(F.col("session_poc") - F.col("_low"),
                                                   F.col("_high") - F.col("_low"))))


def against_history(rows: DataFrame, table: DataFrame, finals: DataFrame,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Percentile ranks at the same elapsed bar, and travel against a median full session.

    ``table`` and ``finals`` come from ``history``; ranks are null past the history's depth.
    """
    at = [*keys, "session", "session_bar"]
    joined = (rows.join(table.select(*at, "range_p", "travel_p", "volume_p"), at, "left")
              .join(finals.select(*keys, "session", "median_travel"), [*keys, "session"], "left"))
    scaled = F.col("range_scale").isNotNull()
    median = F.col("median_travel")
    return joined.withColumns({
        "session_range_percentile": percentile_rank(F.col("session_range"), F.col("range_p")),
        "session_travel_percentile": percentile_rank(F.col("session_travel"), F.col("travel_p")),
        "session_volume_percentile": F.when(
            scaled, percentile_rank(F.col("session_volume"), F.col("volume_p"))),
        "session_travel_budget": F.when(median > 0, F.col("session_travel") / median),
    }).drop("range_p", "travel_p", "volume_p", "median_travel")
