"""The flat feature row of every bar: chosen groups, merged in dependency order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe import config
from tickframe.operators import card as K
from tickframe.operators import features as X
from tickframe.operators import history as H
from tickframe.operators import profile as VP
from tickframe.operators import sessions as S
from tickframe.operators import structure as ST
from tickframe.operators.series import number_rows, settle

# Field groups and the unit of each field. Fixed values.
GROUPS: dict[str, dict[str, str]] = {
    "sessions": {"session": "Asia | London | NY | null", "session_new": "bool"},
    "range_scale": {"range_scale": "points"},
    "orderflow": {"delta": "contracts", "buy_volume": "contracts", "sell_volume": "contracts",
                  "trades": "count"},
    "absorption": {"absorption": "bool", "absorption_side": "buy | sell | null"},
    "swing": {"swing": "high | low | null", "swing_price": "price", "swing_time": "epoch seconds, UTC",
              "extreme_high": "price", "extreme_high_time": "epoch seconds, UTC",
              "extreme_low": "price", "extreme_low_time": "epoch seconds, UTC",
              "hunting": "high | low", "retrace": "x range_scale", "trigger": "price"},
    "legs": {"leg": "up | down | null", "leg_from_price": "price", "leg_from_time": "epoch seconds, UTC",
             "leg_to_price": "price", "leg_to_time": "epoch seconds, UTC"},
    "breaks": {"bos": "up | down | null", "bos_level": "price", "bos_time": "epoch seconds, UTC"},
    "ribbon": {"ribbon": "price list", "ribbon_prev": "price list"},
    "regime": {"ribbon_align": "-1..+1", "ribbon_agree": "-1..+1", "ribbon_width": "x range_scale",
               "regime": "up | down | chop | transition", "regime_new": "bool"},
    "ma": {"ma": "price list", "ma_prev": "price list"},
    "profile": {"profile_poc": "price", "profile_val": "price", "profile_vah": "price",
                "profile_from_time": "epoch seconds, UTC", "profile_to_time": "epoch seconds, UTC",
                "profile_volume": "contracts", "profile_bins": "list of price, volume, buy",
                "profile_closed": "list of profiles", "value_width": "x range_scale",
                "poc_position": "0..1", "poc_distance": "x range_scale",
                "price_vs_value": "above | inside | below", "delta_at_poc": "-1..+1"},
    "session_stats": {
        "session_range": "x range_scale", "session_bars": "count", "session_net": "x range_scale",
        "session_net_ratio": "-1..+1", "session_closed_ratio": "0..1",
        "session_efficiency_recent": "0..1", "session_efficiency_prior": "0..1",
        "session_range_ratio": "ratio", "session_volume_ratio": "ratio",
        "session_dir_change_rate": "0..1", "session_high_at_ratio": "0..1",
        "session_low_at_ratio": "0..1", "session_volume": "contracts",
        "session_delta_recent": "contracts", "session_poc": "price", "session_poc_ratio": "0..1",
        "session_val": "price", "session_vah": "price", "session_bins": "list of price, volume, buy",
        "session_hvn": "price list", "session_lvn": "price list",
        "session_range_percentile": "0..1", "session_travel_percentile": "0..1",
        "session_volume_percentile": "0..1", "session_travel_budget": "ratio",
        "session_from_time": "epoch seconds, UTC", "session_to_time": "epoch seconds, UTC"},
}
NEEDS = {"absorption": ("orderflow",), "swing": ("range_scale",), "legs": ("swing",),
         "breaks": ("swing",), "regime": ("ribbon", "range_scale"), "profile": ("swing", "range_scale"),
         "session_stats": ("sessions", "range_scale")}
DETAILS = ("trigger", "leg_from_price", "leg_from_time", "leg_to_price", "leg_to_time", "bos_time",
           "swing_time", "extreme_high_time", "extreme_low_time", "ribbon", "ribbon_prev", "ma",
           "ma_prev", "profile_bins", "profile_closed", "session_bins", "session_hvn", "session_lvn")


class Dials(NamedTuple):
    """What a snapshot may be told; the rest keeps its default."""

    scale_window: int = config.SCALE_WINDOW
    recent_window: int = config.RECENT_WINDOW
    population: str = H.FULL
    cutoff: str = config.SEALED_FROM


def needed(only: Sequence[str] | None = None) -> list[str]:
    """The chosen groups and what they rest on, each once, in dependency order."""
    unknown = set(only or ()) - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown groups {sorted(unknown)}")
    wanted = set(GROUPS if only is None else only)
    for group in reversed(list(GROUPS)):
        if group in wanted:
            wanted |= set(NEEDS.get(group, ()))
    return [g for g in GROUPS if g in wanted]


def fields(only: Sequence[str] | None = None) -> list[str]:
    chosen = GROUPS if only is None else {g: GROUPS[g] for g in GROUPS if g in set(only)}
    return [f for group in chosen.values() for f in group]


def _profiles(rows: DataFrame, levels: DataFrame) -> DataFrame:
    nested = VP.nest_levels(levels)
    made = VP.swing_profiles(rows, nested)
    closed = VP.closed_profiles(rows, nested, levels)
    one = F.struct("poc", "val", "vah", "from_time", "to_time", F.col("profile_volume").alias("volume"), "bins")
    # A bar in range n has seen the profiles before n. A range without a usable bar has no profile, so
    # profiles are ranked: each reaches the ranges after it, up to the one that closes the last newer profile it outlives.
    ranked = settle(number_rows(closed.select("symbol", "range_no", F.timestamp_seconds("to_time").alias("_to"), one.alias("_p")),
                                ["symbol"], ["_to"], name="_no", time="_to"))
    ends = ranked.select("symbol", (F.col("_no") - config.MAX_CLOSED_PROFILES).alias("_no"), F.col("range_no").alias("_until"))
    newest = made.groupBy("symbol").agg(F.max("range_no").alias("_newest"))
    reach = ranked.join(ends, ["symbol", "_no"], "left").join(newest, "symbol").withColumn(
        "_until", F.coalesce("_until", "_newest")).where("_until > range_no")
    held = reach.select("symbol", F.explode(F.sequence(F.col("range_no") + 1, F.col("_until"))).alias("range_no"), "_no", "_p")
    lists = held.groupBy("symbol", "range_no").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_no", "_p"))), lambda x: x["_p"]).alias("profile_closed"))
    return (made.join(lists, ["symbol", "range_no"], "left").select(
        "symbol", "ts", F.col("poc").alias("profile_poc"), F.col("val").alias("profile_val"),
        F.col("vah").alias("profile_vah"), F.col("from_time").alias("profile_from_time"),
        F.col("to_time").alias("profile_to_time"), "profile_volume", F.col("bins").alias("profile_bins"),
        "profile_closed", "value_width", "poc_position", "poc_distance", "price_vs_value", "delta_at_poc"))


def snapshot(bars: DataFrame, step: int, *, levels: DataFrame | None = None,
             only: Sequence[str] | None = None, dials: Dials = Dials()) -> DataFrame:
    """One row per bar with the fields of the chosen groups (all of them: 76).

    Groups that were not chosen are not computed. Without ``levels`` the profile fields are null.
    """
    run = needed(only)
    rows = number_rows(bars, ["symbol"])
    if "range_scale" in run:
        rows = settle(X.range_scale(rows, step, window=dials.scale_window))
    if "sessions" in run:
        rows = settle(S.label(rows))
    if "absorption" in run:
        rows = X.absorption(rows)
    if "ribbon" in run:
        rows = settle(X.ribbon(rows))
    if "ma" in run:
        rows = X.named_averages(rows)
    if "regime" in run:
        rows = settle(X.regime_readings(rows))
        label = X.regime_label(rows.select("symbol", "ts", "ribbon_align", "ribbon_width"))
        rows = rows.join(label.select("symbol", "ts", "regime", "regime_new"), ["symbol", "ts"], "left")
    if {"swing", "breaks", "legs", "profile"} & set(run):
        rows = settle(ST.structure(rows))
    base = rows
    if "legs" in run:
        rows = rows.join(ST.legs(base), ["symbol", "ts"], "left")
    if "profile" in run and levels is not None:
        rows = rows.join(_profiles(base, levels), ["symbol", "ts"], "left")
    if "session_stats" in run:
        card = settle(K.phase(K.shape(S.identify(base)), window=dials.recent_window))
        if levels is not None:
            card = settle(K.profile(card, VP.nest_levels(levels)))
        cutoff = H.checked_cutoff(dials.cutoff)
        card = K.against_history(
            card, H.percentile_table(card, population=dials.population, cutoff=cutoff),
            H.final_travel(card, population=dials.population, cutoff=cutoff))
        own = [f for f in GROUPS["session_stats"] if f in card.columns]
        rows = rows.join(card.select("symbol", "ts", *own), ["symbol", "ts"], "left")
    units = {f: u for group in GROUPS.values() for f, u in group.items()}
    keep = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    return rows.select(*keep, *[
        (F.col(f) if f in rows.columns else F.lit(None).cast("double")).alias(f, metadata={"unit": units[f]})
        for f in fields(only)])
