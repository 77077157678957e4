"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe import config
from tickframe.operators import bars as B
from tickframe.operators import card as K
from tickframe.operators import features as X
from tickframe.operators import history as H
from tickframe.operators import orders as O
from tickframe.operators import prepare as P
from tickframe.operators import profile as VP
from tickframe.operators import quotes as QT
from tickframe.operators import research as RE
from tickframe.operators import sessions as S
from tickframe.operators import stats as Q
from tickframe.operators import structure as ST
from tickframe.operators.series import number_rows, secs, settle, shared_folder
from tickframe.plans import market as M
from tickframe.plans import search as SG
from tickframe.plans import snapshot as SN
from tickframe.plans.strategies import breakout
from tickframe.schemas import FLOW, OHLC
from tickframe.sources import bars as SB
from tickframe.sources import capture as CP
from tickframe.sources import results as RS
from tickframe.streaming import live as LV
from tickframe.streaming import rows as RW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _bars_out(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, "symbol", secs("ts").alias("time"), *OHLC, "volume", *FLOW)


# ---- trades to bars ---------------------------------------------------------

@query
def aggressor_flow(spark, sf):
    t = M.ticks(spark, sf).select("symbol", "volume", B.aggressor().alias("side"))
    return t.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("prints"), F.sum("volume").alias("volume"),
        F.sum(F.col("volume") * F.col("side")).alias("delta"))


@query
def back_adjusted_prices(spark, sf):
    raw = M.ticks(spark, sf).withColumn("raw_price", F.col("price"))
    return B.back_adjust(raw).select("symbol", "seq", "raw_price", "price", "adj")


@query
def bars_base(spark, sf):
    return _bars_out(B.fold_ticks(M.ticks(spark, sf), 3600))


@query
def bars_derived(spark, sf):
    base = M.bars(spark, sf, "event_type", 3600)
    return _bars_out(B.derive_all(base, ["4h", "1d"], 3600), "timeframe")


@query
def bars_ladder_null_flow(spark, sf):
    base = M.bars(spark, sf)
    kept = F.pmod(F.floor(secs("ts") / 900), F.lit(7)) != 0
    holed = base.select("symbol", "ts", *OHLC, "volume", *[F.when(kept, F.col(c)).alias(c) for c in FLOW])
    return _bars_out(B.ladder(holed, ["30m", "60m"], 900), "timeframe")


# ---- preparation and access -------------------------------------------------

@query
def gap_segments(spark, sf):
    marked = settle(P.mark_gaps(M.bars(spark, sf), 900))
    return P.number_segments(marked).select("symbol", secs("ts").alias("time"), "gap_before", "segment")


@query
def window_filter(spark, sf):
    return _bars_out(P.within(M.bars(spark, sf, "event_type", 3600),
                              "2024-01-05 00:00:00", "2024-01-19 12:00:00"))


@query
def zero_volume_policy(spark, sf):
    thin = M.bars(spark, sf).withColumn(
        "volume", F.when(F.col("volume") < 4, 0).otherwise(F.col("volume")).cast("long"))
    return P.prepare(thin, 900, skip_empty=True).select(
        "symbol", secs("ts").alias("time"), "volume", "gap_before")


@query
def bar_summary(spark, sf):
    return P.summarise(P.mark_gaps(M.bars(spark, sf, "event_type", 3600), 3600))


@query
def dataset_listing(spark, sf):
    base = M.bars(spark, sf, "event_type", 3600)
    both = base.withColumn("timeframe", F.lit("60m")).unionByName(
        B.derive(base, 14400, 3600).withColumn("timeframe", F.lit("4h")))
    return P.datasets(both)


@query
def slice_bars(spark, sf):
    return P.slice_rows(M.bars(spark, sf, "event_type", 3600), 100, 250).select(
        "symbol", "bar_no", secs("ts").alias("time"), "close")


@query
def locate_bar(spark, sf):
    asks = M.events(spark, sf).select(
        F.col("event_type").alias("symbol"),
        (secs(F.date_trunc("minute", "ts")) + 7200).alias("time")).distinct()
    return P.locate(M.bars(spark, sf, "event_type", 3600), asks)


# ---- sessions ---------------------------------------------------------------

def _sessions(base: DataFrame) -> DataFrame:
    return S.identify(settle(S.label(base)))


@query
def session_labels(spark, sf):
    return _sessions(M.bars(spark, sf)).select(
        "symbol", secs("ts").alias("time"), "session", "session_new", "session_id", "session_bar")


@query
def session_instances(spark, sf):
    return S.instances(_sessions(M.bars(spark, sf)))


@query
def session_boundaries(spark, sf):
    return S.boundaries(settle(S.label(M.bars(spark, sf))))



# ---- features ---------------------------------------------------------------

def _time():
    return secs("ts").alias("time")


def _rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _scaled(base: DataFrame, step: int) -> DataFrame:
    """Numbered bars with the volatility scale, as a table."""
    return settle(X.range_scale(number_rows(base, ["symbol"]), step, window=M.TEST_WINDOW))


@query
def range_scale(spark, sf):
    return _scaled(M.bars(spark, sf, "event_type", 3600), 3600).select("symbol", _time(), "range_scale")


@query
def absorption(spark, sf):
    return X.absorption(M.bars(spark, sf)).select("symbol", _time(), "absorption", "absorption_side")


@query
def session_absorption(spark, sf):
    """Signed-flow bars with gap flags and sessions: which session absorbs the most."""
    marked = P.mark_gaps(M.bars(spark, sf), M.STEP)
    rows = X.absorption(marked.withColumn("session", S.session_name("ts")))
    hit = F.col("absorption").cast("long")
    return rows.groupBy(F.coalesce("session", F.lit("halt")).alias("session")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.col("gap_before").cast("long")).alias("gaps"),
        F.sum("delta").alias("delta"), F.sum(hit).alias("absorbed"),
        F.round(F.avg(hit), 6).alias("absorbed_share"))


@query
def ribbon_lines(spark, sf):
    fan = X.ribbon(number_rows(M.bars(spark, sf), ["symbol"]))
    lines = F.transform("ribbon", lambda v, i: F.struct(
        F.get(F.array(*[F.lit(p) for p in config.RIBBON_PERIODS]), i).alias("period"),
        F.round(v, 6).alias("value"), F.round(F.get("ribbon_prev", i), 6).alias("previous")))
    return (fan.select("symbol", _time(), F.explode(lines).alias("l"))
            .select("symbol", "time", "l.*"))


@query
def named_averages(spark, sf):
    lines = X.named_averages(number_rows(M.bars(spark, sf), ["symbol"]))
    return lines.select("symbol", _time(), *[
        F.round(F.get("ma", F.lit(i)), 6).alias(f"ma_{p}") for i, p in enumerate(config.NAMED_AVERAGES)])


def _regime(spark, sf) -> DataFrame:
    return X.regime_readings(X.ribbon(_scaled(M.bars(spark, sf), M.STEP)))


@query
def regime_readings(spark, sf):
    return _regime(spark, sf).select(
        "symbol", _time(), *_rounded("ribbon_align", "ribbon_agree", "ribbon_width"))


@query
def regime_label(spark, sf):
    rows = settle(_regime(spark, sf).select("symbol", "ts", "ribbon_align", "ribbon_width"))
    return X.regime_label(rows).select("symbol", _time(), "regime", "regime_new")


# ---- structure --------------------------------------------------------------

def _structure(spark, sf, by="event_type", step=3600) -> DataFrame:
    return ST.structure(_scaled(M.bars(spark, sf, by, step), step))


@query
def swings(spark, sf):
    return _structure(spark, sf).select(
        "symbol", _time(), "swing", "swing_price", "swing_time", "extreme_high", "extreme_high_time",
        "extreme_low", "extreme_low_time", "hunting", F.round("retrace", 6).alias("retrace"), "trigger")


@query
def breaks(spark, sf):
    return _structure(spark, sf).where("bos is not null").select(
        "symbol", _time(), "bos", "bos_level", "bos_time")


@query
def legs(spark, sf):
    return ST.legs(settle(_structure(spark, sf))).select(
        "symbol", _time(), "leg", "leg_from_price", "leg_from_time", "leg_to_price", "leg_to_time")


@query
def structure_events(spark, sf):
    return ST.structure_events(X.absorption(_structure(spark, sf)))


@query
def latest_per_key(spark, sf):
    events = settle(ST.structure_events(X.absorption(_structure(spark, sf))))
    by_layer = ST.newest_per_layer(events).withColumn("rule", F.lit("layer"))
    by_id = ST.newest_per_id(events, ["symbol", "layer", "kind"]).withColumn("rule", F.lit("id"))
    return by_layer.unionByName(by_id)


# ---- volume profiles --------------------------------------------------------

@query
def vap_levels(spark, sf):
    fine = M.levels(spark, sf, "event_type", 3600)
    coarse = B.coarser_levels(fine, 14400, 3600).withColumn("timeframe", F.lit("4h"))
    both = fine.withColumn("timeframe", F.lit("60m")).unionByName(coarse)
    return both.select("symbol", "timeframe", _time(), "tick", "volume", "buy")


@query
def vap_invariant(spark, sf):
    return B.check_levels(M.bars(spark, sf, "event_type", 3600), M.levels(spark, sf, "event_type", 3600))


@query
def range_histogram(spark, sf):
    """Overlapping 200,000 second ranges, one per day."""
    days = M.bars(spark, sf).select("symbol", F.floor(secs("ts") / 86400).alias("d")).distinct()
    start = F.col("d") * 86400 + 30000
    ranges = days.select("symbol", start.alias("range_id"), start.alias("start"),
                         (start + 200000).alias("end"))
    return VP.histogram(M.levels(spark, sf), ranges, M.STEP)


@query
def range_histogram_every_bar(spark, sf):
    """One range a bar, the day up to it: total and fullest tick of each."""
    bars, levels = M.bars(spark, sf), M.levels(spark, sf)
    ranges = bars.select("symbol", secs("ts").alias("range_id"), (secs("ts") - 86000).alias("start"), secs("ts").alias("end"))
    return VP.histogram(levels, ranges, M.STEP).groupBy("symbol", F.col("range_id").alias("time")).agg(
        F.sum("volume").alias("volume"), F.sum("buy").alias("buy"), F.count("*").alias("ticks"), F.min("tick").alias("low"),
        F.max("tick").alias("high"), F.max("volume").alias("fullest"))


def _session_bins(spark, sf) -> DataFrame:
    """Whole-session profiles, binned with the session's last known scale."""
    scaled = _scaled(M.bars(spark, sf), M.STEP)
    rows = settle(_sessions(scaled).where("session_id is not null")
                  .select("symbol", "ts", "session_id", "range_scale"))
    size = rows.where("range_scale is not null").groupBy("symbol", "session_id").agg(
        (F.max_by("range_scale", "ts") / config.BINS_PER_SCALE).alias("bin_size"))
    folded = (M.levels(spark, sf).join(rows, ["symbol", "ts"]).groupBy("symbol", "session_id", "tick")
              .agg(F.sum("volume").alias("volume"), F.sum("buy").alias("buy"))
              .join(size, ["symbol", "session_id"]))
    return VP.rebin(folded, ["symbol", "session_id"])


@query
def rebin_profile(spark, sf):
    return _session_bins(spark, sf).select(
        "symbol", "session_id", F.round("price", 6).alias("price"), "volume", "buy")


def _session_profiles(spark, sf) -> DataFrame:
    return VP.summarise(VP.as_bins(_session_bins(spark, sf), ["symbol", "session_id"]))


@query
def value_area(spark, sf):
    return _session_profiles(spark, sf).select(
        "session_id", *_rounded("poc", "val", "vah"), F.col("profile_volume").alias("volume"))


@query
def hvn_lvn(spark, sf):
    made = _session_profiles(spark, sf)
    hvn, lvn = VP.shelves_and_gaps(F.col("bins"), F.col("poc"))
    nodes = F.array(F.struct(F.lit("hvn").alias("kind"), hvn.alias("at")),
                    F.struct(F.lit("lvn").alias("kind"), lvn.alias("at")))
    return (made.select("session_id", F.explode(nodes).alias("n"))
            .select("session_id", "n.kind", F.explode("n.at").alias("price"))
            .select("session_id", "kind", F.round("price", 6).alias("price")))


def _turned(spark, sf):
    """Bars with swings, and their levels."""
    return settle(_structure(spark, sf, "ALL", M.STEP)), M.levels(spark, sf)


@query
def closed_profiles(spark, sf):
    rows, lv = _turned(spark, sf)
    closed = settle(VP.closed_profiles(rows, VP.nest_levels(lv), lv))
    newest = VP.newest_profiles(closed).select("symbol", "range_no", F.lit(True).alias("_k"))
    return closed.join(newest, ["symbol", "range_no"], "left").select(
        "symbol", "confirmed_time", "from_time", "to_time", *_rounded("poc", "val", "vah"),
        "profile_volume", F.coalesce("_k", F.lit(False)).alias("kept"))


@query
def profile_readings(spark, sf):
    rows, lv = _turned(spark, sf)
    return VP.swing_profiles(rows, VP.nest_levels(lv)).select(
        "symbol", _time(), "from_time", *_rounded("poc", "val", "vah"), "profile_volume",
        *_rounded("value_width", "poc_position", "poc_distance", "delta_at_poc"), "price_vs_value")


@query
def profile_at_asked_bars(spark, sf):
    """The developing profile on the bars that close an hour, from the index alone."""
    rows, lv = _turned(spark, sf)
    return VP.swing_profiles(rows, VP.nest_levels(lv), secs("ts") % 3600 == 0, M.STEP).select(
        "symbol", _time(), "from_time", *_rounded("poc", "val", "vah"), "profile_volume",
        *_rounded("value_width", "poc_position", "poc_distance", "delta_at_poc"), "price_vs_value")


# ---- session card and history -----------------------------------------------

def _card(spark, sf) -> DataFrame:
    return K.phase(K.shape(_sessions(_scaled(M.bars(spark, sf), M.STEP))), window=M.TEST_WINDOW)


@query
def card_shape(spark, sf):
    return _card(spark, sf).select("symbol", _time(), "session_bars", *_rounded(
        "session_range", "session_net", "session_net_ratio", "session_closed_ratio",
        "session_high_at_ratio", "session_low_at_ratio"))


@query
def card_phase(spark, sf):
    return _card(spark, sf).select("symbol", _time(), *_rounded(
        "session_efficiency_recent", "session_efficiency_prior", "session_range_ratio",
        "session_volume_ratio", "session_dir_change_rate"))


@query
def card_flow(spark, sf):
    return _card(spark, sf).select("symbol", _time(), "session_volume", "session_delta_recent")


@query
def card_profile(spark, sf):
    rows = settle(_card(spark, sf))
    return (K.profile(rows, VP.nest_levels(M.levels(spark, sf))).where("session_poc is not null")
            .select("symbol", _time(), "session_from_time",
                    *_rounded("session_poc", "session_val", "session_vah", "session_poc_ratio"),
                    F.size("session_hvn").cast("long").alias("n_hvn"),
                    F.size("session_lvn").cast("long").alias("n_lvn")))


@query
def card_profile_at_asked_bars(spark, sf):
    rows = settle(_card(spark, sf))
    found = K.profile(rows, VP.nest_levels(M.levels(spark, sf)), asked=secs("ts") % 3600 == 0, unit=M.STEP)
    return found.where("session_poc is not null").select(
        "symbol", _time(), "session_from_time", *_rounded("session_poc", "session_val", "session_vah", "session_poc_ratio"),
        F.size("session_hvn").cast("long").alias("n_hvn"), F.size("session_lvn").cast("long").alias("n_lvn"))


def _cutoff():
    return H.checked_cutoff(M.SEALED_FROM)


@query
def card_percentiles(spark, sf):
    rows = settle(_card(spark, sf))
    ranked = K.against_history(rows, H.percentile_table(rows, population=H.FULL),
                               H.final_travel(rows, population=H.FULL))
    return ranked.select("symbol", _time(), *_rounded(
        "session_range_percentile", "session_travel_percentile", "session_volume_percentile"))


@query
def travel_budget(spark, sf):
    rows = settle(_card(spark, sf))
    ranked = K.against_history(
        rows, H.percentile_table(rows, population=H.EXPLORE, cutoff=_cutoff()),
        H.final_travel(rows, population=H.EXPLORE, cutoff=_cutoff()))
    return ranked.select("symbol", _time(), *_rounded("session_travel_budget"))


@query
def history_percentiles(spark, sf):
    table = H.percentile_table(_card(spark, sf), population=H.EXPLORE, cutoff=_cutoff())
    zipped = F.transform(
        F.arrays_zip("range_p", "travel_p", "volume_p"),
        lambda p, i: F.struct((i * 5).cast("long").alias("pct"), p["range_p"].alias("range_x"),
                              p["travel_p"].alias("travel_x"), p["volume_p"].alias("volume")))
    return (table.select("symbol", "session", F.col("session_bar").alias("elapsed_bar"),
                         "sessions_used", F.explode(zipped).alias("z"))
            .select("symbol", "session", "elapsed_bar", "sessions_used", "z.*")
            .select("symbol", "session", "elapsed_bar", "sessions_used", "pct",
                    *_rounded("range_x", "travel_x", "volume")))


@query
def median_final_travel(spark, sf):
    return H.final_travel(_card(spark, sf), population=H.FULL).select(
        "symbol", "session", "sessions", F.round("median_travel", 6).alias("median_travel"))


@query
def split_labels(spark, sf):
    found = S.instances(_sessions(M.bars(spark, sf)))
    return H.split_sessions(found, _cutoff()).select("symbol", "session_id", "session", "bars", "split")


@query
def session_catalog(spark, sf):
    rows = settle(_card(spark, sf))
    full = K.profile(rows, VP.nest_levels(M.levels(spark, sf)))
    made = H.catalog(full, _cutoff())
    exact = {"session_bars", "range_scale", "session_delta_recent"}
    return made.select(*[F.round(c, 6).alias(c) if c in H.CATALOG_SCALARS and c not in exact else c
                         for c in made.columns])


@query
def explore_sample(spark, sf):
    found = settle(S.instances(_sessions(M.bars(spark, sf))))
    return H.sample_sessions(H.explore_sessions(found, _cutoff(), "NY"), 5, 7).select(
        "symbol", "session_id", "session", "split", "bars")


# ---- orders, trades, search -------------------------------------------------

GRID = {"lookback": [4, 8], "k": [1.0, 2.0]}
BOOK = {"point_value": M.POINT_VALUE}


def _tradable(spark, sf) -> DataFrame:
    """Numbered bars with scale, gap flag and segment."""
    marked = settle(P.mark_gaps(_scaled(M.bars(spark, sf), M.STEP), M.STEP))
    return settle(P.number_segments(marked))


def _trades(spark, sf) -> DataFrame:
    signals = breakout(_tradable(spark, sf), SG.expand(GRID))
    book = settle(O.trade_book(signals, keys=["symbol", "param_id"], **BOOK))
    return settle(O.sequence_trades(book, ["symbol", "param_id"]))


@query
def next_bar_fills(spark, sf):
    """Every signal of every parameter set against the bar that follows it, if there is one."""
    bars = _tradable(spark, sf)
    signals = breakout(bars, SG.expand(GRID)).where("direction is not null")
    following = bars.select("symbol", (F.col("bar_no") - 1).alias("bar_no"),
                            *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low")])
    o, h, low = (F.col(f"_{c}") for c in ("open", "high", "low"))
    way = F.col("direction")
    rows = (signals.join(following, ["symbol", "bar_no"], "left")
            .withColumn("entry_price", O.entry_price(way, F.col("entry_stop"), o, h, low))
            .withColumn("x", O.exit_fill(way, F.col("stop_price"), F.col("target_price"), o, h, low)))
    return rows.select("symbol", F.col("param_id").cast("long").alias("param_id"), _time(), "direction", "entry_price",
                       F.col("x.price").alias("exit_price"), F.col("x.reason").alias("reason"), F.col("x.ambiguous").alias("ambiguous"))


@query
def bracket_outcomes(spark, sf):
    signals = breakout(_tradable(spark, sf), SG.expand(GRID))
    return O.bracket_outcomes(signals, keys=["symbol", "param_id"], series=["symbol"]).select(
        "symbol", F.col("param_id").cast("long").alias("param_id"), "segment", "time", "direction", "entry_time", "entry_price", "exit_time",
        "exit_price", "reason", "ambiguous", "same_bar")


@query
def trade_book(spark, sf):
    return _trades(spark, sf).select(
        "symbol", F.col("param_id").cast("long").alias("param_id"), "num", "entry_time", "exit_time",
        "direction", "entry_price", "exit_price", "size", "pnl_points", "pnl_dollars", "commission",
        "reason", "ambiguous", "same_bar", "bars", "mae", "mfe", "etd", "cum_pnl")


@query
def published_trades(spark, sf):
    """Trades of a run that was published twice, the first time without half of them."""
    path = f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    trades = settle(_trades(spark, sf))
    folds = trades.groupBy("symbol", "param_id").agg(F.sum("pnl_dollars").alias("pnl"))
    RS.publish_run(spark, path, "breakout", {"trades": trades.where("num % 2 = 0")}, {"try": 1})
    RS.publish_run(spark, path, "breakout", {"trades": trades, "folds": folds}, {"try": 2})
    return RS.read_run(spark, path, "breakout", "trades").select(
        "symbol", F.col("param_id").cast("long").alias("param_id"), "num", "entry_time", "exit_time",
        "direction", "entry_price", "exit_price", "size", "pnl_points", "pnl_dollars", "commission",
        "reason", "ambiguous", "same_bar", "bars", "mae", "mfe", "etd", "cum_pnl")


def _no_infinity(df: DataFrame) -> DataFrame:
    return RS.storable(df).select(*[
        F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query
def trade_stats(spark, sf):
    found = Q.summarise(_trades(spark, sf), ["symbol", "param_id"])
    return _no_infinity(found.withColumn("param_id", F.col("param_id").cast("long")))


@query
def win_loss_streaks(spark, sf):
    return Q.streaks(Q.by_scope(_trades(spark, sf)), ["symbol", "scope"],
                     ["exit_time", "param_id"])


@query
def equity_curve(spark, sf):
    curve = Q.equity_curve(_trades(spark, sf), ["symbol", "param_id"])
    return curve.select("symbol", F.col("param_id").cast("long").alias("param_id"), "exit_time",
                        "equity", "peak", "drawdown")


@query
def sweep_ranked(spark, sf):
    ranked = SG.sweep(_tradable(spark, sf), breakout, GRID, "profit_factor", min_trades=2, **BOOK)
    named = ranked.join(SG.grid_frame(spark, GRID), "param_id")
    return RS.storable(named.select(
        "symbol", F.col("param_id").cast("long").alias("param_id"), F.col("params")["lookback"].alias("lookback"),
        F.col("params")["k"].alias("k"), F.round("score", 6).alias("score"), "n_trades",
        F.col("place").cast("long").alias("place")))


WALK = {"is_days": 10, "oos_days": 4, "step_days": 4, "min_trades": 2}


@query
def walk_forward_folds(spark, sf):
    base = M.bars(spark, sf, "event_type", 3600)
    both = [SG.fold_windows(base, 10, 4, 4, a).withColumn("anchored", F.lit(a)) for a in (False, True)]
    return both[0].unionByName(both[1]).withColumn("fold", F.col("fold").cast("long"))


def _walk(spark, sf):
    return SG.walk_forward(_tradable(spark, sf), breakout, GRID, "profit_factor", **WALK, **BOOK)


@query
def walk_forward_results(spark, sf):
    results, _ = _walk(spark, sf)
    return _no_infinity(results.select(
        "symbol", F.col("fold").cast("long").alias("fold"), "oos_start", "oos_end",
        F.col("param_id").cast("long").alias("param_id"), "is_score", "oos_score", "n_oos_trades"))


@query
def walk_forward_oos(spark, sf):
    _, trades = _walk(spark, sf)
    return trades.select("symbol", F.col("fold").cast("long").alias("fold"), "num", "entry_time",
                         "exit_time", "direction", "pnl_dollars", "cum_pnl")


@query
def walk_forward_efficiency(spark, sf):
    results, _ = _walk(spark, sf)
    return _no_infinity(SG.efficiency(settle(results)))


# ---- quotes, captured events, streams ---------------------------------------

def _quotes_and_trades(spark, sf):
    """Every third event is a quote change, one side of it missing on every fifth; the rest trade."""
    rows = M.ticks(spark, sf, "ALL")
    third, fifth = F.pmod("seq", F.lit(3)) == 0, F.pmod("seq", F.lit(5))
    quotes = rows.where(third).select(
        "symbol", "ts", "seq", F.when(fifth != 1, F.col("bid")).alias("bid"),
        F.when(fifth != 2, F.col("ask")).alias("ask"))
    return quotes, rows.where(~third).select("symbol", "ts", "seq", "price")


@query
def prevailing_quote(spark, sf):
    quotes, trades = _quotes_and_trades(spark, sf)
    return QT.prevailing(trades, quotes).select("symbol", _time(), "seq", "price", "bid", "ask")


@query
def captured_trades(spark, sf):
    """Events written as captured JSON lines, read back, unpacked and netted by their own side."""
    rows = M.events(spark, sf)
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    trade = F.struct(
        F.col("event_type").alias("symbolId"), F.col("value").alias("price"), stamp.alias("timestamp"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("type"),
        (1 + F.pmod("user_id", F.lit(7))).alias("volume"))
    # One line carries the contract's trades among 32 consecutive events: never more than 32.
    lines = (rows.groupBy(F.col("event_type").alias("contract"), F.floor(F.col("event_id") / 32).alias("b"))
             .agg(F.sort_array(F.collect_list(F.struct("event_id", trade.alias("t")))).alias("l"),
                  F.max("ts").alias("m"))
             .select(F.col("m").cast("string").alias("recv"), F.lit(CP.TRADE_EVENT).alias("event"), "contract",
                     F.to_json(F.transform("l", lambda x: x["t"])).alias("payload")))
    path = f"{shared_folder(spark).rstrip('/')}/capture-{uuid.uuid4().hex}"
    lines.write.json(path)
    found = CP.trades(CP.read_capture(spark, path))
    return found.groupBy("symbol", secs(F.date_trunc("hour", "ts")).alias("time")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("volume").alias("volume"),
        F.sum(F.col("volume") * F.col("side")).alias("delta"), F.min_by("price", "ts").alias("first_price"))


def _captured_lines(spark, sf) -> DataFrame:
    """``n`` (the file a line arrives in) and captured lines: trades by contract and 32 events, quotes of every third event.

    Every fifth block of trades is sent again in the next file, of every eleventh half a line was left by a broken connection.
    """
    rows = M.events(spark, sf)
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    block = F.floor(F.col("event_id") / 32)
    trade = F.struct(F.col("event_type").alias("symbolId"), F.col("value").alias("price"), stamp.alias("timestamp"),
                     F.pmod("event_id", F.lit(2)).cast("int").alias("type"), (1 + F.pmod("user_id", F.lit(7))).alias("volume"))
    trades = (rows.groupBy(F.col("event_type").alias("contract"), block.alias("b"))
              .agg(F.sort_array(F.collect_list(F.struct("event_id", trade.alias("t")))).alias("l"), F.max("ts").alias("m"))
              .select("b", F.col("m").cast("string").alias("recv"), F.lit(CP.TRADE_EVENT).alias("event"), "contract",
                      F.to_json(F.transform("l", lambda x: x["t"])).alias("payload")))
    bid, ask = F.col("value").alias("bestBid"), F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("value") + 0.25).alias("bestAsk")
    quotes = rows.where(F.pmod("event_id", F.lit(3)) == 0).select(
        block.alias("b"), F.col("ts").cast("string").alias("recv"), F.lit(CP.QUOTE_EVENT).alias("event"), F.col("event_type").alias("contract"),
        F.to_json(F.struct(bid, ask, stamp.alias("lastUpdated"), F.col("event_id").cast("string").alias("symbol"))).alias("payload"))
    lines = trades.unionByName(quotes).withColumn("n", F.pmod("b", F.lit(3))).withColumn(
        "value", F.to_json(F.struct("recv", "event", "contract", "payload")))
    again = lines.where((F.col("event") == CP.TRADE_EVENT) & (F.col("b") % 5 == 0)).withColumn("n", F.col("n") + 1)
    half = lines.where((F.col("event") == CP.TRADE_EVENT) & (F.col("b") % 11 == 0)).withColumn(
        "value", F.expr("left(value, 40)"))
    return lines.unionByName(again).unionByName(half).select("n", "value")


@query
def stream_capture_replay(spark, sf):
    """Captured lines as a stream in four files, with lines sent twice and lines cut short: trades, quotes, broken lines."""
    _stateful(spark)
    home = f"{shared_folder(spark).rstrip('/')}/capture-{uuid.uuid4().hex}"
    lines = settle(_captured_lines(spark, sf))
    for n in range(4):
        lines.where(F.col("n") == n).select("value").coalesce(4).write.mode("append").text(f"{home}/in")
        for q in CP.ingest(CP.stream_capture(spark, f"{home}/in"), f"{home}/out", f"{home}/log", "3650 days", {"availableNow": True}):
            q.awaitTermination()
    hour = secs(F.date_trunc("hour", "ts")).alias("time")
    none = F.lit(None)
    trades = spark.read.parquet(f"{home}/out/trades").groupBy(F.lit("trade").alias("kind"), "symbol", hour).agg(
        F.count("*").alias("rows"), F.sum("volume").alias("volume"), F.sum(F.col("volume") * F.col("side")).alias("delta"))
    quotes = spark.read.parquet(f"{home}/out/quotes").groupBy(F.lit("quote").alias("kind"), "symbol", hour).agg(
        F.count("*").alias("rows"), F.count("bid").alias("volume"), F.count("ask").alias("delta"))
    broken = spark.read.parquet(f"{home}/out/broken").agg(F.count("*").alias("rows")).select(
        F.lit("broken").alias("kind"), none.cast("string").alias("symbol"), none.cast("long").alias("time"), "rows",
        none.cast("long").alias("volume"), none.cast("long").alias("delta"))
    return trades.unionByName(quotes).unionByName(broken)


RUNGS = ("30m", "60m")


def _stateful(spark) -> None:
    """Stateful processors keep their state in RocksDB; a session says so before it starts them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _thirds(rows: DataFrame) -> list[DataFrame]:
    """Three consecutive parts of the month, as a feed would deliver them."""
    cuts = [F.lit(c).cast("timestamp") for c in ("2024-01-11", "2024-01-21")]
    ts = F.col("ts")
    return [rows.where(ts <= cuts[0]), rows.where((ts > cuts[0]) & (ts <= cuts[1])), rows.where(ts > cuts[1])]


def _shuffled(rows: DataFrame) -> list[DataFrame]:
    """The month in three parts, every part's rows in an order of their hash, and what lets the last ones go."""
    return [p.orderBy(F.xxhash64("symbol", "ts")) for p in _thirds(rows)] + [LV.closing(rows)]


@query
def stream_bars_replay(spark, sf):
    rows = settle(B.back_adjust(M.ticks(spark, sf, "ALL")).select("symbol", "ts", "seq", "price", "volume", "side"))
    return _bars_out(LV.replay(spark, _thirds(rows), lambda s: LV.stream_bars(s, M.STEP)))


@query
def stream_rungs_replay(spark, sf):
    """Two timeframes of closed bars from one tick stream."""
    rows = settle(B.back_adjust(M.ticks(spark, sf, "ALL")).select("symbol", "ts", "seq", "price", "volume", "side"))
    rungs = [_bars_out(LV.replay(spark, _thirds(rows), lambda s, n=name: LV.stream_rungs(s, RUNGS)[n])
                       .withColumn("timeframe", F.lit(name)), "timeframe") for name in RUNGS]
    return rungs[0].unionByName(rungs[1])


def _live():
    return LV.LiveStructure(window=M.TEST_WINDOW)


@query
def stream_structure_replay(spark, sf):
    _stateful(spark)
    bars = M.bars(spark, sf, "event_type", 3600)
    found = LV.replay(spark, _shuffled(bars), lambda s: LV.stream_structure(s, _live)).where("not late")
    return found.select("symbol", "time", "range_scale", "swing", "swing_price", "swing_time", "hunting",
                        F.round("retrace", 6).alias("retrace"), "trigger", "bos", "bos_level", "bos_time")


@query
def stream_seek(spark, sf):
    """Start mid-month from a silently warmed state; the rest equals having played into it."""
    _stateful(spark)
    parts = _thirds(M.bars(spark, sf, "event_type", 3600))
    warm = settle(LV.warm_state(parts[0].unionByName(parts[1]), _live))
    found = LV.replay(spark, [parts[2], LV.closing(parts[2])], lambda s: LV.stream_structure(s, _live, warm)).where("not late")
    return found.select("symbol", "time", "range_scale", "swing", "swing_price", "swing_time", "hunting",
                        F.round("retrace", 6).alias("retrace"), "trigger", "bos", "bos_level", "bos_time")


@query
def stream_prevailing_quote(spark, sf):
    _stateful(spark)
    quotes, trades = _quotes_and_trades(spark, sf)
    none = F.lit(None).cast("double")
    merged = settle(
        quotes.select("symbol", "ts", secs("ts").alias("time"), F.lit(0).alias("kind"), "seq", none.alias("price"), "bid", "ask")
        .unionByName(trades.select("symbol", "ts", secs("ts").alias("time"), F.lit(1).alias("kind"), "seq", "price",
                                   none.alias("bid"), none.alias("ask"))))
    return LV.replay(spark, _shuffled(merged), LV.stream_prevailing).where("not late").drop("kind", "late")


def _row_out(rows: DataFrame) -> DataFrame:
    """Every field of the 76-field row; lists by their length and sum."""
    lists = ("ribbon", "ribbon_prev", "ma", "ma_prev", "profile_bins", "profile_closed", "session_bins", "session_hvn",
             "session_lvn")
    total = lambda c: F.round(F.aggregate(F.coalesce(c, F.array().cast("array<double>")), F.lit(0.0),
                                          lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4)
    volume = lambda c: F.aggregate(F.col(f"{c}.volume"), F.lit(0).cast("long"), lambda a, x: a + x)
    kinds = dict(rows.dtypes)
    scalars = [c for c in SN.fields() if c not in lists]
    return rows.select(
        "symbol", _time(), "close", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in scalars],
        *[total(F.col(c)).alias(f"{c}_sum") for c in ("ribbon", "ribbon_prev")],
        *[F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{p}") for c in ("ma", "ma_prev") for i, p in enumerate(config.NAMED_AVERAGES)],
        volume("profile_bins").alias("profile_bins_volume"), volume("session_bins").alias("session_bins_volume"),
        F.size("profile_closed").cast("long").alias("n_closed"),
        F.size("session_hvn").cast("long").alias("n_hvn"), F.size("session_lvn").cast("long").alias("n_lvn"))


def _dials():
    return SN.Dials(M.TEST_WINDOW, M.TEST_WINDOW, H.FULL, M.SEALED_FROM)


@query
def snapshot(spark, sf):
    return _row_out(SN.snapshot(M.bars(spark, sf), M.STEP, levels=M.levels(spark, sf), dials=_dials()))


@query
def stream_snapshot_replay(spark, sf):
    """The whole row from a stream: three parts, each in scrambled order, the stream started anew for each."""
    _stateful(spark)
    card = settle(_card(spark, sf))
    table = settle(H.percentile_table(card, population=H.FULL, cutoff=_cutoff()))
    finals = settle(H.final_travel(card, population=H.FULL, cutoff=_cutoff()))
    given = settle(RW.with_levels(M.bars(spark, sf), M.levels(spark, sf)))
    rows = LV.replay(spark, _shuffled(given), lambda s: RW.stream_rows(s, dials=_dials(), table=table, finals=finals))
    return _row_out(rows.where("not late"))


# ---- audits and studies -----------------------------------------------------

@query
def bar_audit(spark, sf):
    """Bars with some spoiled on purpose, so that every check has something to find."""
    base = M.bars(spark, sf, "event_type", 3600)
    n = F.pmod(F.floor(secs("ts") / 3600), F.lit(50))
    spoiled = (base.withColumn("high", F.when(n == 1, F.col("low") - 1).otherwise(F.col("high")))
               .withColumn("close", F.when(n == 2, F.lit(float("nan"))).otherwise(F.col("close")))
               .withColumn("volume", F.when(n == 3, 0).when(n == 4, -1).otherwise(F.col("volume")).cast("long"))
               .withColumn("low", F.when(n == 5, -1.0).otherwise(F.col("low"))))
    return RE.audit(spoiled.unionByName(spoiled.where(n == 6)))


@query
def gap_lengths(spark, sf):
    return RE.gap_lengths(M.bars(spark, sf, "event_type", 3600), 3600)


@query
def source_reconciliation(spark, sf):
    """Bars from all trades against bars from a feed that lost every 50th."""
    rows = M.ticks(spark, sf)
    found = RE.reconcile(B.fold_ticks(rows, 3600),
                         B.fold_ticks(rows.where(F.pmod("seq", F.lit(50)) != 7), 3600))
    return found.select("symbol", "shared", "only_left", "only_right", "volume_difference", *_rounded(
        "match_open", "match_high", "match_low", "match_close", "match_volume", "match_all"))


@query
def first_touch(spark, sf):
    rows = _scaled(M.bars(spark, sf, "event_type", 3600), 3600)
    return RE.first_touch(rows, 2.0).select("symbol", F.col("at").alias("time"), "label", "touched")


def _moves(spark, sf, horizons=(1, 4, 12)) -> DataFrame:
    rows = X.absorption(_scaled(M.bars(spark, sf, "event_type", 3600), 3600))
    rows = rows.withColumn("state", F.coalesce("absorption_side", F.lit("none")))
    return settle(RE.forward_moves(rows, horizons, ["state"]))


@query
def forward_returns(spark, sf):
    era = F.when(F.col("ts") < F.lit(M.SEALED_FROM).cast("timestamp"), "early").otherwise("late")
    found = RE.by_state(_moves(spark, sf).withColumn("era", era), ["symbol", "state", "horizon", "era"])
    return found.select("symbol", "state", F.col("horizon").cast("long").alias("horizon"), "era", "n",
                        *_rounded("mean", "median", "hit", "t"))


@query
def signal_episodes(spark, sf):
    one = _moves(spark, sf, (4,))
    found = settle(RE.episodes(one, "state"))
    return RE.concentration(found, "state").select("symbol", "state", "episodes", *_rounded("total", "top_share"))


@query
def window_length_study(spark, sf):
    rows = settle(_sessions(M.bars(spark, sf)))
    return RE.window_study(rows, (2, 3, 4)).withColumn("n", F.col("n").cast("long"))


CARD_FEATURES = ("session_range", "session_net", "session_closed_ratio")


@query
def similar_sessions(spark, sf):
    found = RE.similar_sessions(settle(_card(spark, sf)), CARD_FEATURES, 3)
    return found.select("symbol", "session", "session_bar", "session_id", "place",
                        F.round("distance", 6).alias("distance"))


@query
def session_distributions(spark, sf):
    found = RE.distributions(_card(spark, sf), "session_range", "session_volume")
    return found.select("symbol", "session", "session_bar", "n", *_rounded("mean", "p25", "p50", "p75", "corr"))


@query
def feature_scan(spark, sf):
    rows = _regime(spark, sf)
    moves = RE.forward_moves(rows, (4,), ["ribbon_align", "ribbon_agree", "ribbon_width"])
    found = RE.feature_scan(moves, ["ribbon_align", "ribbon_agree", "ribbon_width"],
                            F.lit(M.SEALED_FROM).cast("timestamp"))
    return found.select("symbol", "feature", "part", "n", *_rounded("corr_move", "corr_size"))


@query
def seasonality(spark, sf):
    return RE.seasonality(M.bars(spark, sf)).select(
        "symbol", "hour", "bars", *_rounded("mean_range", "mean_volume", "mean_change"))


@query
def overnight_returns(spark, sf):
    return RE.overnight(settle(S.instances(_sessions(M.bars(spark, sf)))), "NY")


@query
def sign_flip_null(spark, sf):
    found = RE.sign_flipped(_moves(spark, sf, (4,)), 10)
    return found.select("symbol", F.col("seed").cast("long").alias("seed"), "n", *_rounded("mean"))


@query
def shuffled_null(spark, sf):
    found = RE.shuffled(_moves(spark, sf, (4,)), "state", 3)
    return found.select("symbol", "state", F.col("seed").cast("long").alias("seed"), "n", *_rounded("mean"))


@query
def autocorrelation(spark, sf):
    rows = settle(number_rows(M.bars(spark, sf, "event_type", 3600), ["symbol"]))
    return RE.autocorrelation(rows, range(1, 11)).select(
        "symbol", F.col("lag").cast("long").alias("lag"), "n", *_rounded("acf", "acf_size"))


@query
def tearsheet(spark, sf):
    bars = _tradable(spark, sf)
    trades = O.trade_book(breakout(bars, SG.expand(GRID)), keys=["symbol", "param_id"], **BOOK)
    books = bars.withColumn("param_id", F.explode(F.lit(list(range(len(SG.expand(GRID))))))).withColumn(
        "param_id", F.col("param_id").cast("long"))
    return RE.tearsheet(trades.withColumn("param_id", F.col("param_id").cast("long")), books, M.POINT_VALUE,
                        keys=["symbol", "param_id"]).select(
        "symbol", "param_id", "days", *_rounded("alpha", "beta", "corr", "sharpe"))


@query
def average_crosses(spark, sf):
    rows = settle(X.named_averages(_scaled(M.bars(spark, sf), M.STEP), (20, 50)))
    crossed = RE.average_crosses(rows, F.get("ma", F.lit(0)), F.get("ma", F.lit(1)))
    moves = RE.forward_moves(settle(crossed), (8,), ["cross"])
    both = settle(moves.withColumn("event", F.explode(F.array_compact(F.array(F.lit("drift"), F.col("cross"))))))
    return RE.by_state(both, ["symbol", "event"]).select("symbol", "event", "n", *_rounded("mean", "median", "hit", "t"))


# ---- stores -----------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def tick_file_order(spark, sf):
    """Ticks written in time order, read back with file order as ``seq``, folded to bars."""
    path = _folder(spark, "ticks")
    rows = M.ticks(spark, sf)
    (rows.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
     .select("symbol", *SB.TICK_COLUMNS).write.parquet(path))
    return _bars_out(B.fold_ticks(SB.read_ticks(spark, path), 3600))


@query
def bar_store(spark, sf):
    """Bars written by symbol and timeframe; one series read back by partition pruning."""
    root = _folder(spark, "bars")
    base = M.bars(spark, sf, "event_type", 3600)
    SB.write_bars(base.withColumn("timeframe", F.lit("60m")).unionByName(
        B.derive(base, 14400, 3600).withColumn("timeframe", F.lit("4h"))), root)
    return _bars_out(SB.normalise(SB.read_bars(spark, root, "click", "4h")), "timeframe")


@query
def level_store(spark, sf):
    root = _folder(spark, "levels")
    SB.write_levels(M.levels(spark, sf, "event_type", 3600), root)
    return SB.read_levels(spark, root, "view").select("symbol", _time(), "tick", "volume", "buy")


@query
def percentile_store(spark, sf):
    """Both populations stored apart; the asked one describes itself."""
    root = _folder(spark, "percentiles")
    rows = settle(_card(spark, sf))
    RS.write_percentiles(H.percentile_table(rows, population=H.FULL, cutoff=_cutoff()).unionByName(
        H.percentile_table(rows, population=H.EXPLORE, cutoff=_cutoff())), root)
    return RS.describe_percentiles(RS.read_percentiles(spark, root, H.EXPLORE)).select(
        "symbol", "session", "population", secs("cutoff").alias("cutoff"), "sessions_used", "depth")


@query
def catalog_store(spark, sf):
    """Explore and sealed rows end in separate folders."""
    root = _folder(spark, "catalog")
    rows = _sessions(M.bars(spark, sf)).where("session_id is not null")
    made = settle(rows.withColumn("split", H.split_label(_cutoff())).select("symbol", "ts", "session_id", "split"))
    RS.write_catalog(made, root, include_sealed=True)
    both = [spark.read.parquet(f"{root}/{p}").withColumn("folder", F.lit(p)) for p in (H.EXPLORE, H.SEALED)]
    return both[0].unionByName(both[1]).groupBy("symbol", "folder", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions"))


@query
def run_outputs(spark, sf):
    """Statistics written as JSON under a run id; infinities come back null."""
    path = _folder(spark, "runs")
    found = Q.summarise(_trades(spark, sf), ["symbol", "param_id"])
    RS.write_results(found, path, "first", "json")
    back = spark.read.json(path)
    return back.select("symbol", F.col("param_id").cast("long").alias("param_id"), "scope", "run_id",
                       "n_trades", F.round("profit_factor", 6).alias("profit_factor"))


@query
def instrument_values(spark, sf):
    """Traded value through the instrument table."""
    base = M.bars(spark, sf, "event_type", 3600)
    named = base.withColumn("symbol", F.when(F.col("symbol").isin("click", "view"), "NQ").otherwise("ES"))
    return SB.with_instrument(named).groupBy("symbol", "tick_size", "tick_value", "point_value").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.col("close") * F.col("point_value")).alias("value"))


@query
def orderflow(spark, sf):
    """Flow columns as recorded, null where a bar carries none."""
    base = M.bars(spark, sf, "event_type", 3600)
    bare = base.where("symbol = 'click'").drop(*FLOW)
    both = SB.normalise(bare).unionByName(SB.normalise(base.where("symbol <> 'click'")))
    return both.select("symbol", _time(), *FLOW)


@query
def feature_columns(spark, sf):
    """Projection to two feature groups; nothing else is computed."""
    rows = SN.snapshot(M.bars(spark, sf), M.STEP, only=["sessions", "absorption"])
    shown = SB.columns_for({g: list(f) for g, f in SN.GROUPS.items()}, only=["sessions", "absorption"],
                           details=SN.DETAILS)
    return rows.select(*shown).withColumn("ts", secs("ts")).withColumnRenamed("ts", "time")
