"""Stop-entry brackets against bars: fills, independent outcomes, one-position trade books.

Signals are bars with ``direction`` (long, short or null), ``entry_stop``, ``stop_price`` and
``target_price``. Triggered stops fill as market orders: at the open when the bar gapped through,
with adverse slippage. Targets fill exactly. A bar touching both stop and target takes the stop.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.operators.fold import chunked_fold
from tickframe.operators.reach import block_tree, first_reach
from tickframe.operators.series import Running, number_rows, running, settle
from tickframe.sources.bars import with_instrument

SLIP = config.SLIPPAGE_TICKS * config.TICK_SIZE
CHUNK = 1_000_000


# ---- fills as columns -------------------------------------------------------

def entry_price(direction: Column, entry: Column, open_: Column, high: Column, low: Column,
                slip: float = SLIP) -> Column:
    """Fill price of a resting stop entry on a bar, null when untouched."""
    long = direction == "long"
    return (F.when(long & (high >= entry), F.greatest(open_, entry) + slip)
            .when((direction == "short") & (low <= entry), F.least(open_, entry) - slip))


def exit_fill(direction: Column, stop: Column, target: Column, open_: Column, high: Column,
              low: Column, slip: float = SLIP) -> Column:
    """``struct(price, reason, ambiguous)`` of a protected position on a bar, null when untouched."""
    long = direction == "long"
    at_stop = F.when(long, low <= stop).otherwise(high >= stop)
    at_target = F.when(long, high >= target).otherwise(low <= target)
    stopped = F.when(long, F.least(open_, stop) - slip).otherwise(F.greatest(open_, stop) + slip)
    return (F.when(at_stop, F.struct(stopped.alias("price"), F.lit("stop").alias("reason"),
                                     at_target.alias("ambiguous")))
            .when(at_target, F.struct(target.alias("price"), F.lit("target").alias("reason"),
                                      F.lit(False).alias("ambiguous"))))


# ---- the same rules on scalars, for the folds -------------------------------

def _touch_entry(up, entry, o, h, low, slip):
    if up:
        return max(o, entry) + slip if h >= entry else None
    return min(o, entry) - slip if low <= entry else None


def _touch_exit(up, stop, target, o, h, low, slip):
    stopped = low <= stop if up else h >= stop
    reached = h >= target if up else low <= target
    if stopped:
        return (min(o, stop) - slip if up else max(o, stop) + slip), "stop", reached
    return (target, "target", False) if reached else None


BAR = ("time", "open", "high", "low", "close", "direction", "entry_stop", "stop_price", "target_price")


def _usable(direction, entry):
    return isinstance(direction, str) and entry is not None and entry == entry


def bracket_outcomes(signals: DataFrame, *, keys: Sequence[str] = ("symbol",), series: Sequence[str] | None = None,
                     slip: float = SLIP) -> DataFrame:
    """What became of every signal taken alone, inside its gap-free ``segment``.

    Earliest trigger is the bar after arming; the bar that triggers may also end the trade. A position still open when the
    segment ends is flattened at the last close (``session``); in the newest segment it is still ``open``. Entries
    and exits descend trees of block extremes (``reach``). ``series`` are the keys that tell bars apart, where
    ``keys`` also hold parameters. Signals without a direction or an entry price are none.
    """
    series = list(keys if series is None else series)
    by = [*series, "segment"]
    shown = ["ts", "open", "high", "low", "close"]
    bars = settle(number_rows(signals.select(*by, *shown).dropDuplicates([*by, "ts"]), by, name="_no")
                  .withColumn("time", F.unix_seconds("ts")))
    tree = block_tree(bars, by, "_no", ["open", "close", "time"])
    armed = (signals.where(F.col("direction").isin("long", "short") & F.col("entry_stop").isNotNull() & ~F.isnan("entry_stop"))
             .select(*dict.fromkeys([*keys, *by]), "ts", "direction", "entry_stop", "stop_price", "target_price")
             .join(bars.select(*by, "ts", F.col("_no").alias("_from"), "time"), [*by, "ts"]).drop("ts"))
    long, none = F.col("direction") == "long", F.lit(None).cast("double")
    entry = first_reach(armed.withColumns({"up": F.when(long, F.col("entry_stop")), "down": F.when(~long, F.col("entry_stop"))}), tree, by)
    bar = {c: F.col(f"_bar.{c}") for c in ("open", "high", "low", "close", "time")}
    filled = settle(entry.withColumnRenamed("reached", "_bar").withColumns({
        "entry_price": entry_price(F.col("direction"), F.col("entry_stop"), bar["open"], bar["high"], bar["low"], slip),
        "entry_time": bar["time"],
        "_fill": exit_fill(F.col("direction"), F.col("stop_price"), F.col("target_price"), bar["open"], bar["high"], bar["low"], slip)})
        .drop("up", "down", "_from"))
    inside = filled.where("_bar is not null and _fill is null").withColumn("_from", F.col("_bar._at"))
    out = first_reach(inside.drop("_fill", "_bar").withColumns({
        "up": F.when(long, F.col("target_price")).otherwise(F.col("stop_price")),
        "down": F.when(long, F.col("stop_price")).otherwise(F.col("target_price"))}), tree, by)
    out = out.withColumnRenamed("reached", "_bar").withColumns({
        "_fill": exit_fill(F.col("direction"), F.col("stop_price"), F.col("target_price"), bar["open"], bar["high"], bar["low"], slip),
        "exit_time": bar["time"]}).drop("up", "down", "_from")
    same = filled.where("_bar is null or _fill is not null").withColumn("exit_time", F.when(F.col("_fill").isNotNull(), bar["time"]))
    rows = same.withColumn("same_bar", F.col("_fill").isNotNull()).unionByName(out.withColumn("same_bar", F.lit(False)))
    ends = bars.groupBy(*by).agg(F.max("time").alias("_end"), F.max_by("close", "time").alias("_last"))
    newest = bars.groupBy(*series).agg(F.max("segment").alias("_newest"))
    closed, entered = F.col("_fill").isNotNull(), F.col("entry_time").isNotNull()
    ended = entered & ~closed
    live = ended & (F.col("segment") == F.col("_newest"))
    return (rows.join(ends, by).join(newest, series).select(
        *keys, "segment", "time", "direction", "entry_time", "entry_price",
        F.when(ended & ~live, F.col("_end")).otherwise(F.col("exit_time")).alias("exit_time"),
        F.when(ended & ~live, F.col("_last")).when(closed, F.col("_fill.price")).otherwise(none).alias("exit_price"),
        F.when(live, "open").when(ended, "session").when(closed, F.col("_fill.reason")).otherwise("unfilled").alias("reason"),
        F.coalesce("_fill.ambiguous", F.lit(False)).alias("ambiguous"), "same_bar"))


class BookFold:
    """One position at a time: flat, armed or in a trade.

    Arm on a bar, trigger from the next one on, leave at stop, target or - when a gap follows -
    at the last close before it. A bar that ends flat and unarmed may arm its own signal.
    """

    OUT = ("entry_time", "exit_time", "direction", "entry_price", "exit_price", "pnl_points",
           "reason", "ambiguous", "same_bar", "bars", "mae_points", "mfe_points")

    def __init__(self, slip: float = SLIP, hold: bool = False):
        self.slip, self.hold = slip, hold
        self.order, self.trade, self.last = None, None, None

    def save(self) -> str:
        return json.dumps([self.order, self.trade, self.last])

    def load(self, text: str) -> None:
        self.order, self.trade, self.last = json.loads(text)

    def _excursions(self, h, low, start=False):
        p = self.trade
        good, bad = (h - p["price"], p["price"] - low) if p["up"] else (p["price"] - low, h - p["price"])
        p["mfe"] = good if start else max(p["mfe"], good)
        p["mae"] = bad if start else max(p["mae"], bad)

    def _leave(self, t, n, price, reason, ambiguous, same):
        p, self.trade = self.trade, None
        points = price - p["price"] if p["up"] else p["price"] - price
        return (p["time"], t, "long" if p["up"] else "short", p["price"], price, points, reason,
                bool(ambiguous), same, n - p["n"] + 1, p["mae"], p["mfe"])

    def _try_exit(self, t, n, o, h, low, same):
        p = self.trade
        done = _touch_exit(p["up"], p["stop"], p["target"], o, h, low, self.slip)
        return self._leave(t, n, *done, same) if done else None

    def feed(self, frame: pd.DataFrame) -> pd.DataFrame:
        out, kept = [], []
        rows = zip(frame["bar_no"].tolist(), frame["gap_before"].tolist(),
                   *(frame[x].tolist() for x in BAR))
        for i, (n, gap, t, o, h, low, c, way, entry, stop, target) in enumerate(rows):
            made = None
            if self.trade and gap and not self.hold:
                made = self._leave(self.last[0], n - 1, self.last[1], "session", False, False)
                self.order = None
            elif self.trade:
                self._excursions(h, low)
                made = self._try_exit(t, n, o, h, low, False)
            elif self.order:
                up, at, s, g = self.order
                price = _touch_entry(up, at, o, h, low, self.slip)
                if price is not None:
                    self.trade = {"up": up, "time": t, "price": price, "n": n, "stop": s, "target": g}
                    self.order = None
                    self._excursions(h, low, start=True)
                    made = self._try_exit(t, n, o, h, low, True)
            if not self.trade and not self.order and _usable(way, entry):
                self.order = [way == "long", entry, stop, target]
            if made:
                out.append(made)
                kept.append(i)
            self.last = [t, c]
        keys = frame.drop(columns=[*BAR, "bar_no", "gap_before"], errors="ignore").iloc[kept]
        made = pd.DataFrame(out, columns=list(self.OUT), index=keys.index)
        return pd.concat([keys, made], axis=1)


def trade_book(signals: DataFrame, *, keys: Sequence[str] = ("symbol",), point_value: float | None = 1.0,
               size: int = 1, commission: float = config.COMMISSION_PER_SIDE, slip: float = SLIP,
               hold: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Closed trades of one book per ``keys``, numbered, with dollars and running profit.

    ``signals`` carry ``bar_no`` and ``gap_before``. Books are independent and run in parallel,
    and each is cut into chunks of ``chunk`` bars that do, too (see ``chunked_fold``). With
    ``point_value`` None a point is worth what the instrument table says for the symbol.
    """
    rows = signals.select(*keys, "bar_no", "gap_before", F.unix_seconds("ts").alias("time"), *BAR[1:])
    schema = T.StructType([
        *[rows.schema[k] for k in keys],
        T.StructField("entry_time", T.LongType()), T.StructField("exit_time", T.LongType()),
        T.StructField("direction", T.StringType()), T.StructField("entry_price", T.DoubleType()),
        T.StructField("exit_price", T.DoubleType()), T.StructField("pnl_points", T.DoubleType()),
        T.StructField("reason", T.StringType()), T.StructField("ambiguous", T.BooleanType()),
        T.StructField("same_bar", T.BooleanType()), T.StructField("bars", T.LongType()),
        T.StructField("mae_points", T.DoubleType()), T.StructField("mfe_points", T.DoubleType())])

    def make():
        return BookFold(slip, hold)

    found = chunked_fold(rows, keys, "bar_no", make, schema, chunk)
    if point_value is None:
        found = with_instrument(found)
    worth = (F.col("point_value") if point_value is None else F.lit(float(point_value))) * size
    charge = 2 * commission * size
    priced = found.select(
        *keys, "entry_time", "exit_time", "direction", "entry_price", "exit_price",
        F.lit(size).cast("long").alias("size"), "pnl_points",
        (F.col("pnl_points") * worth - charge).alias("pnl_dollars"),
        F.lit(float(charge)).alias("commission"), "reason", "ambiguous", "same_bar", "bars",
        (F.col("mae_points") * worth).alias("mae"), (F.col("mfe_points") * worth).alias("mfe"),
        (F.greatest(F.col("mfe_points") - F.col("pnl_points"), F.lit(0.0)) * worth).alias("etd"))
    return priced


def sequence_trades(trades: DataFrame, keys: Sequence[str] = ("symbol",),
                    order: Sequence[str] = ("exit_time",)) -> DataFrame:
    """Number trades by exit and add the running profit."""
    timed = trades.withColumn("_at", F.timestamp_seconds("exit_time"))
    return running(timed, keys, list(order), {
        "num": Running("sum", F.lit(1).cast("long")),
        "cum_pnl": Running("sum", F.col("pnl_dollars"))}, time="_at", span=90 * 86400).drop("_at")
