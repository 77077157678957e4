"""The whole feature row of every bar on a stream, equal to the batch snapshot.

One processor per symbol is fed bars in order of time and keeps typed states: the scale's window, the
structure's rails and levels, the averages' ring of running sums, the regime's count, the session's
card with its recent bars, and the histograms of the swing's range and of the session with the frozen profiles. What
is a function of one row alone (session names, absorption, value areas, shelves and gaps, ranks against a
stored history) stays outside as column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.functions.columns import ratio, session_name, value_area
from tickframe.operators import card as K
from tickframe.operators import features as X
from tickframe.operators import profile as VP
from tickframe.operators.structure import FIELDS
from tickframe.plans import snapshot as SN
from tickframe.schemas import FLOW, OHLC
from tickframe.streaming.live import LiveStructure
from tickframe.streaming.ordered import InOrder, in_order, milliseconds

PERIODS = tuple(dict.fromkeys((*config.RIBBON_PERIODS, *config.NAMED_AVERAGES)))
_BINS = "array<struct<price:double,volume:long,buy:long>>"
_OUT = (
    "symbol string, ts timestamp, time long, open double, high double, low double, close double, volume long, delta long, "
    "buy_volume long, sell_volume long, trades long, session string, session_new boolean, range_scale double, "
    + ", ".join(f"{n} {t.simpleString()}" for n, t in FIELDS) + ", "
    "leg string, leg_from_price double, leg_from_time long, leg_to_price double, leg_to_time long, "
    "ribbon array<double>, ribbon_prev array<double>, ma array<double>, ma_prev array<double>, ribbon_align double, "
    "ribbon_agree double, ribbon_width double, regime string, regime_new boolean, "
    f"profile_from_time long, profile_bins {_BINS}, closed array<struct<from_time:long,to_time:long,scale:double,bins:{_BINS}>>, "
    "session_bar long, _high double, _low double, session_range double, session_net double, session_net_ratio double, "
    "session_closed_ratio double, session_high_at_ratio double, session_low_at_ratio double, session_travel double, "
    "session_volume double, session_efficiency_recent double, session_efficiency_prior double, session_range_ratio double, "
    "session_volume_ratio double, session_dir_change_rate double, session_delta_recent long, "
    f"session_from_time long, session_bins {_BINS}, late boolean")


def _over(a, b):
    return a / b if a is not None and b is not None and b > 0 else None


class Averages:
    """Running sums of whole price units, as far back as the longest period; lines are differences of two."""

    def __init__(self):
        self.sums, self.count = [0], 0
        self.before = {"ribbon": None, "ma": None}

    def row(self, close) -> dict:
        if close is None:
            return {}
        self.sums.append(self.sums[-1] + int(np.rint(close / X.UNIT)))
        self.sums = self.sums[-(max(PERIODS) + 1):]
        self.count += 1
        line = {p: (self.sums[-1] - self.sums[-1 - p]) * 1.0 / round(1 / X.UNIT) / p if self.count >= p else None for p in PERIODS}
        now = {"ribbon": [line[p] for p in config.RIBBON_PERIODS], "ma": [line[p] for p in config.NAMED_AVERAGES]}
        out = {**now, **{f"{k}_prev": v for k, v in self.before.items()}}
        self.before = now
        return out


class Regime:
    """Readings of the fan, and the class adopted once it held for a few warm rows."""

    def __init__(self):
        self.name, self.run, self.adopted = None, 0, None

    def row(self, now, was, scale) -> dict:
        if scale is None or now is None or was is None or None in now or None in was:
            return {}
        sign = lambda a, b: (a > b) - (a < b)
        align = sum(map(sign, now, now[1:])) / (len(now) - 1)
        width = (max(now) - min(now)) / scale
        trend = width >= config.REGIME_WIDTH_TREND
        name = ("transition" if width < config.REGIME_WIDTH_PINCH else "up" if trend and align >= config.REGIME_ALIGN
                else "down" if trend and align <= -config.REGIME_ALIGN else "chop")
        self.run = self.run + 1 if name == self.name else 1
        self.name, before = name, self.adopted
        if before is None or self.run >= config.REGIME_CONFIRM:
            self.adopted = name
        return {"ribbon_align": align, "ribbon_agree": sum(map(sign, now, was)) / len(now), "ribbon_width": width,
                "regime": self.adopted, "regime_new": before is not None and self.adopted != before}


class Histogram(VP.HistogramFold):
    """Traded and bought volume per tick, with the first and last bar that fed it."""

    def __init__(self):
        super().__init__()
        self.last = None

    def add(self, time, ticks, volumes, buys) -> None:
        self.first, self.last = time if self.first is None else self.first, time
        if ticks is not None and len(ticks):
            self._add(np.asarray(ticks, np.int64), volumes, buys)

    def levels(self) -> tuple[list, list, list]:
        at = np.flatnonzero(self.held[0])
        return ((at + self.low).tolist(), *self.held[:, at].tolist())

    def join(self, other: Histogram) -> None:
        if other.first is not None:
            self.add(other.first, *other.levels())
            self.last = other.last

    def bins(self, scale) -> list[dict] | None:
        if scale is None or not self.held[0].any():
            return None
        return [{"price": p, "volume": v, "buy": b} for p, v, b in zip(*(x.tolist() for x in self._bins(scale)))]


class SwingProfile:
    """The range since the last confirmed swing. Bars after the running extreme wait beside it: they belong
    to the range that its confirmation would open."""

    def __init__(self):
        self.main, self.after, self.closed = Histogram(), Histogram(), []

    def row(self, time, scale, levels, turned, extreme_time) -> dict:
        """``extreme_time``: of the rail being hunted once this bar has been seen."""
        if scale is None or levels[0] is None:
            return {}
        if turned:
            if (bins := self.main.bins(scale)) is not None:
                frozen = {"from_time": self.main.first, "to_time": self.main.last, "scale": scale, "bins": bins}
                self.closed = [*self.closed, frozen][-config.MAX_CLOSED_PROFILES:]
            self.main, self.after = self.after, Histogram()
        self.after.add(time, *levels)
        if extreme_time >= time:
            self.main.join(self.after)
            self.after = Histogram()
        whole = Histogram()
        whole.join(self.main)
        whole.join(self.after)
        bins = whole.bins(scale)
        return {} if bins is None else {"profile_from_time": whole.first, "profile_bins": bins, "closed": self.closed or None}


class Card:
    """The session's shape so far, its last two windows and its histogram."""

    RECENT = ("time", "high", "low", "volume", "delta", "reversal")

    def __init__(self, window: int):
        self.window = window
        self.recent: list[tuple] = []
        self.bar, self.high, self.low, self.opened, self.travel, self.flow = 0, None, None, None, None, None
        self.way, self.close, self.high_at, self.low_at = 0.0, None, None, None
        self.histogram = Histogram()

    def row(self, b: dict, scale) -> dict:
        high, low, close, n = b["high"], b["low"], b["close"], self.bar + 1
        self.bar, t = n, b["time"]
        self.high = max((x for x in (self.high, high) if x is not None), default=None)
        self.low = min((x for x in (self.low, low) if x is not None), default=None)
        self.opened = b["open"] if n == 1 else self.opened
        spread = None if high is None or low is None else high - low
        self.travel = self.travel if spread is None else (self.travel or 0.0) + spread
        if b["delta"] is not None and b["volume"] is not None:
            self.flow = (self.flow or 0.0) + b["volume"]
        sign = 0.0 if self.close is None or close is None else float(np.sign(close - self.close))
        turned = bool(sign and self.way and sign != self.way)
        self.way, self.close = sign or self.way, close
        self.high_at = n if high is not None and high >= self.high else self.high_at
        self.low_at = n if low is not None and low <= self.low else self.low_at
        minus = lambda x, y: None if x is None or y is None else x - y
        span, net = minus(self.high, self.low), minus(close, self.opened)
        self.recent = [r for r in self.recent if r[0] > t - 2 * self.window] + [(t, high, low, b["volume"], b["delta"], turned)]
        self.histogram.add(t, b["ticks"], b["volumes"], b["buys"])
        near, far = ([r for r in self.recent if (r[0] > t - self.window) == k] for k in (True, False))

        def told(rows):
            if len(rows) < config.RECENT_MIN_BARS:
                return None, None, None
            known = lambda k: [r[k] for r in rows if r[k] is not None]
            s = minus(max(known(1), default=None), min(known(2), default=None))
            return s, sum(r[1] - r[2] for r in rows if None not in r[1:3]), sum(known(3))

        (s, travel, volume), (s0, travel0, volume0) = told(near), told(far)
        flows = [r[4] for r in near if r[4] is not None]
        whole, bins = len(near) >= config.RECENT_MIN_BARS, self.histogram.bins(scale)
        return {
            "session_bar": n, "_high": self.high, "_low": self.low, "session_range": _over(span, scale),
            "session_net": _over(net, scale), "session_net_ratio": _over(net, span), "session_closed_ratio": _over(minus(close, self.low), span),
            "session_high_at_ratio": self.high_at and self.high_at / n, "session_low_at_ratio": self.low_at and self.low_at / n, "session_travel": _over(self.travel, scale),
            "session_volume": self.flow, "session_efficiency_recent": _over(s, travel), "session_efficiency_prior": _over(s0, travel0),
            "session_range_ratio": _over(s, s0), "session_volume_ratio": _over(volume, volume0),
            "session_dir_change_rate": sum(r[5] for r in near) / len(near) if whole else None,
            "session_delta_recent": sum(flows) if whole and len(flows) >= config.RECENT_MIN_BARS else None,
            "session_from_time": None if bins is None else self.histogram.first, "session_bins": bins}


class RowProcessor(InOrder):
    """All states of one symbol; each is written back only with the rows that changed it."""

    def __init__(self, rows: T.StructType, hold: int, dials: SN.Dials):
        super().__init__(rows, T.StructType.fromDDL(_OUT), ["us"], hold)
        self.dials = dials

    def start(self, handle):
        levels = "ticks array<long>, volumes array<long>, buys array<long>, first long, last long"
        self.kept = {
            "spreads": handle.getListState("spreads", "time long, spread double"),
            "structure": handle.getValueState("structure", "hunted int, top double, top_time long, bottom double, bottom_time long, "
                                              "high double, high_time long, low double, low_time long, leg_price double, leg_time long"),
            "averages": handle.getValueState("averages", "sums array<long>, count long, ribbon array<double>, ma array<double>"),
            "regime": handle.getValueState("regime", "name string, run int, adopted string"),
            "session": handle.getValueState("session", "name string"),
            "card": handle.getValueState("card", "bar long, high double, low double, opened double, travel double, flow double, "
                                         "way double, close double, high_at long, low_at long"),
            "recent": handle.getListState("recent", "time long, high double, low double, volume long, delta long, reversal boolean"),
            **{k: handle.getValueState(k, levels) for k in ("main", "after", "of_session")},
            "closed": handle.getListState("closed", "from_time long, to_time long, scale double, prices array<double>, "
                                          "volumes array<long>, buys array<long>")}

    def _get(self, name):
        return self.kept[name].get() if self.kept[name].exists() else None

    def _histogram(self, name) -> Histogram:
        out, held = Histogram(), self._get(name)
        if held is not None and held[3] is not None:
            out.add(held[3], held[0], held[1], held[2])
            out.last = held[4]
        return out

    def load(self):
        self.live = LiveStructure(window=self.dials.scale_window)
        self.live.seen = [list(r) for r in (self._get("spreads") or ())]
        self.leg = None
        if (held := self._get("structure")) is not None:
            pairs = [None if held[k] is None else [held[k], held[k + 1]] for k in (1, 3, 5, 7, 9)]
            fold = self.live.fold
            fold.hunted, fold.rails, fold.levels = held[0], {1: pairs[0], -1: pairs[1]}, {"high": pairs[2], "low": pairs[3]}
            self.leg = pairs[4]
        self.averages, self.regime = Averages(), Regime()
        if (held := self._get("averages")) is not None:
            self.averages.sums, self.averages.count = list(held[0]), held[1]
            self.averages.before = {"ribbon": held[2] and list(held[2]), "ma": held[3] and list(held[3])}
        if (held := self._get("regime")) is not None:
            self.regime.name, self.regime.run, self.regime.adopted = held
        self.session = (self._get("session") or (None,))[0]
        self.card = Card(self.dials.recent_window)
        if (held := self._get("card")) is not None:
            c = self.card
            c.bar, c.high, c.low, c.opened, c.travel, c.flow, c.way, c.close, c.high_at, c.low_at = held
            c.recent = [tuple(r) for r in (self._get("recent") or ())]
            c.histogram = self._histogram("of_session")
        self.profile = SwingProfile()
        self.profile.main, self.profile.after = self._histogram("main"), self._histogram("after")
        self.profile.closed = [
            {"from_time": a, "to_time": b, "scale": s, "bins": [{"price": p, "volume": v, "buy": y} for p, v, y in zip(ps, vs, ys)]}
            for a, b, s, ps, vs, ys in (self._get("closed") or ())]

    def save(self):
        def put(name, rows):
            self.kept[name].put(rows) if rows else self.kept[name].clear()

        fold, c, a = self.live.fold, self.card, self.averages
        put("spreads", [tuple(r) for r in self.live.seen])
        pairs = [p if p is not None else (None, None) for p in (
            fold.rails[1], fold.rails[-1], fold.levels["high"], fold.levels["low"], self.leg)]
        self.kept["structure"].update((fold.hunted, *(x for p in pairs for x in p)))
        self.kept["averages"].update((a.sums, a.count, a.before["ribbon"], a.before["ma"]))
        self.kept["regime"].update((self.regime.name, self.regime.run, self.regime.adopted))
        self.kept["session"].update((self.session,))
        self.kept["card"].update((c.bar, c.high, c.low, c.opened, c.travel, c.flow, c.way, c.close, c.high_at, c.low_at))
        put("recent", c.recent)
        for name, h in (("main", self.profile.main), ("after", self.profile.after), ("of_session", c.histogram)):
            self.kept[name].update((*h.levels(), h.first, h.last))
        put("closed", [(x["from_time"], x["to_time"], x["scale"], *([b[k] for b in x["bins"]] for k in ("price", "volume", "buy")))
                       for x in self.profile.closed])

    def _leg(self, swing, price, time) -> dict:
        if swing is None:
            return {}
        was, self.leg = self.leg, [price, time]
        if was is None:
            return {}
        return {"leg": "up" if price > was[0] else "down", "leg_from_price": was[0], "leg_from_time": was[1],
                "leg_to_price": price, "leg_to_time": time}

    def _bar(self, b: dict) -> dict:
        t, high, low = b["time"], b["high"], b["low"]
        spread = None if high is None or low is None else high - low
        scale = self.live.scale(t, spread)
        told = dict(zip((n for n, _ in FIELDS), self.live.fold.row(t, high, low, b["close"], scale)))
        fresh, self.session = b["session"] != self.session, b["session"]
        out = {**b, "range_scale": scale, "session_new": fresh, **told}
        out |= self._leg(told["swing"], told["swing_price"], told["swing_time"])
        out |= self.averages.row(b["close"])
        out |= self.regime.row(out.get("ribbon"), out.get("ribbon_prev"), scale)
        rail = self.live.fold.rails.get(self.live.fold.hunted)
        out |= self.profile.row(t, scale, (b["ticks"], b["volumes"], b["buys"]), told["swing"] is not None, rail[1] if rail else t)
        if fresh:
            self.card = Card(self.dials.recent_window)
        return out | self.card.row(b, scale) if b["session"] in config.TRACKED_SESSIONS else out

    def feed(self, frame):
        bars = frame.to_dict("records")
        made = [self._bar(b) for b in bars]
        out = pd.DataFrame({n: pd.Series([r.get(n) for r in made], dtype=object) for n in self.out.fieldNames()})
        out["ts"] = pd.to_datetime(frame["us"].astype("int64"), unit="us")
        for f in self.out.fields:
            if isinstance(f.dataType, T.LongType):
                out[f.name] = out[f.name].astype("Int64")
        return out


def with_levels(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Bars with their levels nested, as the stream takes them (batch; levels may be missing)."""
    return bars.join(VP.nest_levels(levels), ["symbol", "ts"], "left")


def _area(bins: Column, prefix: str) -> dict[str, Column]:
    found = value_area(bins)
    return {f"{prefix}{k}": found[k] for k in ("poc", "val", "vah", "poc_at")}


def stream_rows(bars: DataFrame, *, dials: SN.Dials = SN.Dials(), table: DataFrame | None = None, finals: DataFrame | None = None,
                delay: str = "1 minute") -> DataFrame:
    """The snapshot's fields for a stream of bars (with ticks, volumes and buys as arrays), a row a bar.

    ``table`` and ``finals`` are a stored history (``history.percentile_table``, ``final_travel``); without them ranks
    are null. Bars wait until event time is ``delay`` past them and are handed on in order; later ones are
    rows with ``late`` set and change nothing. A bar without high and low has no scale and moves no swing.
    """
    hold = milliseconds(delay)
    given = bars.select("symbol", "ts", F.unix_seconds("ts").alias("time"), *OHLC, "volume", *FLOW, "ticks", "volumes", "buys",
                        session_name("ts").alias("session"))
    rows = in_order(given, lambda kept: RowProcessor(kept, hold, dials)).withColumn("ts", F.coalesce("ts", F.timestamp_seconds("time")))
    rows = X.absorption(rows)
    rows = rows.withColumns({"bins": F.col("profile_bins"), **_area(F.col("profile_bins"), "")})
    rows = rows.withColumns({"profile_poc": F.col("poc"), "profile_val": F.col("val"), "profile_vah": F.col("vah"),
                             "profile_to_time": F.when(F.col("bins").isNotNull(), F.col("time")),
                             "profile_volume": F.aggregate(F.col("bins.volume"), F.lit(0).cast("long"), lambda a, x: a + x)})
    rows = VP.readings(rows).drop("bins", "poc", "val", "vah", "poc_at")

    def frozen(c: Column) -> Column:
        area = value_area(c["bins"])
        return F.struct(area["poc"].alias("poc"), area["val"].alias("val"), area["vah"].alias("vah"), c["from_time"].alias("from_time"),
                        c["to_time"].alias("to_time"),
                        F.aggregate(c["bins"]["volume"], F.lit(0).cast("long"), lambda a, x: a + x).alias("volume"), c["bins"].alias("bins"))

    rows = rows.withColumn("profile_closed", F.transform("closed", frozen))
    area = value_area(F.col("session_bins"))
    hvn, lvn = VP.shelves_and_gaps(F.col("session_bins"), area["poc"])
    rows = rows.withColumns({
        "session_poc": area["poc"], "session_val": area["val"], "session_vah": area["vah"], "session_hvn": hvn, "session_lvn": lvn,
        "session_to_time": F.when(F.col("session_bins").isNotNull(), F.col("time")), "session_bars": F.col("session_bar"),
        "session_poc_ratio": ratio(area["poc"] - F.col("_low"), F.col("_high") - F.col("_low"))})
    if table is not None and finals is not None:
        rows = K.against_history(rows, table, finals)
    units = {f: u for group in SN.GROUPS.values() for f, u in group.items()}
    return rows.select("symbol", "ts", *OHLC, "volume", *[
        (F.col(f) if f in rows.columns else F.lit(None).cast("double")).alias(f, metadata={"unit": units[f]})
        for f in SN.fields()], "late")
