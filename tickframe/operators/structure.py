"""Swings, legs and breaks of structure."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.operators.fold import chunked_fold
from tickframe.operators.series import Running, running

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()
FIELDS = [
    ("swing", _S), ("swing_price", _D), ("swing_time", _L),
    ("extreme_high", _D), ("extreme_high_time", _L),
    ("extreme_low", _D), ("extreme_low_time", _L),
    ("hunting", _S), ("retrace", _D), ("trigger", _D),
    ("bos", _S), ("bos_level", _D), ("bos_time", _L),
]
INPUT = ("time", "high", "low", "close", "range_scale")
CHUNK = 100_000      # rows a fold runs over in one task
HUNT = {1: "high", -1: "low"}


class StructureFold:
    """Zig-zag of confirmed turns plus the first closes through them.

    Two rails, each ``(price, time)``, one of which is hunted. A bar either moves the hunted rail
    or, by pulling back far enough, confirms it; the other rail then starts over at that bar. Bars
    without a scale leave the swings untouched.
    Breaks test the standing levels before this bar's own swing joins them.
    """

    def __init__(self, retrace: float = config.RETRACE, wick: bool = False):
        self.retrace, self.wick = retrace, wick
        self.hunted, self.rails = 0, {1: None, -1: None}       # 1 upwards, -1 downwards, 0 not begun
        self.levels = {"high": None, "low": None}

    def save(self) -> str:
        return json.dumps([self.hunted, self.rails[1], self.rails[-1], self.levels["high"], self.levels["low"]])

    def load(self, text: str) -> None:
        self.hunted, top, bottom, high, low = json.loads(text)
        self.rails, self.levels = {1: top, -1: bottom}, {"high": high, "low": low}

    def _turn(self, t, high, low, need):
        """Move the rails by one bar; the confirmed ``(kind, price, time)`` or None.

        One rule serves both directions: measured along the hunt, its rail moves with a further
        extreme, and is confirmed once the bar's other end lies ``need`` behind it.
        """
        bar, way = {1: [high, t], -1: [low, t]}, self.hunted
        if not way:
            self.hunted, self.rails = 1, bar
            return None
        best = self.rails[way]
        if way * (bar[way][0] - best[0]) > 0:
            self.rails[way] = bar[way]
        elif way * (best[0] - bar[-way][0]) >= need:
            self.hunted, self.rails[-way] = -way, bar[-way]
            return HUNT[way], *best
        return None

    def _break(self, high, low, close):
        if close is None or (self.wick and (high is None or low is None)):
            return None, None, None
        over, under = (high, low) if self.wick else (close, close)
        for kind, name, through in (("high", "up", over), ("low", "down", under)):
            level = self.levels[kind]
            if level is not None and (through > level[0] if kind == "high" else through < level[0]):
                self.levels[kind] = None
                return name, *level
        return None, None, None

    def row(self, t, high, low, close, scale) -> tuple:
        """One bar's fields, in the order of ``FIELDS``."""
        turn, rails = None, (None,) * 7
        if scale is not None and scale == scale:
            need = self.retrace * scale
            turn = self._turn(t, high, low, need)
            way = self.hunted
            live = self.rails[way][0]
            rails = (*self.rails[1], *self.rails[-1], HUNT[way], way * (live - close) / scale, live - way * need)
        broke = self._break(high, low, close)
        if turn:
            self.levels[turn[0]] = [turn[1], turn[2]]
        return (*(turn or (None, None, None)), *rails, *broke)

    def feed(self, frame: pd.DataFrame) -> pd.DataFrame:
        out = [self.row(*bar) for bar in zip(*(frame[c].tolist() for c in INPUT))]
        made = pd.DataFrame(out, columns=[n for n, _ in FIELDS], index=frame.index)
        for name, kind in FIELDS:
            if kind is _L:
                made[name] = made[name].astype("Int64")
        return pd.concat([frame, made], axis=1)


def structure(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), retrace: float = config.RETRACE,
              wick: bool = False, chunk: int | None = None) -> DataFrame:
    """Add the swing and break fields. ``bars`` carry ``bar_no`` and ``range_scale``.

    Every series is cut into chunks of ``chunk`` rows that run in parallel, exactly (see
    ``fold.chunked_fold``).
    """
    needed = bars.select(*keys, "bar_no", "ts", F.unix_seconds("ts").alias("time"),
                         "high", "low", "close", "range_scale")
    schema = T.StructType([
        *[needed.schema[k] for k in (*keys, "bar_no", "ts")],
        *[T.StructField(n, t) for n, t in FIELDS]])

    def make():
        return StructureFold(retrace, wick)

    done = chunked_fold(needed, keys, "bar_no", make, schema, chunk or CHUNK)
    return bars.join(done.drop("bar_no"), [*keys, "ts"])


def legs(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The segment between the last two confirmed swings, on the bar confirming the later one."""
    turns = bars.where("swing is not null").select(*keys, "ts", "swing_price", "swing_time")
    seen = running(turns, keys, ["ts"], {
        "leg_from_price": Running("prev", F.col("swing_price")),
        "leg_from_time": Running("prev", F.col("swing_time"))})
    return seen.where("leg_from_time is not null").select(
        *keys, "ts",
        F.when(F.col("swing_price") > F.col("leg_from_price"), "up").otherwise("down").alias("leg"),
        "leg_from_price", "leg_from_time",
        F.col("swing_price").alias("leg_to_price"), F.col("swing_time").alias("leg_to_time"))


def structure_events(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Swings (at the bar that made them), breaks and absorption bars as one event table."""
    def event(layer, kind, time, price):
        return F.struct(F.lit(layer).alias("layer"), kind.alias("kind"), time.alias("time"),
                        price.alias("price"))

    time = F.unix_seconds("ts")
    found = F.array(
        event("swing", F.col("swing"), F.col("swing_time"), F.col("swing_price")),
        event("breaks", F.col("bos"), time, F.col("bos_level")),
        event("absorption", F.col("absorption_side"), time, F.col("close")))
    return (bars.select(*keys, time.alias("seen_at"), F.explode(found).alias("e"))
            .select(*keys, "seen_at", "e.*").where("kind is not null"))


def newest_per_layer(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """For every layer keep only what its newest bar emitted."""
    newest = events.groupBy(*keys, "layer").agg(F.max("seen_at").alias("seen_at"))
    return events.join(newest, [*keys, "layer", "seen_at"])


def newest_per_id(events: DataFrame, ident: Sequence[str], at: str = "seen_at") -> DataFrame:
    """For every id keep its newest row."""
    rest = [c for c in events.columns if c not in ident]
    kept = events.groupBy(*ident).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("r"))
    return kept.select(*ident, "r.*")
