"""Column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe import config


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def aggressor(price="price", bid="bid", ask="ask") -> Column:
    """+1 for a trade at or above the ask, -1 at or below the bid, 0 between; the ask is asked first."""
    p = _col(price)
    return (F.when(p >= _col(ask), 1).when(p <= _col(bid), -1).otherwise(0)).cast("long")


def close_label(ts="ts", step: int | Column = 60) -> Column:
    """Close stamp of the bar holding ``ts``: bars cover ``(label - step, label]``."""
    micros = F.unix_micros(_col(ts))
    width = (F.lit(step) if isinstance(step, int) else step).cast("long") * F.lit(1_000_000)
    return F.timestamp_micros(micros + F.pmod(-micros, width))


def tick_index(price="price", tick_size: float = config.TICK_SIZE) -> Column:
    """Price as a whole number of ticks."""
    return F.rint(_col(price) / tick_size).cast("long")


def exchange_minute(ts="ts") -> Column:
    """Minute of the exchange's local day, seconds floored. Needs a UTC session time zone."""
    local = F.from_utc_timestamp(_col(ts), config.EXCHANGE_ZONE)
    return F.hour(local) * 60 + F.minute(local)


def session_name(ts="ts") -> Column:
    """Session holding a close stamp; null in the halt."""
    minute = exchange_minute(ts)
    out = None
    for name, start, end in config.SESSIONS:
        inside = ((minute > start) & (minute <= end)) if start < end else \
                 ((minute > start) | (minute <= end))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def finite(c: str | Column) -> Column:
    """Null instead of NaN or infinity."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; null where the divisor is null or not positive."""
    return F.when(bottom > 0, top / bottom)


def value_area(levels: Column, coverage: float = config.VALUE_AREA) -> Column:
    """``struct(poc, val, vah, poc_at)`` of an ascending ``array<struct<price,volume,..>>``.

    The point of control is the fullest level (ties: nearest the middle, then the lower). The
    band grows one neighbour at a time, the fuller side first and upwards on a tie, until it
    holds ``coverage`` of the volume. Null when nothing traded.
    """
    n = F.size(levels)
    total = F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["volume"])

    def grow(work: Column) -> Column:
        v, target = work["vols"], work["target"]
        last = F.size(v) - 1

        def step(s: Column, _i: Column) -> Column:
            below = F.coalesce(F.when(s["lo"] > 0, F.get(v, s["lo"] - 1)), F.lit(-1.0))
            above = F.coalesce(F.when(s["hi"] < last, F.get(v, s["hi"] + 1)), F.lit(-1.0))
            up = above >= below
            done = (s["inside"] >= target) | ((s["lo"] <= 0) & (s["hi"] >= last))
            return F.struct(
                F.when(done | up, s["lo"]).otherwise(s["lo"] - 1).alias("lo"),
                F.when(done | ~up, s["hi"]).otherwise(s["hi"] + 1).alias("hi"),
                F.when(done, s["inside"])
                 .otherwise(s["inside"] + F.when(up, above).otherwise(below)).alias("inside"))

        start = F.struct(work["at"].alias("lo"), work["at"].alias("hi"),
                         F.get(v, work["at"]).alias("inside"))
        return F.aggregate(F.sequence(F.lit(1), F.size(v)), start, step)

    def nearest_peak(w: Column) -> Column:
        middle = (F.size(w["vols"]) - 1) / F.lit(2.0)
        return F.array_min(F.transform(w["vols"], lambda x, i: F.struct(
            F.when(x == w["peak"], F.abs(i - middle)).otherwise(F.lit(float("inf"))).alias("far"),
            i.alias("i"))))["i"]

    # One-element arrays bind shared parts once; named inside a lambda they would be computed
    # anew for every level.
    vols = F.transform(levels, lambda x: x["volume"].cast("double"))
    parts = F.transform(F.array(vols), lambda v: F.struct(
        v.alias("vols"), F.array_max(v).alias("peak")))
    work = F.transform(parts, lambda w: F.struct(
        w["vols"].alias("vols"), F.transform(levels, lambda x: x["price"]).alias("prices"),
        nearest_peak(w).alias("at"), (total * coverage).alias("target")))
    found = F.transform(work, lambda w: F.struct(w.alias("w"), grow(w).alias("g")))
    area = F.transform(found, lambda f: F.struct(
        F.get(f["w"]["prices"], f["w"]["at"]).alias("poc"),
        F.get(f["w"]["prices"], f["g"]["lo"]).alias("val"),
        F.get(f["w"]["prices"], f["g"]["hi"]).alias("vah"),
        f["w"]["at"].alias("poc_at")))
    return F.when((n > 0) & (total > 0), F.get(area, F.lit(0)))


def percentile_rank(value: Column, breakpoints: Column, top: int = 100) -> Column:
    """Rank 0..1 of ``value`` among ascending, evenly spaced percentile breakpoints, linear between."""
    n = F.size(breakpoints)
    below = F.size(F.filter(breakpoints, lambda b: b <= value))
    lo, hi = F.get(breakpoints, below - 1), F.get(breakpoints, below)
    width = F.lit(top) / (n - 1)
    inner = ((below - 1) * width + (value - lo) / (hi - lo) * width) / F.lit(100.0)
    return (F.when(value.isNull() | breakpoints.isNull(), None)
            .when(below == 0, 0.0).when(below >= n, top / 100.0).otherwise(inner))
