"""Volume profiles: histograms over ranges, bins, value areas, shelves and gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.functions.columns import value_area
from tickframe.operators.fold import ordered_fold
from tickframe.operators.series import Running, running, secs, settle


def histogram(levels: DataFrame, ranges: DataFrame, unit: int = 1) -> DataFrame:
    """Volume per tick inside ``(start, end]`` for every row of ``ranges``
    (symbol, range_id, start, end in seconds).

    An index over time: cells of ``unit`` seconds, blocks of two cells, of four, and so on. The whole cells of a
    range are covered by at most two blocks of each size, so however long it is it meets a logarithm of
    them; at its two ends bars of cells it cuts are read singly. Blocks nobody asks for are not folded. All
    joins are equi-joins on (symbol, size, block). ``unit`` is best the bars' step; it never changes results.
    Empty ranges (``end <= start``) and those without levels give no rows; repeated ranges are summed as one range_id.
    """
    asked = ranges.where("end > start").select("symbol", "range_id", "start", "end")
    asked = settle(asked.withColumns({"_l": F.ceil(F.col("start") / unit), "_r": F.floor(F.col("end") / unit)}))
    widest = asked.agg(F.max(F.col("_r") - F.col("_l"))).first()[0] or 0
    sizes = list(range(max(1, int(widest)).bit_length()))
    size, power = F.col("_k"), F.expr("shiftleft(1L, _k)")
    cover = asked.where("_r > _l").withColumn("_k", F.explode(F.lit(sizes))).withColumns(
        {"_a": F.ceil(F.col("_l") / power), "_b": F.floor(F.col("_r") / power)}).where("_a < _b")
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    cover = cover.select("symbol", "range_id", size, F.explode(F.array_compact(F.array(
        F.when(odd(F.col("_a")), F.col("_a")), F.when(odd(F.col("_b")), F.col("_b") - 1)))).alias("_block"))
    marked = levels.select("symbol", secs("ts").alias("at"), F.floor((secs("ts") - 1) / unit).alias("_cell"), "tick", "volume", "buy")
    totals = [F.sum("volume").alias("volume"), F.sum("buy").alias("buy")]
    key = ["symbol", "_k", "_block"]
    blocks = (marked.withColumn("_k", F.explode(F.lit(sizes))).withColumn("_block", F.floor(F.col("_cell") / power))
              .join(cover.select(key).distinct(), key, "left_semi").groupBy(*key, "tick").agg(*totals))
    cols = ["symbol", "range_id", "tick", "volume", "buy"]
    inner = cover.join(blocks, key).select(cols)
    first, last = F.floor(F.col("start") / unit), F.floor((F.col("end") - 1) / unit)
    cut = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("start") % unit != 0, first), F.when(F.col("end") % unit != 0, last))))
    ends = (asked.withColumn("_cell", F.explode(cut)).join(marked, ["symbol", "_cell"])
            .where("at > start and at <= end").select(cols))
    return inner.unionByName(ends).groupBy("symbol", "range_id", "tick").agg(*totals)


def rebin(levels: DataFrame, keys: Sequence[str], bin_size: str = "bin_size",
          tick_size: float = config.TICK_SIZE) -> DataFrame:
    """Fold ticks into bins named by their lower edge; a bin of one tick or less changes nothing."""
    size, price = F.col(bin_size), F.col("tick") * tick_size
    wide = size > tick_size
    at = F.when(wide, F.floor(price / size)).otherwise(F.col("tick"))
    return (levels.withColumn("_at", at).groupBy(*keys, bin_size, "_at")
            .agg(F.sum("volume").alias("volume"), F.sum("buy").alias("buy"))
            .where("volume > 0")
            .withColumn("price", F.col("_at") * F.when(wide, size).otherwise(tick_size))
            .drop("_at"))


def as_bins(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Collect each profile's rows into an ascending ``bins`` array (as long as its price range)."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("price", "volume", "buy"))).alias("bins"))


def summarise(profiles: DataFrame, bins: str = "bins") -> DataFrame:
    """Add poc, val, vah, poc_at and volume of every profile."""
    total = F.aggregate(F.transform(bins, lambda b: b["volume"]), F.lit(0).cast("long"),
                        lambda a, x: a + x)
    return (profiles.withColumn("_area", value_area(F.col(bins)))
            .select("*", "_area.*", total.alias("profile_volume")).drop("_area"))


def shelves_and_gaps(bins: Column, poc: Column) -> tuple[Column, Column]:
    """(high-volume nodes, low-volume nodes): strict local extremes among filled neighbours.

    A shelf holds at least half, a gap at most 15% of the fullest bin; the point of control
    and the two end bins are neither.
    """
    def nodes(w: Column) -> Column:
        levels, n = w["bins"], F.size(w["bins"])

        def sort(b, i):
            left, right = F.get(levels, i - 1)["volume"], F.get(levels, i + 1)["volume"]
            v = b["volume"]
            middle = (i > 0) & (i < n - 1) & (b["price"] != w["poc"])
            return F.struct(
                b["price"].alias("price"),
                F.when(middle & (v > left) & (v > right) & (v >= config.HVN_MIN_SHARE * w["peak"]), 1)
                 .when(middle & (v < left) & (v < right) & (v <= config.LVN_MAX_SHARE * w["peak"]), -1)
                 .otherwise(0).alias("kind"))

        return F.transform(levels, sort)

    # The peak is bound once per profile; named inside the lambda it would be found anew per bin.
    work = F.array(F.struct(bins.alias("bins"), poc.alias("poc"), F.array_max(
        F.transform(bins, lambda b: b["volume"])).alias("peak")))
    kinds = F.get(F.transform(work, nodes), F.lit(0))

    def of(wanted: int) -> Column:
        found = F.filter(kinds, lambda k: k["kind"] == wanted)
        return F.when(poc.isNotNull(), F.transform(found, lambda k: k["price"]))

    return of(1), of(-1)


def readings(profiles: DataFrame, close: str | None = "close") -> DataFrame:
    """What a profile says, in units of the scale: width, position and sign of its value."""
    scale, poc = F.col("range_scale"), F.col("poc")
    low, high = F.get("bins", F.lit(0))["price"], F.get("bins", F.size("bins") - 1)["price"]
    at = F.get("bins", F.col("poc_at"))
    out = {
        "value_width": (F.col("vah") - F.col("val")) / scale,
        "poc_position": F.when(high != low, (poc - low) / (high - low)),
        "delta_at_poc": F.when(at["volume"] > 0, (2 * at["buy"] - at["volume"]) / at["volume"])}
    if close is not None:
        c = F.col(close)
        out |= {
            "poc_distance": (c - poc) / scale,
            "price_vs_value": F.when(c > F.col("vah"), "above").when(c < F.col("val"), "below")
                               .when(poc.isNotNull(), "inside")}
    return profiles.withColumns(out)


# ---- developing profiles ----------------------------------------------------

class HistogramFold:
    """Running histogram of one range. Emits, for published bars, the bins at that bar's scale."""

    OUT = ("from_time", "prices", "bin_volumes", "bin_buys")

    def __init__(self, bins_per_scale: int = config.BINS_PER_SCALE,
                 tick_size: float = config.TICK_SIZE):
        self.bins_per_scale, self.tick_size = bins_per_scale, tick_size
        self.low = 0                                  # tick of the first column
        self.held = np.zeros((2, 0), dtype=np.int64)  # traded and bought volume per tick
        self.first = None

    def _add(self, ticks, volumes, buys):
        """Add one bar's levels (ascending, unique). Room doubles towards the side it lacks."""
        size = self.held.shape[1]
        if not size:
            self.low, size = int(ticks[0]), 64
            self.held = np.zeros((2, size), dtype=np.int64)
        under, over = self.low - int(ticks[0]), int(ticks[-1]) - self.low - size + 1
        if under > 0 or over > 0:
            left = max(under, size) if under > 0 else 0
            right = max(over, size) if over > 0 else 0
            self.held = np.pad(self.held, ((0, 0), (left, right)))
            self.low -= left
        at = ticks - self.low
        self.held[0, at] += volumes
        self.held[1, at] += buys

    def _bins(self, scale):
        at = np.flatnonzero(self.held[0])
        volumes, buys = self.held[:, at]
        price, size = (at + self.low) * self.tick_size, scale / self.bins_per_scale
        if size > self.tick_size:
            edge = np.floor(price / size)
            starts = np.flatnonzero(np.diff(edge, prepend=np.nan) != 0)
            price = edge[starts] * size
            volumes, buys = np.add.reduceat(volumes, starts), np.add.reduceat(buys, starts)
        return price, volumes, buys

    def feed(self, frame: pd.DataFrame) -> pd.DataFrame:
        kept, made = [], []
        rows = zip(*(frame[c].tolist() for c in
                     ("time", "ticks", "volumes", "buys", "range_scale", "publish")))
        for i, (t, ticks, volumes, buys, scale, publish) in enumerate(rows):
            if self.first is None:
                self.first = t
            if ticks is not None and len(ticks):
                self._add(ticks, volumes, buys)
            if publish and self.held[0].any() and scale is not None and scale == scale:
                kept.append(i)
                made.append((self.first, *self._bins(scale)))
        out = frame.iloc[kept].copy()
        for j, name in enumerate(self.OUT):
            out[name] = [m[j] for m in made]
        return out


def nest_levels(levels: DataFrame) -> DataFrame:
    """One row per bar with its levels as parallel arrays (as long as the bar's own range)."""
    packed = levels.groupBy("symbol", "ts").agg(
        F.sort_array(F.collect_list(F.struct("tick", "volume", "buy"))).alias("l"))
    return packed.select("symbol", "ts", F.col("l.tick").alias("ticks"),
                         F.col("l.volume").alias("volumes"), F.col("l.buy").alias("buys"))


def developing(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profile so far on every published bar, one independent histogram per ``keys``.

    ``rows``: keys, ts, range_scale, publish, ticks, volumes, buys. Gives from_time, to_time,
    poc, val, vah, poc_at, profile_volume and bins.
    """
    needed = rows.select(*keys, "ts", secs("ts").alias("time"), "range_scale", "publish",
                         "ticks", "volumes", "buys")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        *[needed.schema[k] for k in keys], T.StructField("ts", T.TimestampType()),
        T.StructField("from_time", T.LongType()), T.StructField("prices", T.ArrayType(T.DoubleType())),
        T.StructField("bin_volumes", longs), T.StructField("bin_buys", longs)])
    done = ordered_fold(needed, keys, ["ts"], HistogramFold, schema)
    zipped = F.arrays_zip(F.col("prices").alias("price"), F.col("bin_volumes").alias("volume"),
                          F.col("bin_buys").alias("buy"))
    return summarise(done.select(*keys, "ts", "from_time", secs("ts").alias("to_time"), zipped.alias("bins")))


def at_bars(rows: DataFrame, keys: Sequence[str], asked: Column, unit: int = 1) -> DataFrame:
    """What ``developing`` gives, for the bars where ``asked`` holds only, and without a fold.

    The profile of an asked bar is the histogram from its range's first bar to it, put together from the blocks of the
    dyadic index (``histogram``): nothing is made for bars nobody asks for, and a long range is not walked.
    Bars that feed two ranges count once in the index. ``unit`` as there.
    """
    held = rows.select(*keys, "ts", "range_scale", "publish", "ticks", "volumes", "buys", asked.alias("_asked"))
    starts = held.groupBy(*keys).agg(secs(F.min("ts")).alias("from_time"))
    want = (held.where("publish and _asked and range_scale is not null").select(*keys, "ts", "range_scale")
            .join(starts, list(keys)))
    one = F.arrays_zip(F.col("ticks").alias("tick"), F.col("volumes").alias("volume"), F.col("buys").alias("buy"))
    levels = (held.select("symbol", "ts", "ticks", "volumes", "buys").dropDuplicates(["symbol", "ts"])
              .select("symbol", "ts", F.explode(one).alias("l")).select("symbol", "ts", "l.*"))
    told = F.struct(*keys[1:], "ts", "range_scale", "from_time")
    found = histogram(levels, want.select("symbol", told.alias("range_id"), (F.col("from_time") - 1).alias("start"),
                                          secs("ts").alias("end")), unit)
    shown = [*keys, "ts", "from_time"]
    folded = found.select("symbol", "range_id.*", "tick", "volume", "buy").withColumn(
        "bin_size", F.col("range_scale") / config.BINS_PER_SCALE)
    return summarise(as_bins(rebin(folded, shown), shown).withColumn("to_time", secs("ts")))


def _turns(bars: DataFrame, nested: DataFrame) -> DataFrame:
    """Bars with levels, and per bar: ``confirmed`` swings so far and ``turned`` ones before it.

    Every bar belongs to range ``turned`` once that range closes; ``turned`` runs ahead of
    ``confirmed`` by at most one, on the bars between an extreme and its confirmation.
    """
    held = bars.join(nested, ["symbol", "ts"], "left").withColumn(
        "_usable", F.col("range_scale").isNotNull() & F.col("ticks").isNotNull())
    held = held.withColumn("_confirms", F.col("_usable") & F.col("swing").isNotNull())
    at = (held.where("_confirms").select("symbol", F.timestamp_seconds("swing_time").alias("ts"))
          .withColumn("_turn", F.lit(1).cast("long")))
    both = held.join(at, ["symbol", "ts"], "left")
    return running(both, ["symbol"], ["ts"], {
        "confirmed": Running("sum", F.col("_confirms").cast("long")),
        "turned": Running("sum", F.coalesce("_turn", F.lit(0)).cast("long"), before=True),
    }).withColumn("turned", F.coalesce("turned", F.lit(0)))


def swing_profiles(bars: DataFrame, nested: DataFrame, asked: Column | None = None, unit: int = 1) -> DataFrame:
    """Profile of the range since the last confirmed swing, on every bar that has one.

    ``bars`` carry swing, swing_time, range_scale and close. When a swing confirms, the bars
    after its extreme open the new range, so those few bars feed two ranges. ``asked``, a condition on ``ts``
    and the symbol: only those bars (see ``at_bars``).
    """
    rows = _turns(bars, nested).where("_usable")
    shared = F.col("turned") > F.col("confirmed")
    feeds = F.when(shared, F.array(
        F.struct(F.col("confirmed").alias("range_no"), F.lit(True).alias("publish")),
        F.struct(F.col("turned").alias("range_no"), F.lit(False).alias("publish")))
    ).otherwise(F.array(F.struct(F.col("confirmed").alias("range_no"), F.lit(True).alias("publish"))))
    fed = rows.select("symbol", "ts", "range_scale", "ticks", "volumes", "buys",
                      F.explode(feeds).alias("f")).select("*", "f.*").drop("f")
    made = developing(fed, ["symbol", "range_no"]) if asked is None else at_bars(fed, ["symbol", "range_no"], asked, unit)
    return readings(made.join(rows.select("symbol", "ts", "close", "range_scale"), ["symbol", "ts"]))


def closed_profiles(bars: DataFrame, nested: DataFrame, levels: DataFrame) -> DataFrame:
    """One frozen profile per confirmed swing, over ``(previous extreme, this extreme]``,
    binned with the scale of the confirming bar."""
    rows = settle(_turns(bars, nested).where("_usable")
                  .select("symbol", "ts", "turned", "confirmed", "_confirms", "range_scale"))
    size = rows.where("_confirms").select(
        "symbol", (F.col("confirmed") - 1).alias("range_no"), secs("ts").alias("confirmed_time"),
        (F.col("range_scale") / config.BINS_PER_SCALE).alias("bin_size"), "range_scale")
    inside = rows.select("symbol", "ts", F.col("turned").alias("range_no"))
    span = inside.groupBy("symbol", "range_no").agg(
        secs(F.min("ts")).alias("from_time"), secs(F.max("ts")).alias("to_time"))
    folded = (levels.join(inside, ["symbol", "ts"]).groupBy("symbol", "range_no", "tick")
              .agg(F.sum("volume").alias("volume"), F.sum("buy").alias("buy"))
              .join(size, ["symbol", "range_no"]))
    keys = ["symbol", "range_no", "confirmed_time", "range_scale"]
    return (summarise(as_bins(rebin(folded, keys), keys))
            .join(span, ["symbol", "range_no"]))


def newest_profiles(closed: DataFrame, keep: int = config.MAX_CLOSED_PROFILES) -> DataFrame:
    """The last few closed profiles of every symbol.

    Each time slice keeps its own newest few first, so a long history is never ranked at once.
    """
    sliced = closed.withColumn("_slice", F.floor(F.col("to_time") / (30 * 86400)))
    near = Window.partitionBy("symbol", "_slice").orderBy(F.desc("to_time"))
    last = Window.partitionBy("symbol").orderBy(F.desc("to_time"))
    few = sliced.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= keep)
    return (few.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= keep)
            .drop("_r", "_slice"))
