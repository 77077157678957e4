"""Data audits and signal studies over bars and feature rows. All of it is joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.columns import exchange_minute
from tickframe.operators.reach import block_tree, first_reach
from tickframe.operators.series import Running, number_rows, running, secs, settle
from tickframe.schemas import OHLC


# ---- quality ----------------------------------------------------------------

def audit(bars: DataFrame) -> DataFrame:
    """Rows, span, duplicate stamps and impossible values per symbol."""
    def count(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    nan = F.lit(False)
    low_price = F.lit(False)
    for c in OHLC:
        nan = nan | F.col(c).isNull() | F.isnan(c)
        low_price = low_price | (F.col(c) <= 0)
    bad = ((F.col("high") < F.greatest("open", "close", "low"))
           | (F.col("low") > F.least("open", "close", "high")))
    # Stamps are folded first, so duplicates need no distinct count.
    per_stamp = bars.groupBy("symbol", "ts").agg(
        F.count(F.lit(1)).alias("n"), count(nan).alias("nans"), count(bad).alias("ohlc_bad"),
        count(low_price).alias("non_positive"), count(F.col("volume") < 0).alias("negative_volume"),
        count(F.col("volume") == 0).alias("zero_volume"))
    sums = ("nans", "ohlc_bad", "non_positive", "negative_volume", "zero_volume")
    return per_stamp.groupBy("symbol").agg(
        F.sum("n").alias("rows"), secs(F.min("ts")).alias("first_time"), secs(F.max("ts")).alias("last_time"),
        F.sum(F.col("n") - 1).alias("duplicates"), *[F.sum(c).alias(c) for c in sums])


def gap_lengths(bars: DataFrame, step: int) -> DataFrame:
    """How often each gap length above one step occurs."""
    seen = running(bars, ["symbol"], ["ts"], {"_was": Running("prev", secs("ts"))})
    return (seen.withColumn("gap_seconds", secs("ts") - F.col("_was"))
            .where(F.col("gap_seconds") > step)
            .groupBy("symbol", "gap_seconds").agg(F.count(F.lit(1)).alias("times")))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sources of the same bars: overlap, match rate per column, total volume of each."""
    cols = (*OHLC, "volume")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("symbol", "ts", *[F.col(c).alias(f"{tag}_{c}") for c in cols],
                         F.lit(True).alias(tag))

    both = side(left, "a").join(side(right, "b"), ["symbol", "ts"], "full_outer")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()

    def same(c: str) -> Column:
        return (F.col(f"a_{c}") == F.col(f"b_{c}")).cast("long")

    every = F.lit(1)
    for c in cols:
        every = every * same(c)
    return both.groupBy("symbol").agg(
        F.sum(shared.cast("long")).alias("shared"),
        F.sum((F.col("b").isNull()).cast("long")).alias("only_left"),
        F.sum((F.col("a").isNull()).cast("long")).alias("only_right"),
        *[F.avg(F.when(shared, same(c))).alias(f"match_{c}") for c in cols],
        F.avg(F.when(shared, every)).alias("match_all"),
        F.sum(F.when(shared, F.col("a_volume") - F.col("b_volume"))).alias("volume_difference"))


# ---- outcomes ---------------------------------------------------------------

def first_touch(bars: DataFrame, k: float) -> DataFrame:
    """Label every bar with a scale by the barrier ``close +- k x range_scale`` that a later bar touches first.

    ``both`` where one bar touches both, ``none`` where no later bar touches either. Barriers descend a tree of block
    extremes (``reach``), so a symbol is spread over its blocks.
    """
    rows = settle(number_rows(bars.select("symbol", "ts", secs("ts").alias("time"), "high", "low", "close", "range_scale"), ["symbol"]))
    reach = k * F.col("range_scale")
    orders = rows.where("range_scale is not null").select(
        "symbol", F.col("time").alias("at"), F.col("bar_no").alias("_from"),
        (F.col("close") + reach).alias("up"), (F.col("close") - reach).alias("down"))
    met = first_reach(orders, block_tree(rows, ["symbol"], "bar_no", ["time"]), ["symbol"])
    over, under = F.col("reached.high") >= F.col("up"), F.col("reached.low") <= F.col("down")
    label = F.when(over & under, "both").when(over, "up").when(under, "down").otherwise("none")
    return met.select("symbol", "at", label.alias("label"), F.col("reached.time").alias("touched"))


def forward_moves(bars: DataFrame, horizons: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Move over the next ``horizon`` bars in scales. ``bars`` carry bar_no and range_scale."""
    asked = bars.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    later = bars.select("symbol", F.col("bar_no").alias("_no"), F.col("close").alias("_then"))
    return (asked.withColumn("_no", F.col("bar_no") + F.col("horizon")).join(later, ["symbol", "_no"])
            .where("range_scale is not null")
            .select("symbol", "ts", "bar_no", *keep, "horizon",
                    ((F.col("_then") - F.col("close")) / F.col("range_scale")).alias("move")))


def medians(rows: DataFrame, keys: Sequence[str], value: str, width: float = 1 / 64) -> DataFrame:
    """Exact median per key, without gathering a key's values in one task.

    Values are counted per bucket of ``width``; the running counts name the one or two buckets
    that hold the middle ranks, and only their distinct values are put in order.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_b", F.floor(F.col(value) / width))
    order = Window.partitionBy(*keys).orderBy("_b")
    sizes = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_size")).withColumns({
        "_before": F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_size").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = sizes.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(middle, [*keys, "_b"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside))
    return ranked.groupBy(*keys).agg(
        ((F.min(F.when(F.col("_upto") > low, F.col(value)))
          + F.min(F.when(F.col("_upto") > high, F.col(value)))) / 2).alias("median"))


def by_state(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median, hit rate and t of the moves per state."""
    m = F.col("move")
    n, mean, sd = F.count(m), F.avg(m), F.stddev_samp(m)
    return moves.groupBy(*keys).agg(
        n.alias("n"), mean.alias("mean"), F.avg((m > 0).cast("double")).alias("hit"),
        F.when(sd > 0, mean / (sd / F.sqrt(n))).alias("t")).join(medians(moves, keys, "move"), list(keys))


def largest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ident: Sequence[str],
            k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows per key. Salted: each salt keeps its own ``k`` before they meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ident), F.lit(salts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order, *ident)
    last = Window.partitionBy(*keys).orderBy(*order, *ident)
    few = salted.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    return (few.withColumn("place", F.row_number().over(last).cast("long"))
            .where(F.col("place") <= k).drop("_salt"))


def episodes(rows: DataFrame, state: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Contiguous runs of one state, with their length and summed move."""
    seen = running(rows, keys, ["ts"], {"_was": Running("prev", F.col(state))})
    fresh = (~F.col(state).eqNullSafe(F.col("_was"))).cast("long")
    counted = running(seen.withColumn("_new", fresh), keys, ["ts"], {"episode": Running("sum", F.col("_new"))})
    return counted.groupBy(*keys, "episode", state).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("move").alias("total"))


def concentration(found: DataFrame, state: str, keys: Sequence[str] = ("symbol",), k: int = 5) -> DataFrame:
    """Independent episodes per state and the share of the total that the best few bring."""
    by = [*keys, state]
    top = largest(found, by, [F.desc("total")], ["episode"], k).groupBy(*by).agg(F.sum("total").alias("_top"))
    whole = found.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"), F.sum("total").alias("total"))
    return whole.join(top, by).withColumn(
        "top_share", F.when(F.col("total") != 0, F.col("_top") / F.col("total"))).drop("_top")


def window_study(rows: DataFrame, lengths: Sequence[int], keys: Sequence[str] = ("symbol",),
                 band: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """For each window length N, inside sessions: how often recent / prior efficiency leaves the
    band, and how many of those the 4N windows confirm within N bars either way."""
    base = Window.partitionBy(*keys, "session_id").orderBy("ts")

    def efficiency(a: int, b: int) -> Column:
        w = base.rowsBetween(a, b)
        travel = F.sum("_r").over(w)
        return F.when((F.count(F.lit(1)).over(w) == b - a + 1) & (travel > 0),
                      (F.max("high").over(w) - F.min("low").over(w)) / travel)

    def side(n: int) -> Column:
        recent, prior = efficiency(-(n - 1), 0), efficiency(-(2 * n - 1), -n)
        r = F.when(prior > 0, recent / prior)
        return F.when(r > band[1], 1).when(r < band[0], -1).when(r.isNotNull(), 0)

    sized = rows.where("session_id is not null").withColumn("_r", F.col("high") - F.col("low"))
    sized = sized.withColumns({f"_s{m}": side(m) for n in lengths for m in (n, 4 * n)})
    sized = sized.withColumns({f"_w{n}": F.lag(f"_s{n}").over(base) for n in lengths})
    events = {}
    for n in lengths:
        here = F.col(f"_s{n}")
        near = base.rowsBetween(-n, n)
        agrees = F.when(here == 1, F.max(f"_s{4 * n}").over(near) == 1).otherwise(
            F.min(f"_s{4 * n}").over(near) == -1)
        events[f"_e{n}"] = F.when((here != 0) & (F.col(f"_w{n}") == 0), F.coalesce(agrees, F.lit(False)))
    per_n = F.array(*[F.struct(F.lit(int(n)).alias("n"), F.col(f"_e{n}").alias("ok")) for n in lengths])
    return (sized.withColumns(events).select(*keys, F.explode(per_n).alias("e")).select(*keys, "e.*")
            .groupBy(*keys, "n").agg(
                F.count("ok").alias("events"), F.sum(F.coalesce(F.col("ok").cast("long"), F.lit(0))).alias("confirmed")))


def similar_sessions(card: DataFrame, features: Sequence[str], k: int,
                     keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """For each bar of the newest session of a name: the ``k`` past sessions most like it then.

    Features are standardised per elapsed bar; only rows of the same name and elapsed bar meet,
    one query row against one row per past session.
    """
    at = [*keys, "session", "session_bar"]
    whole = card
    for f in features:
        whole = whole.where(F.col(f).isNotNull())
    spread = whole.groupBy(*at).agg(*[
        x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_d_{f}"))])
    z = whole.join(spread, at).select(*at, "session_id", *[
        F.when(F.col(f"_d_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_d_{f}")).otherwise(0.0).alias(f)
        for f in features])
    newest = card.groupBy(*keys, "session").agg(F.max("session_id").alias("_q"))
    marked = z.join(newest, [*keys, "session"])
    asks = marked.where("session_id = _q").select(*at, *[F.col(f).alias(f"_q_{f}") for f in features])
    gap = F.lit(0.0)
    for f in features:
        gap = gap + F.pow(F.col(f) - F.col(f"_q_{f}"), F.lit(2.0))
    pairs = marked.where("session_id <> _q").join(asks, at).select(
        *at, "session_id", F.round(F.sqrt(gap), 9).alias("distance"))
    return largest(pairs, at, [F.asc("distance")], ["session_id"], k)


def distributions(card: DataFrame, field: str, other: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spread of one card field, and its correlation with another, per elapsed bar."""
    q = F.percentile(field, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (card.where(F.col(field).isNotNull()).groupBy(*keys, "session", "session_bar").agg(
        F.count(F.lit(1)).alias("n"), F.avg(field).alias("mean"), q.alias("_q"),
        F.corr(field, other).alias("corr"))
        .select(*keys, "session", "session_bar", "n", "mean", F.get("_q", F.lit(0)).alias("p25"),
                F.get("_q", F.lit(1)).alias("p50"), F.get("_q", F.lit(2)).alias("p75"), "corr"))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts: the same on every engine and partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def feature_scan(moves: DataFrame, features: Sequence[str], cutoff: Column) -> DataFrame:
    """Correlation of each feature, and of a placebo, with the next move and with its size,
    before and after ``cutoff``."""
    placebo = hash_unit(F.lit("placebo"), F.col("symbol"), secs("ts"))
    long = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features],
        F.struct(F.lit("placebo").alias("feature"), placebo.alias("x"))))
    rows = (moves.select("symbol", "move", F.when(F.col("ts") < cutoff, "train").otherwise("test").alias("part"),
                         long.alias("f")).select("symbol", "move", "part", "f.*").where("x is not null"))
    return rows.groupBy("symbol", "feature", "part").agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "move").alias("corr_move"),
        F.corr("x", F.abs("move")).alias("corr_size"))


def seasonality(bars: DataFrame) -> DataFrame:
    """Bar range, volume and return by hour of the exchange's day."""
    seen = running(bars, ["symbol"], ["ts"], {"_was": Running("prev", F.col("close"))})
    hour = F.floor(exchange_minute("ts") / 60)
    return seen.groupBy("symbol", hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("bars"), F.avg(F.col("high") - F.col("low")).alias("mean_range"),
        F.avg("volume").alias("mean_volume"), F.avg(F.col("close") - F.col("_was")).alias("mean_change"))


def overnight(sessions: DataFrame, name: str) -> DataFrame:
    """Per session of one name: the move since the last one's close, and the move within."""
    own = sessions.where(F.col("session") == name).withColumn("ts", F.timestamp_seconds("session_id"))
    seen = running(own, ["symbol"], ["ts"], {"_was": Running("prev", F.col("close"))}, span=365 * 86400)
    return seen.select("symbol", "session_id", (F.col("open") - F.col("_was")).alias("overnight"),
                       (F.col("close") - F.col("open")).alias("intraday"))


def sign_flipped(moves: DataFrame, seeds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean move with every sign drawn anew, once per seed; seed 0 is the real one."""
    seeded = moves.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds))))
    heads = (F.col("seed") == 0) | (hash_unit(F.col("seed"), F.col("symbol"), secs("ts")) < 0.5)
    return seeded.groupBy(*keys, "seed").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(heads, F.col("move")).otherwise(-F.col("move"))).alias("mean"))


def shuffled(moves: DataFrame, state: str, seeds: int) -> DataFrame:
    """Mean move per state when the moves are dealt out to other bars, once per seed.

    Rows are dealt by the rank of a hash. The hash also slices the ranking, so it is spread evenly.
    """
    spread = 2 ** 32
    seeded = moves.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    keys = ["symbol", "seed"]
    held = number_rows(seeded, keys, ["ts"], name="_at")
    drawn = seeded.select(*keys, "ts", "move").withColumn("_h", F.timestamp_seconds(F.floor(
        hash_unit(F.col("seed"), F.col("symbol"), secs("ts")) * spread)))
    dealt = number_rows(drawn, keys, ["_h", "ts"], name="_at", time="_h", span=spread // 64)
    return (held.select(*keys, "_at", state).join(dealt.select(*keys, "_at", "move"), [*keys, "_at"])
            .groupBy("symbol", state, "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("move").alias("mean")))


def autocorrelation(bars: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation of changes and of their sizes. ``bars`` carry bar_no."""
    seen = running(bars, ["symbol"], ["ts"], {"_was": Running("prev", F.col("close"))})
    change = seen.select("symbol", "bar_no", (F.col("close") - F.col("_was")).alias("r")).where("r is not null")
    ahead = change.withColumn("lag", F.explode(F.array(*[F.lit(int(x)) for x in lags])))
    pairs = ahead.withColumn("bar_no", F.col("bar_no") + F.col("lag")).withColumnRenamed("r", "r0").join(
        change, ["symbol", "bar_no"])
    return pairs.groupBy("symbol", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.corr("r0", "r").alias("acf"),
        F.corr(F.abs("r0"), F.abs("r")).alias("acf_size"))


def tearsheet(trades: DataFrame, bars: DataFrame, point_value: float, *,
              keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily profit of each book (``keys``) against holding one contract: alpha, beta, correlation."""
    days = bars.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"))
    held = running(days, keys, ["ts"], {"_was": Running("prev", F.col("close"))}, span=365 * 86400).where(
        "_was is not null").select(*keys, "day", ((F.col("close") - F.col("_was")) * point_value).alias("passive"))
    made = trades.groupBy(*keys, F.to_date(F.timestamp_seconds("exit_time")).alias("day")).agg(
        F.sum("pnl_dollars").alias("pnl"))
    both = held.join(made, [*keys, "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    mean, sd = F.avg("pnl"), F.stddev_samp("pnl")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.regr_intercept("pnl", "passive").alias("alpha"),
        F.regr_slope("pnl", "passive").alias("beta"), F.corr("pnl", "passive").alias("corr"),
        F.when(sd > 0, mean / sd).alias("sharpe"))


def average_crosses(bars: DataFrame, fast: Column, slow: Column) -> DataFrame:
    """``cross`` up or down on the bar where the fast average changes sides, else null."""
    over = F.when(fast > slow, 1).when(fast < slow, -1)
    marked = bars.withColumn("_side", over)
    seen = running(marked, ["symbol"], ["ts"], {"_was": Running("last", F.col("_side"), before=True)})
    return seen.withColumn("cross", F.when(F.col("_side") != F.col("_was"), F.when(
        F.col("_side") == 1, "up").otherwise("down"))).drop("_side", "_was")
