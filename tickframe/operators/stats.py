"""Performance of trade lists: equity, streaks and the summary metrics per scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe import config
from tickframe.operators.series import Running, running

SCOPES = ("all", "long", "short")
OBJECTIVES = ("net_profit", "profit_factor", "sharpe", "sortino", "expectancy", "win_rate")
SPAN = 90 * 86400


def by_scope(trades: DataFrame) -> DataFrame:
    """Every trade once under ``all`` and once under its direction."""
    return trades.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("direction"))))


def equity_curve(trades: DataFrame, keys: Sequence[str], capital: float = config.STARTING_CAPITAL,
                 order: Sequence[str] = ("exit_time",)) -> DataFrame:
    """Running equity, its peak so far (never under the capital) and the drawdown from it."""
    timed = trades.withColumn("_at", F.timestamp_seconds("exit_time"))
    summed = running(timed, keys, order, {"_sum": Running("sum", F.col("pnl_dollars"))},
                     time="_at", span=SPAN).withColumn("equity", F.col("_sum") + capital)
    peaked = running(summed, keys, order, {"_peak": Running("max", F.col("equity"))},
                     time="_at", span=SPAN)
    return (peaked.withColumn("peak", F.greatest("_peak", F.lit(float(capital))))
            .withColumn("drawdown", F.col("peak") - F.col("equity")).drop("_sum", "_peak", "_at"))


def streaks(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("exit_time",)) -> DataFrame:
    """Longest run of wins and of non-wins (an even trade ends a winning run)."""
    win = (F.col("pnl_dollars") > 0).cast("long")
    timed = trades.withColumn("_at", F.timestamp_seconds("exit_time"))
    # Wins between two non-wins share the count of non-wins so far, and the other way round.
    runs = running(timed, keys, order, {"_losses": Running("sum", 1 - win), "_wins": Running("sum", win)},
                   time="_at", span=SPAN)
    kind = F.when(win == 1, F.col("_losses")).otherwise(F.col("_wins"))
    lengths = runs.groupBy(*keys, win.alias("_win"), kind.alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_win") == 1, F.col("_n"))), F.lit(0)).alias("max_consec_wins"),
        F.coalesce(F.max(F.when(F.col("_win") == 0, F.col("_n"))), F.lit(0)).alias("max_consec_losses"))


def summarise(trades: DataFrame, keys: Sequence[str], *, capital: float = config.STARTING_CAPITAL,
              scopes: Sequence[str] = SCOPES, books: DataFrame | None = None) -> DataFrame:
    """The 30 metrics per book and scope.

    ``books`` lists the keys that must appear even without a trade (default: those with one).
    A profit factor without losses is infinite; writers turn that into null.
    """
    scoped = by_scope(trades).where(F.col("scope").isin(*scopes))
    by = [*keys, "scope"]
    curve = equity_curve(scoped, by, capital)
    pnl = F.col("pnl_dollars")
    won, lost = pnl > 0, pnl < 0
    down = F.least(pnl, F.lit(0.0))

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0.0))

    parts = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), count(won).alias("wins"), count(lost).alias("losses"),
        count(pnl == 0).alias("evens"), total(pnl).alias("net_profit"),
        total(F.when(won, pnl)).alias("gross_profit"), total(F.when(lost, -pnl)).alias("gross_loss"),
        total(F.col("commission")).alias("commission"),
        F.max(F.when(won, pnl)).alias("largest_win"), F.min(F.when(lost, pnl)).alias("largest_loss"),
        F.stddev_samp(pnl).alias("_sd"), F.stddev_samp(down).alias("_dsd"),
        F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("_peak"),
        F.avg("bars").alias("avg_bars"), F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"),
        F.avg("etd").alias("avg_etd"), count(F.col("ambiguous")).alias("ambiguous"),
        count(F.col("same_bar")).alias("same_bar"))
    known = books if books is not None else trades.select(*keys).distinct()
    wanted = known.select(*keys, F.explode(F.array(*[F.lit(s) for s in scopes])).alias("scope"))
    full = (wanted.join(parts, by, "left").join(streaks(scoped, by), by, "left")
            .fillna(0).withColumn("_peak", F.greatest("_peak", F.lit(float(capital)))))
    n = F.col("n_trades")

    def over(top: Column, bottom: Column, scale: float = 1.0) -> Column:
        return F.when(bottom != 0, top / bottom * scale).otherwise(0.0)

    mean = over(F.col("net_profit"), n)
    avg_win = over(F.col("gross_profit"), F.col("wins"))
    avg_loss = over(F.col("gross_loss"), F.col("losses"))
    return full.select(
        *by, "n_trades", "wins", "losses", "evens", over(F.col("wins"), n).alias("win_rate"),
        "net_profit", "gross_profit", "gross_loss", "commission",
        F.when(F.col("gross_loss") != 0, F.col("gross_profit") / F.col("gross_loss"))
         .otherwise(F.lit(float("inf"))).alias("profit_factor"),
        mean.alias("avg_trade"), avg_win.alias("avg_win"), (-avg_loss).alias("avg_loss"),
        over(avg_win, avg_loss).alias("win_loss_ratio"), "largest_win", "largest_loss",
        "max_consec_wins", "max_consec_losses", mean.alias("expectancy"), "max_drawdown",
        over(F.col("max_drawdown"), F.col("_peak"), 100.0).alias("max_drawdown_pct"),
        over(mean, F.col("_sd")).alias("sharpe"), over(mean, F.col("_dsd")).alias("sortino"),
        "avg_bars", "avg_mae", "avg_mfe", "avg_etd", "ambiguous",
        over(F.col("ambiguous"), n, 100.0).alias("ambiguous_pct"), "same_bar")


def score(objective: str, min_trades: int = 0) -> Column:
    """The objective, or minus infinity under the trade floor or when it is not finite."""
    if objective not in OBJECTIVES:
        raise KeyError(f"unknown objective {objective!r}; known: {OBJECTIVES}")
    value = F.col(objective)
    sound = (F.col("n_trades") >= min_trades) & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(sound, value).otherwise(F.lit(float("-inf")))
