"""Parameter sweeps and walk-forward runs: every fold and combination in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.operators import orders as O
from tickframe.operators import stats as Q
from tickframe.operators.series import number_rows, settle

Strategy = Callable[[DataFrame, list[dict], Sequence[str]], DataFrame]
DAY = 86400


def expand(grid: dict[str, list]) -> list[dict]:
    """Every combination in grid order; an empty grid is one empty combination."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """The combinations as a small table: ``param_id``, ``params``."""
    rows = [(i, {k: float(v) for k, v in c.items()}) for i, c in enumerate(expand(grid))]
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("param_id", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType()))]))


def sweep(bars: DataFrame, strategy: Strategy, grid: dict[str, list], objective: str, *,
          keys: Sequence[str] = ("symbol",), min_trades: int = 0,
          capital: float = config.STARTING_CAPITAL, **book) -> DataFrame:
    """All combinations on the given bars, best first: ``place`` 1, 2, ... per key.

    Equal scores keep grid order, so when nothing qualifies the first combination wins.
    """
    combos = expand(grid)
    by = [*keys, "param_id"]
    trades = settle(O.trade_book(strategy(bars, combos, keys), keys=by, **book))
    books = bars.select(*keys).distinct().withColumn(
        "param_id", F.explode(F.array(*[F.lit(i) for i in range(len(combos))])))
    found = Q.summarise(trades, by, capital=capital, scopes=("all",), books=books)
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "param_id")
    return (found.withColumn("score", Q.score(objective, min_trades))
            .withColumn("place", F.row_number().over(best_first)))


def fold_windows(bars: DataFrame, is_days: int = config.IS_DAYS, oos_days: int = config.OOS_DAYS,
                 step_days: int = config.STEP_DAYS, anchored: bool = False) -> DataFrame:
    """Half-open in-sample and out-of-sample windows per symbol; only whole test windows."""
    span = bars.groupBy("symbol").agg(F.unix_seconds(F.min("ts")).alias("_a"),
                                      F.unix_seconds(F.max("ts")).alias("_b"))
    first = F.col("_a") + is_days * DAY
    last = F.col("_b") - oos_days * DAY
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step_days * DAY).cast("long")))
    oos = F.col("oos_start")
    return (span.select("symbol", "_a", F.posexplode(starts).alias("_n", "oos_start"))
            .select("symbol", (F.col("_n") + 1).alias("fold"),
                    (F.col("_a") if anchored else oos - is_days * DAY).alias("is_start"),
                    oos.alias("is_end"), oos.alias("oos_start"),
                    (oos + oos_days * DAY).alias("oos_end")))


def _inside(bars: DataFrame, folds: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of every window they fall in, numbered within it.

    ``folds`` is one row per symbol and window, so it stays calendar-sized.
    """
    t = F.unix_seconds("ts")
    held = (bars.drop("bar_no").join(folds.select("symbol", "fold", start, end), "symbol")
            .where((t >= F.col(start)) & (t < F.col(end))).drop(start, end))
    return settle(number_rows(held, ["symbol", "fold"]))


def walk_forward(bars: DataFrame, strategy: Strategy, grid: dict[str, list], objective: str, *,
                 is_days: int = config.IS_DAYS, oos_days: int = config.OOS_DAYS,
                 step_days: int = config.STEP_DAYS, anchored: bool = False,
                 min_trades: int = config.MIN_TRADES, capital: float = config.STARTING_CAPITAL,
                 **book) -> tuple[DataFrame, DataFrame]:
    """(fold results, stitched out-of-sample trades).

    Folds and combinations are keys of the same jobs, so none waits for another. ``bars`` carry
    ``range_scale`` and ``gap_before`` from the whole series.
    """
    keys = ["symbol", "fold"]
    by = [*keys, "param_id"]
    folds = settle(fold_windows(bars, is_days, oos_days, step_days, anchored))
    if folds.isEmpty():
        raise ValueError(f"no fold of {is_days} and {oos_days} days fits the bars")
    combos = expand(grid)
    ranked = sweep(_inside(bars, folds, "is_start", "is_end"), strategy, grid, objective, keys=keys,
                   min_trades=min_trades, capital=capital, **book)
    best = settle(ranked.where("place = 1").select(*by, F.col("score").alias("is_score")))
    tests = strategy(_inside(bars, folds, "oos_start", "oos_end"), combos, keys).join(
        best.select(by), by, "left_semi")
    trades = settle(O.trade_book(tests, keys=by, **book))
    tested = Q.summarise(trades, by, capital=capital, scopes=("all",), books=best.select(by))
    results = (folds.join(best, keys)
               .join(tested.withColumn("oos_score", Q.score(objective))
                     .select(*by, "oos_score", F.col("n_trades").alias("n_oos_trades")), by))
    stitched = O.sequence_trades(trades, ["symbol"], ["exit_time", "fold", "entry_time"])
    return results, stitched


def efficiency(results: DataFrame) -> DataFrame:
    """Mean finite test score over mean finite training score; zero where either is missing."""
    def mean(c: str):
        return F.avg(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)))

    a, b = mean("oos_score"), mean("is_score")
    return results.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("folds"),
        F.when(a.isNotNull() & (b != 0), a / b).otherwise(0.0).alias("efficiency"))
