"""Results do not depend on blocks, chunks, missing values or the era of a stamp."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import features as X
from tickframe.operators import orders as O
from tickframe.operators import prepare as P
from tickframe.operators import structure as ST
from tickframe.operators.series import number_rows
from tickframe.sources.bars import read_bars

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


def tape(spark, closes, step=60):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(seconds=step * k), c, None if c is None else c + 0.3, None if c is None else c - 0.4, c, 1)
            for k, c in enumerate(closes)]
    return number_rows(spark.createDataFrame(rows, BARS), ["symbol"])


def lines(df, name):
    return {r.ts: (r[name], r[f"{name}_prev"]) for r in df.collect()}


@pytest.mark.parametrize("block", [None, 7, 19])
def test_averages_skip_missing_closes(spark, block):
    closes = [100.0] * 6 + [None] + [100.0] * 4
    got = lines(X.averages(tape(spark, closes), (5,), "ma", block=block), "ma")
    values = [got[t] for t in sorted(got)]
    assert values[6] == (None, None)
    assert [v[0] for k, v in enumerate(values) if k != 6] == [[None]] * 4 + [[100.0]] * 6


def test_averages_in_tenths_are_equal_in_any_block(spark):
    rng = random.Random(7)
    closes = [round(20000 + rng.randrange(-500, 500) / 10, 1) for _ in range(300)] + [20000.1] * 200
    found = [lines(X.ribbon(tape(spark, closes), block=b), "ribbon") for b in (None, 170, 211)]
    assert found[0] == found[1] == found[2]
    last = found[0][max(found[0])]
    assert set(last[0]) == set(last[1]) == {20000.1}


@pytest.mark.parametrize("block", [None, 41])
def test_scale_counts_ranges(spark, block):
    closes = [100.0 + k % 3 for k in range(9)]
    closes[4] = None
    got = X.range_scale(tape(spark, closes), 60, window=300, floor=8, block=block).orderBy("ts").collect()
    assert [r.range_scale is not None for r in got] == [False] * 8 + [True]
    assert got[-1].range_scale == pytest.approx(0.7)


def test_bars_too_close_are_an_error(spark):
    with pytest.raises(Exception, match="closer together"):
        X.range_scale(tape(spark, [1.0, 2.0, 3.0], step=30), 60).collect()


def test_locate_before_the_epoch(spark):
    bars = spark.sql("select 'A' as symbol, timestamp_seconds(t) as ts from values (-7200L), (-3600L), (3600L) as v(t)")
    asked = spark.sql("select 'A' as symbol, t as time from values (-9000L), (-7200L), (-5000L), (0L), (9999L) as v(t)")
    got = {r.time: r.bar_no for r in P.locate(bars, asked).collect()}
    assert got == {-9000: 0, -7200: 0, -5000: 1, 0: 2, 9999: 2}


def test_structure_in_chunks_of_any_size(spark):
    rng, close, closes = random.Random(3), 100.0, []
    for _ in range(400):
        close += rng.choice((-0.5, 0.25, 0.5, -0.25))
        closes.append(close)
    bars = tape(spark, closes).withColumn("range_scale", F.when(F.col("bar_no") >= 5, 0.5)).cache()
    found = [sorted(map(str, ST.structure(bars, chunk=n).collect())) for n in (37, 100, 100_000)]
    assert found[0] == found[1] == found[2] and sum("swing='" in r for r in found[0]) > 10


def test_dollars_follow_the_instrument(spark):
    rows = [(s, k, dt.datetime(2024, 1, 1, 0, k), o, o + 1, o - 1, o, k == 5, "long" if k == 0 else None, 100.0, 90.0, 101.0)
            for s in ("NQ", "ES") for k, o in enumerate([100.0, 100.0, 101.0, 101.0, 101.0, 101.0])]
    signals = spark.createDataFrame(rows, "symbol string, bar_no long, ts timestamp, open double, high double, low double, "
                                          "close double, gap_before boolean, direction string, entry_stop double, "
                                          "stop_price double, target_price double")
    got = {r.symbol: (r.pnl_dollars + r.commission) / r.pnl_points for r in O.trade_book(signals, point_value=None).collect()}
    assert got == {"NQ": pytest.approx(20.0), "ES": pytest.approx(50.0)}


def test_missing_dataset_is_an_error(spark, tmp_path):
    bars = spark.sql("select 'A' as symbol, '5m' as timeframe, timestamp_seconds(0) as ts, 1.0D as close")
    bars.write.partitionBy("symbol", "timeframe").parquet(str(tmp_path / "b"))
    assert read_bars(spark, str(tmp_path / "b"), "A", "5m").count() == 1
    with pytest.raises(LookupError):
        read_bars(spark, str(tmp_path / "b"), "B", "5m")
    with pytest.raises(ValueError):
        read_bars(spark, str(tmp_path / "b"), "A", "7x")
