"""Trades to bars on hand-built rows."""

from pyspark.sql import functions as F

from tickframe.operators import bars as B
from tickframe.operators import prepare as P
from tickframe.sources import bars as SB

BASE = 1717421400          # 2024-06-03 13:30:00 UTC
TICK = "symbol string, off double, seq long, price double, bid double, ask double, volume long, adj double"


def ticks(spark, rows, adj=0.0):
    full = [("X", float(r[0]), i, *map(float, r[1:4]), r[4], float(r[5]) if len(r) > 5 else adj)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, TICK).withColumn(
        "ts", F.timestamp_micros(F.lit(BASE * 1_000_000) + (F.col("off") * 1_000_000).cast("long"))).drop("off")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_aggressor_asks_the_ask_first(spark):
    df = spark.createDataFrame([(10.0, 10.0, 10.0), (9.0, 9.0, 10.0), (9.5, 9.0, 10.0), (11.0, 9.0, 10.0)],
                               "price double, bid double, ask double")
    assert [r[0] for r in df.select(B.aggressor()).collect()] == [1, -1, 0, 1]


def test_equal_stamps_follow_file_order(spark):
    t = ticks(spark, [(1, 100.0, 99.75, 100.0, 1), (1, 101.0, 100.75, 101.0, 1), (1, 100.5, 100.25, 100.5, 1)])
    bar = one(B.fold_ticks(t.repartition(5), 15))
    assert (bar.open, bar.high, bar.low, bar.close) == (100.0, 101.0, 100.0, 100.5)


def test_bar_is_open_left_closed_right(spark):
    t = ticks(spark, [(0, 1.0, 0.0, 1.0, 1), (0.000001, 2.0, 1.0, 2.0, 1), (15, 3.0, 2.0, 3.0, 1)])
    got = {int(r.ts.timestamp()) - BASE: r.volume for r in B.fold_ticks(t, 15).collect()}
    assert got == {0: 1, 15: 2}


def test_between_quotes_counts_in_volume_only(spark):
    t = ticks(spark, [(1, 100.1, 100.0, 100.25, 5), (2, 100.25, 100.0, 100.25, 3), (3, 100.0, 100.0, 100.25, 2)])
    bar = one(B.fold_ticks(t, 15))
    assert (bar.volume, bar.buy_volume, bar.sell_volume, bar.delta, bar.trades) == (10, 3, 2, 1, 3)


def test_roll_jump_disappears(spark):
    t = ticks(spark, [(1, 100.0, 99.75, 100.0, 1, 0.0), (2, 300.0, 299.75, 300.0, 1, 200.0)])
    bar = one(B.fold_ticks(t, 15))
    assert (bar.open, bar.close, bar.high) == (300.0, 300.0, 300.0)
    assert {r.price for r in B.back_adjust(t).collect()} == {300.0}


def test_no_bars_without_trades(spark):
    t = ticks(spark, [(1, 1.0, 0.0, 1.0, 1), (3600, 1.0, 0.0, 1.0, 1)])
    base = B.fold_ticks(t, 15)
    assert base.count() == 2 and B.derive(base, 300, 15).count() == 2


def test_fold_does_not_depend_on_partitions(spark):
    t = ticks(spark, [(i % 90, 100 + (i * 7 % 13) / 4, 100.0, 101.0, 1 + i % 5) for i in range(500)])
    a = sorted(B.fold_ticks(t.coalesce(1), 30).collect())
    assert a == sorted(B.fold_ticks(t.repartition(13), 30).collect())


def bar_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, "
                                 "volume long, delta long, buy_volume long, sell_volume long, trades long").withColumn(
        "ts", F.timestamp_seconds("t")).drop("t")


def test_missing_flow_nulls_the_rung(spark):
    rows = [("X", 60 * i, 1.0, 2.0, 0.5, 1.5, 10, None if i == 2 else 1, 5, 4, 3) for i in (1, 2, 3, 4)]
    got = {int(r.ts.timestamp()): r for r in B.ladder(bar_rows(spark, rows), ["3m"], 60).collect()}
    assert list(got) == [180]           # the bucket up to 360 is still open
    assert got[180].delta is None and got[180].buy_volume == 15 and got[180].volume == 30


def test_ladder_keeps_a_bucket_closed_by_a_gap(spark):
    rows = [("X", t, 1.0, 2.0, 0.5, 1.5, 10, 1, 1, 1, 1) for t in (60, 120, 600, 720)]
    got = sorted(int(r.ts.timestamp()) for r in B.ladder(bar_rows(spark, rows), ["3m"], 60).collect())
    assert got == [180, 720]


def test_not_a_multiple_is_an_error(spark):
    try:
        B.derive(bar_rows(spark, [("X", 60, 1.0, 1.0, 1.0, 1.0, 1, 1, 1, 0, 1)]), 100, 60)
    except ValueError:
        return
    raise AssertionError("100s bars from 60s bars")


def test_level_totals_are_checked(spark):
    t = ticks(spark, [(1, 100.0, 99.75, 100.0, 4), (2, 99.75, 99.75, 100.0, 3), (20, 101.0, 100.75, 101.0, 2)])
    bars, levels = B.fold_ticks(t, 15), B.price_levels(B.back_adjust(t), 15)
    assert sorted((r.tick, r.volume, r.buy) for r in levels.collect()) == [(399, 3, 0), (400, 4, 4), (404, 2, 2)]
    assert one(B.check_levels(bars, levels)).mismatched == 0
    assert one(B.check_levels(bars, levels.where("tick <> 399"))).mismatched == 1


def test_gaps_come_before_the_zero_volume_drop(spark):
    rows = [("X", t, 1.0, 1.0, 1.0, 1.0, v, 0, 0, 0, 1) for t, v in ((60, 1), (120, 0), (180, 1), (600, 1))]
    got = {int(r.ts.timestamp()): r.gap_before for r in P.prepare(bar_rows(spark, rows), 60, skip_empty=True).collect()}
    assert got == {60: False, 180: False, 600: True}


def test_slice_and_locate_clamp(spark):
    rows = [("X", 1_000_000 + 300 * i, 1.0, 1.0, 1.0, float(i), 1, 0, 0, 0, 1) for i in range(10)]
    b = bar_rows(spark, rows)
    assert sorted(r.bar_no for r in P.slice_rows(b, 7, 50).collect()) == [7, 8, 9]
    assert P.slice_rows(b, 99, 5).count() == 0
    asks = spark.createDataFrame([("X", t) for t in (0, 1_000_000, 1_000_001, 1_000_300, 9_999_999)],
                                 "symbol string, time long")
    got = {r.time: r.bar_no for r in P.locate(b, asks).collect()}
    assert got == {0: 0, 1_000_000: 0, 1_000_001: 1, 1_000_300: 1, 9_999_999: 9}


def test_normalise_and_instruments(spark):
    raw = spark.createDataFrame([("NQ", "2024-01-02 03:04:05", 1.0, 2.0, 0.5, float("nan"), 3)],
                                "Symbol string, TS string, Open double, HIGH double, low double, Close double, Volume long")
    bar = one(SB.normalise(raw))
    assert bar.close is None and bar.delta is None and bar.volume == 3
    assert one(SB.with_instrument(SB.normalise(raw))).point_value == 20.0
    odd = SB.normalise(raw).withColumn("symbol", F.lit("ZZ"))
    try:
        SB.with_instrument(odd).collect()
    except Exception as err:
        assert "unknown instrument" in str(err)
    else:
        raise AssertionError("unknown instrument passed")


def test_many_files_need_no_join(spark, tmp_path):
    """Ticks of ten files fold in file order without an exchange of ticks on the file."""
    rows = [("NQ", BASE + k // 4, 100.0 + k % 7 * 0.25, k) for k in range(400)]
    t = (spark.createDataFrame(rows, "symbol string, s long, price double, k long")
         .selectExpr("symbol", "timestamp_seconds(s) as ts", "price", "price - 0.25 as bid", "price as ask", "1L as volume",
                     "0.0D as adj", "k as seq"))
    (t.repartitionByRange(10, "seq").sortWithinPartitions("seq").drop("seq")
     .write.parquet(str(tmp_path / "ticks")))
    from tickframe.sources.bars import read_ticks
    read = read_ticks(spark, str(tmp_path / "ticks"))
    folded = B.fold_ticks(read, 30)
    assert sorted(folded.collect()) == sorted(B.fold_ticks(t, 30).collect())
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1      # the anchors, on bars
