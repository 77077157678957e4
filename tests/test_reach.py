"""Trees of block extremes and the dyadic index, against looking at everything."""

import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import profile as VP
from tickframe.operators.reach import block_tree, first_reach


def bars(spark, seed, sizes):
    rng, rows = random.Random(seed), []
    for key, n in sizes.items():
        price = 100
        for k in range(n):
            price += rng.randint(-3, 3)
            none = rng.random() < 0.02
            rows.append((key, k, None if none else float(price + rng.randint(0, 4)), None if none else float(price - rng.randint(0, 4)), f"{key}{k}"))
    return rows, spark.createDataFrame(rows, "symbol string, no long, high double, low double, name string")


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_first_reach_equals_looking_at_every_bar(spark, fan):
    rows, df = bars(spark, fan, {"A": 300, "B": 1, "C": 64, "D": 65})
    rng, orders = random.Random(1), []
    for k, (key, no, _, low, _) in enumerate(rows):
        at = 100.0 if low is None else low
        orders.append((k, key, no, rng.choice([None, at + rng.randint(-5, 40)]), rng.choice([None, at - rng.randint(-5, 40)])))
    orders += [(9001, "A", -1, 0.0, None), (9002, "A", 299, 0.0, None), (9003, "Z", 0, 0.0, 1.0), (9004, None, 0, 0.0, 1.0)]
    asked = spark.createDataFrame(orders, "id long, symbol string, _from long, up double, down double")
    got = {r.id: r.reached for r in first_reach(asked, block_tree(df, ["symbol"], "no", ["name"], fan), ["symbol"], fan).collect()}
    assert len(got) == len(orders)
    for k, key, no, up, down in orders:
        want = next((r for r in rows if r[0] == key and r[1] > no and r[2] is not None and (
            (up is not None and r[2] >= up) or (down is not None and r[3] <= down))), None)
        assert (got[k] and (got[k]["_at"], got[k]["high"], got[k]["low"], got[k]["name"])) == (want and want[1:])


def test_without_bars_nothing_is_reached(spark):
    _, df = bars(spark, 1, {"A": 5})
    asked = spark.createDataFrame([(1, "A", 0, 1.0, 1.0)], "id long, symbol string, _from long, up double, down double")
    got = first_reach(asked, block_tree(df.where("no < 0"), ["symbol"], "no"), ["symbol"]).collect()
    assert len(got) == 1 and got[0].reached is None


@pytest.mark.parametrize("unit", [1, 60, 900])
def test_histograms_of_any_range_equal_looking_at_every_bar(spark, unit):
    rng = random.Random(unit)
    levels = [(s, 60 * k, rng.randint(0, 3), rng.randint(1, 9), rng.randint(0, 1)) for s in "AB" for k in range(1, 120) if rng.random() < 0.8]
    ranges = [(s, 100 * k + n, a, a + rng.choice([0, 1, 59, 60, 61, 3000, 7000])) for n, s in enumerate("ABC") for k in range(40)
              for a in [rng.choice([-500, 0, 60 * rng.randint(0, 100), rng.randint(0, 7200)])]]
    lv = spark.createDataFrame(levels, "symbol string, t long, tick long, volume long, buy long").withColumn("ts", F.timestamp_seconds("t"))
    asked = spark.createDataFrame(ranges, "symbol string, range_id long, start long, end long")
    got = {(r.symbol, r.range_id, r.tick): (r.volume, r.buy) for r in VP.histogram(lv, asked, unit).collect()}
    want = {}
    for s, i, a, b in ranges:
        for t, at, tick, v, y in levels:
            if t == s and a < at <= b:
                x = want.get((s, i, tick), (0, 0))
                want[s, i, tick] = (x[0] + v, x[1] + y)
    assert got == want
    assert VP.histogram(lv, asked.where("range_id < 0"), unit).count() == 0


def test_asked_bars_have_the_profiles_of_all_bars(spark):
    """Profiles put together from the index equal those a fold keeps, for ranges that share bars too."""
    import datetime as dt
    rng = random.Random(3)
    rows = []
    for key in range(3):
        for k in range(40):
            ticks = sorted(rng.sample(range(400, 440), rng.randint(1, 6)))
            at = dt.datetime(2024, 1, 1 + key, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=k)
            rows.append(("X", key, at, None if k == 7 else 1.0 + k % 5, True, None if k == 9 else ticks,
                         None if k == 9 else [rng.randint(1, 9) for _ in ticks], None if k == 9 else [0 for _ in ticks]))
    df = spark.createDataFrame(rows, "symbol string, session_id long, ts timestamp, range_scale double, publish boolean, ticks array<long>, "
                                     "volumes array<long>, buys array<long>")
    asked = F.minute("ts") % 3 == 0
    cols = ["session_id", "ts", "from_time", "to_time", "poc", "val", "vah", "profile_volume", "bins"]
    every = VP.developing(df, ["symbol", "session_id"]).where(asked).select(cols).collect()
    some = VP.at_bars(df, ["symbol", "session_id"], asked, 60).select(cols).collect()
    assert sorted(map(str, every)) == sorted(map(str, some)) and len(some) == 3 * 14
