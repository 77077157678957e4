"""Windows and folds against plain sequential models."""

import json
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickframe import config
from tickframe.functions.columns import percentile_rank, value_area
from tickframe.operators import features as X
from tickframe.operators import profile as VP
from tickframe.operators import structure as ST
from tickframe.operators.series import number_rows


def series(symbols=4, n=250, seed=3, step=300):
    rnd = random.Random(seed)
    out = []
    for s in range(symbols):
        t, p = 1_704_067_200, 4000
        for i in range(n):
            t += step if rnd.random() > 0.05 else step * rnd.randint(2, 300)
            o = p
            p += rnd.randint(-6, 6) * (1 if s else 0 if i % 40 < 15 else 1)
            hi, lo = max(o, p) + (rnd.randint(0, 4) if s else 0), min(o, p) - (rnd.randint(0, 4) if s else 0)
            out.append((f"s{s}", t, o / 4, hi / 4, lo / 4, p / 4))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double").withColumn(
        "ts", F.timestamp_seconds("t"))


def model_scale(rows, window, floor):
    got, seen = {}, {}
    for s, t, _, h, low, _ in rows:
        q = seen.setdefault(s, [])
        q.append((t, h - low))
        while len(q) > floor and q[0][0] <= t - window:
            q.pop(0)
        m = float(np.median([x for _, x in q]))
        got[s, t] = m if len(q) >= floor and m > 0 else None
    return got


def test_range_scale_is_the_incremental_median(spark):
    rows = series()
    df = number_rows(frame(spark, rows), ["symbol"])
    for block in (16, None):
        got = {(r.symbol, r.t): r.range_scale for r in X.range_scale(df, 300, window=1800, block=block).collect()}
        assert got == model_scale(rows, 1800, 8)


def test_ribbon_blocks_and_warm_up(spark):
    rows = series(symbols=2)
    df = number_rows(frame(spark, rows), ["symbol"])
    closes = {}
    for s, t, *_, c in rows:
        closes.setdefault(s, []).append((t, c))
    for r in X.ribbon(df, block=170).collect():
        past = [c for t, c in closes[r.symbol] if t <= r.t]
        for p, v in zip(config.RIBBON_PERIODS, r.ribbon):
            assert v is None if len(past) < p else abs(v - sum(past[-p:]) / p) < 1e-9


def model_regime(classes, confirm=3):
    held, cand, n, out = None, None, 0, []
    for c in classes:
        new = False
        if held is None:
            held = cand = c
        elif c == held:
            cand, n = c, 0
        else:
            n = n + 1 if c == cand else 1
            cand = c
            if n >= confirm:
                held, n, new = c, 0, True
        out.append((held, new))
    return out


def test_regime_label_is_the_state_machine(spark):
    rnd = random.Random(5)
    width = {"transition": (1.0, 0.0), "up": (6.0, 0.9), "down": (6.0, -0.9), "chop": (3.0, 0.1)}
    rows, want = [], {}
    for s in range(40):
        classes = [rnd.choice(list(width)[: rnd.randint(2, 4)]) for _ in range(40)]
        for i, (c, w) in enumerate(zip(classes, model_regime(classes))):
            rows.append((f"s{s}", i * 900, *width[c]))
            want[f"s{s}", i * 900] = w
    df = spark.createDataFrame(rows, "symbol string, t long, ribbon_width double, ribbon_align double").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = {(r.symbol, r.t): (r.regime, r.regime_new) for r in X.regime_label(df, block=7).collect()}
    assert got == want


def test_absorption_absent_is_not_false(spark):
    df = spark.createDataFrame([(1.0, 2.0, -3, 5), (2.0, 1.0, 3, 5), (1.0, 1.0, 3, 5), (1.0, 2.0, 0, 5), (1.0, 2.0, None, 5)],
                               "open double, close double, delta long, volume long")
    got = [(r.absorption, r.absorption_side) for r in X.absorption(df).collect()]
    assert got == [(True, "buy"), (True, "sell"), (False, None), (False, None), (None, None)]
    got = [r.absorption for r in X.absorption(df, min_abs_delta=4).collect()]
    assert got == [False, False, False, False, None]


def scaled(spark, rows, block=None):
    return X.range_scale(number_rows(frame(spark, rows), ["symbol"]), 300, window=1800, block=block)


def listed(df, *cols):
    return sorted(map(repr, df.select("symbol", "t", *cols).collect()))


FIELDS = [n for n, _ in ST.FIELDS]


def test_chunked_structure_equals_one_pass(spark):
    df = scaled(spark, series())
    whole = ST.structure(df, retrace=1.5)
    assert listed(ST.structure(df, retrace=1.5, chunk=40), *FIELDS) == listed(whole, *FIELDS)
    assert whole.where("swing is not null").count() > 20 and whole.where("bos is not null").count() > 20


def test_structure_is_causal_and_scale_free(spark):
    rows = series(symbols=2)
    whole = listed(ST.structure(scaled(spark, rows), retrace=1.5).where("t < 1705000000"), *FIELDS)
    part = listed(ST.structure(scaled(spark, [r for r in rows if r[1] < 1705000000]), retrace=1.5), *FIELDS)
    assert whole == part
    tenfold = [(s, t, *(10 * v for v in p)) for s, t, *p in rows]
    a = listed(ST.structure(scaled(spark, rows), retrace=1.5), "swing", "swing_time", "bos", "bos_time", "hunting")
    assert a == listed(ST.structure(scaled(spark, tenfold), retrace=1.5), "swing", "swing_time", "bos", "bos_time", "hunting")


def test_swings_alternate_and_look_back(spark):
    out = ST.structure(scaled(spark, series(symbols=1, seed=8)), retrace=1.5).where("swing is not null").orderBy("t").collect()
    assert all(a.swing != b.swing for a, b in zip(out, out[1:]))
    assert all(r.swing_time < r.t for r in out)


def feed(fold, bars):
    df = pd.DataFrame(bars, columns=["time", "high", "low", "close", "range_scale"])
    return fold.feed(df)


def test_wick_is_no_break_and_a_level_breaks_once():
    fold = ST.StructureFold(retrace=2.0)
    out = feed(fold, [(1, 10.0, 9.0, 9.5, 1.0), (2, 9.5, 7.5, 8.0, 1.0), (3, 10.5, 8.0, 9.9, 1.0), (4, 10.6, 9.0, 10.2, 1.0),
                      (5, 11.0, 10.0, 10.8, 1.0)])
    assert list(out["swing"])[:2] == [None, "high"]
    assert list(out["bos"]) == [None, None, None, "up", None]
    wick = feed(ST.StructureFold(2.0, wick=True), [(1, 10.0, 9.0, 9.5, 1.0), (2, 9.5, 7.5, 8.0, 1.0), (3, 10.5, 8.0, 9.9, 1.0)])
    assert list(wick["bos"]) == [None, None, "up"]


bar = st.tuples(st.integers(0, 40), st.integers(0, 40), st.floats(0, 1), st.sampled_from([None, 0.5, 1.0, 2.0]))


@settings(max_examples=150, deadline=None)
@given(st.lists(bar, min_size=2, max_size=60), st.data())
def test_fold_state_survives_a_cut(bars, data):
    rows = [(i, float(max(a, b)), float(min(a, b)), min(a, b) + f * abs(a - b), s) for i, (a, b, f, s) in enumerate(bars)]
    cut = data.draw(st.integers(1, len(rows) - 1))
    whole = feed(ST.StructureFold(1.0), rows)
    first, second = ST.StructureFold(1.0), ST.StructureFold(1.0)
    a = feed(first, rows[:cut])
    second.load(json.loads(json.dumps(first.save())))
    b = feed(second, rows[cut:])
    joined = pd.concat([a, b], ignore_index=True)
    assert [tuple(map(repr, r)) for r in joined[FIELDS].astype(object).where(joined[FIELDS].notna(), None).to_numpy()] == \
           [tuple(map(repr, r)) for r in whole[FIELDS].astype(object).where(whole[FIELDS].notna(), None).to_numpy()]


def grow_model(v, cover=0.7):
    at = min((i for i in range(len(v)) if v[i] == max(v)), key=lambda i: (abs(i - (len(v) - 1) / 2), i))
    lo = hi = at
    while sum(v[lo:hi + 1]) < sum(v) * cover:
        up = v[hi + 1] if hi + 1 < len(v) else -1
        dn = v[lo - 1] if lo else -1
        lo, hi = (lo, hi + 1) if up >= dn else (lo - 1, hi)
    return at, lo, hi


def test_value_area_in_the_fold(spark):
    """Developing profiles carry the value area of their bins, whatever the histogram."""
    rnd = random.Random(5)
    hists = {f"s{i}": [rnd.randint(1, 50) for _ in range(rnd.randint(1, 30))] for i in range(200)}
    rows = spark.createDataFrame(
        [(k, 1.0, True, list(range(400, 400 + len(v))), v, [0] * len(v)) for k, v in hists.items()],
        "symbol string, range_scale double, publish boolean, ticks array<long>, volumes array<long>, buys array<long>")
    made = VP.developing(rows.withColumn("ts", F.timestamp_seconds(F.lit(60))), ["symbol"]).collect()
    assert len(made) == len(hists)
    for r in made:
        v = hists[r.symbol]
        at, lo, hi = grow_model(v)
        assert (r.poc, r.val, r.vah, r.poc_at) == (100 + at / 4, 100 + lo / 4, 100 + hi / 4, at)
        assert r.profile_volume == sum(v) and [b.volume for b in r.bins] == v


def test_value_area_as_column(spark):
    rnd = random.Random(2)
    hists = [[rnd.randint(1, 9) for _ in range(rnd.randint(1, 25))] for _ in range(200)]
    df = spark.createDataFrame(
        [(i, [(100 + j / 4, v, 0) for j, v in enumerate(h)]) for i, h in enumerate(hists)] + [(999, [])],
        "i int, bins array<struct<price:double,volume:long,buy:long>>")
    got = {r.i: r.a for r in df.select("i", value_area(F.col("bins")).alias("a")).collect()}
    assert got.pop(999) is None
    for i, h in enumerate(hists):
        at, lo, hi = grow_model(h)
        assert (got[i].poc, got[i].val, got[i].vah) == (100 + at / 4, 100 + lo / 4, 100 + hi / 4)


def test_percentile_rank_is_clamped_interpolation(spark):
    points = [float(x) for x in np.sort(np.random.default_rng(1).normal(size=21))]
    points[5] = points[6] = points[4]
    values = [points[0] - 1, points[0], points[4], points[20], points[20] + 1, *map(float, np.linspace(-2, 2, 40))]
    df = spark.createDataFrame([(v, points) for v in values], "v double, p array<double>")
    got = [r[0] for r in df.select(percentile_rank(F.col("v"), F.col("p"))).collect()]
    assert np.allclose(got, np.interp(values, points, np.arange(0, 101, 5)) / 100)


def levels(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t long, tick long, volume long, buy long").withColumn(
        "ts", F.timestamp_seconds("t"))


def test_range_is_open_on_the_left(spark):
    lv = levels(spark, [("X", 60, 400, 10, 6), ("X", 60, 404, 20, 5), ("X", 120, 404, 30, 10), ("X", 120, 408, 40, 40)])
    asked = spark.createDataFrame([("X", 1, 60, 120), ("X", 2, 59, 120), ("X", 3, 120, 120), ("X", 4, 0, 60)],
                                  "symbol string, range_id long, start long, end long")
    for bucket in (7, 60, 86400):
        got = {}
        for r in VP.histogram(lv, asked, bucket).collect():
            got.setdefault(r.range_id, []).append((r.tick, r.volume, r.buy))
        assert {k: sorted(v) for k, v in got.items()} == {
            1: [(404, 30, 10), (408, 40, 40)], 2: [(400, 10, 6), (404, 50, 15), (408, 40, 40)],
            4: [(400, 10, 6), (404, 20, 5)]}


def test_rebin_is_exact_and_narrow_bins_change_nothing(spark):
    rows = [(1, t, t % 7 + 1, t % 3, size) for t in range(400, 440) for size in (0.1, 1.3)]
    df = spark.createDataFrame(rows, "k int, tick long, volume long, buy long, bin_size double")
    out = VP.rebin(df, ["k"]).collect()
    for size in (0.1, 1.3):
        mine = [r for r in out if r.bin_size == size]
        assert sum(r.volume for r in mine) == sum(t % 7 + 1 for t in range(400, 440))
        assert len(mine) == (40 if size == 0.1 else len({np.floor(t / 4 / 1.3) for t in range(400, 440)}))


def test_shelves_and_gaps(spark):
    vols = [5, 60, 10, 100, 12, 5, 30, 20]
    df = spark.createDataFrame([([(float(i), v, 0) for i, v in enumerate(vols)],)],
                               "bins array<struct<price:double,volume:long,buy:long>>")
    hvn, lvn = VP.shelves_and_gaps(F.col("bins"), F.lit(3.0))
    assert df.select(hvn.alias("h"), lvn.alias("l")).first() == ([1.0], [2.0, 5.0])
