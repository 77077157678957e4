"""Fills, outcomes, books, statistics."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickframe.operators import orders as O
from tickframe.operators import stats as Q
from tickframe.operators import research as RE
from tickframe.plans import search as SG

CASES = [
    # direction, entry, stop, target, (o, h, l, c), entry fill, exit (price, reason, ambiguous)
    ("long", 100.0, 95.0, 110.0, (99.0, 101.0, 98.0, 100.0), 100.25, None),
    ("long", 100.0, 95.0, 110.0, (102.0, 103.0, 101.0, 102.0), 102.25, None),
    ("long", 100.0, 95.0, 110.0, (98.0, 99.0, 97.0, 98.0), None, None),
    ("long", 100.0, 95.0, 110.0, (98.0, 100.0, 94.0, 98.0), 100.25, (94.75, "stop", False)),
    ("long", 100.0, 95.0, 110.0, (93.0, 94.0, 92.0, 93.0), None, (92.75, "stop", False)),
    ("long", 100.0, 95.0, 110.0, (109.0, 111.0, 108.0, 110.0), 109.25, (110.0, "target", False)),
    ("long", 100.0, 95.0, 110.0, (100.0, 111.0, 94.0, 100.0), 100.25, (94.75, "stop", True)),
    ("short", 100.0, 105.0, 90.0, (101.0, 102.0, 99.0, 100.0), 99.75, None),
    ("short", 100.0, 105.0, 90.0, (98.0, 99.0, 97.0, 98.0), 97.75, None),
    ("short", 100.0, 105.0, 90.0, (102.0, 106.0, 101.0, 105.0), None, (105.25, "stop", False)),
    ("short", 100.0, 105.0, 90.0, (107.0, 108.0, 106.0, 107.0), None, (107.25, "stop", False)),
    ("short", 100.0, 105.0, 90.0, (91.0, 92.0, 89.0, 90.0), 90.75, (90.0, "target", False)),
    ("short", 100.0, 105.0, 90.0, (100.0, 106.0, 89.0, 100.0), 99.75, (105.25, "stop", True)),
]


def test_fill_columns_and_scalars(spark):
    df = spark.createDataFrame([(i, d, e, s, g, *b) for i, (d, e, s, g, b, *_) in enumerate(CASES)],
                               "i int, d string, e double, s double, g double, o double, h double, l double, c double")
    c = {n: F.col(n) for n in "desgohl"}
    rows = df.select("i", O.entry_price(c["d"], c["e"], c["o"], c["h"], c["l"]).alias("entry"),
                     O.exit_fill(c["d"], c["s"], c["g"], c["o"], c["h"], c["l"]).alias("x")).orderBy("i").collect()
    for r, (d, e, s, g, (o, h, low, _), entry, leave) in zip(rows, CASES):
        assert r.entry == entry and (tuple(r.x) if r.x else None) == leave
        assert O._touch_entry(d == "long", e, o, h, low, O.SLIP) == entry
        assert O._touch_exit(d == "long", s, g, o, h, low, O.SLIP) == leave


def path(n=400, seed=4, gaps=True):
    rnd = random.Random(seed)
    p, rows = 400, []
    for i in range(n):
        o = p
        p += rnd.randint(-8, 8)
        way = rnd.choice(["long", "short", None])
        level = (max(o, p) + rnd.randint(0, 6)) if way == "long" else (min(o, p) - rnd.randint(0, 6))
        k = rnd.randint(2, 20)
        up = 1 if way == "long" else -1
        rows.append(dict(symbol="X", bar_no=i, gap_before=bool(gaps and i and rnd.random() < 0.03), time=900 * (i + 1),
                         open=o / 4, high=(max(o, p) + rnd.randint(0, 3)) / 4, low=(min(o, p) - rnd.randint(0, 3)) / 4,
                         close=p / 4, direction=way, entry_stop=level / 4 if way else None,
                         stop_price=(level - up * k) / 4 if way else None, target_price=(level + up * k) / 4 if way else None))
    return rows


def signals(spark, rows):
    seg, out = 0, []
    for r in rows:
        seg += r["gap_before"]
        out.append({**r, "segment": seg})
    cols = ["symbol", "bar_no", "gap_before", "segment", *O.BAR]
    return spark.createDataFrame(
        [tuple(r[c] for c in cols) for r in out],
        "symbol string, bar_no long, gap_before boolean, segment long, time long, open double, high double, low double, "
        "close double, direction string, entry_stop double, stop_price double, target_price double").withColumn(
        "ts", F.timestamp_seconds("time")).drop("time")


def one_by_one(rows):
    """Every signal followed on its own through its segment."""
    seg, segs = 0, []
    for r in rows:
        seg += r["gap_before"]
        segs.append(seg)
    out = set()
    for i, r in enumerate(rows):
        if not r["direction"]:
            continue
        up, entry, found = r["direction"] == "long", None, None
        j = i
        for j in range(i + 1, len(rows)):
            if segs[j] != segs[i]:
                break
            b = rows[j]
            if entry is None:
                price = O._touch_entry(up, r["entry_stop"], b["open"], b["high"], b["low"], O.SLIP)
                if price is None:
                    continue
                entry = (b["time"], price)
            done = O._touch_exit(up, r["stop_price"], r["target_price"], b["open"], b["high"], b["low"], O.SLIP)
            if done:
                found = (b["time"], done[0], done[1], bool(done[2]), b["time"] == entry[0])
                break
        last = max(x for x in range(len(rows)) if segs[x] == segs[i])
        if entry is None:
            out.add((r["time"], None, None, None, None, "unfilled", False, False))
        elif found:
            out.add((r["time"], *entry, *found))
        elif segs[i] == segs[-1]:
            out.add((r["time"], *entry, None, None, "open", False, False))
        else:
            out.add((r["time"], *entry, rows[last]["time"], rows[last]["close"], "session", False, False))
    return out


def test_outcomes_equal_brute_force(spark):
    rows = path()
    got = O.bracket_outcomes(signals(spark, rows)).select(
        "time", "entry_time", "entry_price", "exit_time", "exit_price", "reason", "ambiguous", "same_bar").collect()
    assert {tuple(r) for r in got} == one_by_one(rows) and len(got) == sum(1 for r in rows if r["direction"])


def test_chunked_book_equals_one_pass(spark):
    s = signals(spark, path(1500))
    whole = sorted(O.trade_book(s).collect())
    assert len(whole) > 30 and sorted(O.trade_book(s, chunk=50).collect()) == whole


def book(bars, **kw):
    cols = ["bar_no", "gap_before", *O.BAR]
    return O.BookFold(**kw).feed(pd.DataFrame([dict(zip(cols, b)) for b in bars], columns=cols))


def test_arm_then_trigger_on_the_next_bar():
    out = book([(0, False, 1, 9.0, 12.0, 8.0, 10.0, "long", 11.0, 9.0, 13.0),
                (1, False, 2, 10.0, 11.0, 10.0, 11.0, None, None, None, None),
                (2, False, 3, 11.0, 13.5, 10.5, 13.0, None, None, None, None)])
    row = out.iloc[0]
    assert (row.entry_time, row.exit_time, row.entry_price, row.exit_price, row.bars) == (2, 3, 11.25, 13.0, 2)
    assert row.same_bar == False and row.mfe_points == 2.25  # noqa: E712


def test_gap_flattens_a_position_but_not_an_order():
    held = [(0, False, 1, 10.0, 10.0, 10.0, 10.0, "long", 11.0, 5.0, 20.0),
            (1, False, 2, 10.0, 11.0, 10.0, 10.5, None, None, None, None),
            (2, True, 9, 30.0, 30.0, 30.0, 30.0, None, None, None, None)]
    row = book(held).iloc[0]
    assert (row.reason, row.exit_time, row.exit_price) == ("session", 2, 10.5)
    armed = [held[0], (1, True, 9, 12.0, 12.0, 4.0, 5.0, None, None, None, None)]
    row = book(armed).iloc[0]
    assert (row.entry_time, row.reason, row.same_bar) == (9, "stop", True)
    assert len(book(held, hold=True)) == 1 and book(held, hold=True).iloc[0].reason == "target"


def test_open_position_is_not_reported():
    assert len(book([(0, False, 1, 10.0, 10.0, 10.0, 10.0, "long", 11.0, 5.0, 20.0),
                     (1, False, 2, 10.0, 11.0, 10.0, 10.5, None, None, None, None)])) == 0


def trades(spark, pnls, direction="long"):
    return spark.createDataFrame(
        [("X", 1000 * (i + 1), direction, float(p), 4.0, 2, 1.0, 2.0, 3.0, i == 0, False) for i, p in enumerate(pnls)],
        "symbol string, exit_time long, direction string, pnl_dollars double, commission double, bars long, mae double, "
        "mfe double, etd double, ambiguous boolean, same_bar boolean")


def test_statistics_by_hand(spark):
    out = {r.scope: r for r in Q.summarise(trades(spark, [10, -5, 0, 20, 5, -10]), ["symbol"], capital=100.0).collect()}
    a = out["all"]
    assert (a.n_trades, a.wins, a.losses, a.evens, a.net_profit, a.gross_loss) == (6, 3, 2, 1, 20.0, 15.0)
    assert (a.max_consec_wins, a.max_consec_losses) == (2, 2)
    assert a.max_drawdown == 10.0 and abs(a.max_drawdown_pct - 10 / 130 * 100) < 1e-9
    pn = pd.Series([10, -5, 0, 20, 5, -10.0])
    assert abs(a.sharpe - pn.mean() / pn.std()) < 1e-9
    assert abs(a.sortino - pn.mean() / pn.clip(upper=0).std()) < 1e-9
    assert out["short"].n_trades == 0 and math.isinf(out["short"].profit_factor) and out["long"].n_trades == 6


def test_objective_guards(spark):
    good = Q.summarise(trades(spark, [1, 2, 3]), ["symbol"], scopes=("all",))
    assert good.select(Q.score("profit_factor")).first()[0] == float("-inf")       # no losses
    assert good.select(Q.score("net_profit", 4)).first()[0] == float("-inf")
    assert good.select(Q.score("net_profit", 3)).first()[0] == 6.0
    with pytest.raises(KeyError):
        Q.score("luck")


def test_grid_and_folds(spark):
    assert SG.expand({}) == [{}]
    assert SG.expand({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    day = 86400
    bars = spark.createDataFrame([("X", 0), ("X", 20 * day), ("Y", 0), ("Y", 5 * day)], "symbol string, t long").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = sorted((r.fold, r.is_start // day, r.oos_start // day, r.oos_end // day)
                 for r in SG.fold_windows(bars, 10, 4, 4).collect())
    assert got == [(1, 0, 10, 14), (2, 4, 14, 18)]
    assert {r.is_start for r in SG.fold_windows(bars, 10, 4, 4, anchored=True).collect()} == {0}


def test_efficiency_ignores_infinite_scores(spark):
    df = spark.createDataFrame([("X", 1.0, 2.0), ("X", float("-inf"), 4.0), ("Y", float("-inf"), 1.0)],
                               "symbol string, oos_score double, is_score double")
    got = {r.symbol: r.efficiency for r in SG.efficiency(df).collect()}
    assert got == {"X": 1.0 / 3.0, "Y": 0.0}


def test_largest_survives_salting(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), "id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"))
    got = [r.v for r in RE.largest(df, ["k"], [F.desc("v")], ["id"], 5).orderBy("place").collect()]
    assert got == [999, 998, 997, 996, 995]


def test_medians_are_exact(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.choice([0.0, rnd.gauss(0, 3)])) for k in "abc" for _ in range({"a": 1, "b": 200, "c": 301}[k])]
    df = spark.createDataFrame(rows, "k string, v double")
    for width in (1 / 64, 5.0, 1000.0):
        got = {r.k: r["median"] for r in RE.medians(df, ["k"], "v", width).collect()}
        want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].median().to_dict()
        assert got == pytest.approx(want, abs=1e-12)


def test_first_touch_equals_brute_force(spark):
    rnd = random.Random(9)
    p, rows = 100.0, []
    for i in range(200):
        p += rnd.randint(-4, 4) / 4
        rows.append(("X", 60 * i, p + rnd.randint(0, 3) / 4, p - rnd.randint(0, 3) / 4, p, None if i < 5 else 1.0))
    df = spark.createDataFrame(rows, "symbol string, t long, high double, low double, close double, range_scale double").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = {r.at: (r.label, r.touched) for r in RE.first_touch(df, 1.5).collect()}
    want = {}
    for i, (_, t, _, _, c, s) in enumerate(rows):
        if s is None:
            continue
        want[t] = ("none", None)
        for _, u, h, low, *_ in rows[i + 1:]:
            up, down = h >= c + 1.5 * s, low <= c - 1.5 * s
            if up or down:
                want[t] = ("both" if up and down else "up" if up else "down", u)
                break
    assert got == want
