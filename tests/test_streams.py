"""Streams under scrambled arrival: in order once released, late rows told apart, restarts in the middle."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickframe.operators import quotes as QT
from tickframe.operators.features import range_scale
from tickframe.operators.series import number_rows
from tickframe.operators.structure import structure
from tickframe.plans import registered as R
from tickframe.plans import snapshot as SN
from tickframe.streaming import live as LV
from tickframe.streaming import rows as RW

T0 = dt.datetime(2024, 1, 3, 9, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(autouse=True)
def stateful(spark):
    R._stateful(spark)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def walk(seed, n, symbol):
    rng = random.Random(seed)
    price, out = 400, []
    for k in range(n):
        price += rng.randint(-3, 3)
        o, c = price, price + rng.randint(-4, 4)
        out.append((symbol, at(15 * k), o * 0.25, max(o, c) * 0.25 + 0.5, min(o, c) * 0.25 - 0.25, c * 0.25, 5 + k % 7))
    return out


BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


def parts(spark, rows, schema, sizes, seed):
    """Arrival in parts, each in random order."""
    rng, out, k = random.Random(seed), [], 0
    for n in sizes:
        own = rows[k:k + n]
        rng.shuffle(own)
        out.append(spark.createDataFrame(own, schema))
        k += n
    return out


def same(a: pd.DataFrame, b: pd.DataFrame, by):
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c].to_list(), b[c].to_list()
        for p, q in zip(x, y):
            assert (pd.isna(p) and pd.isna(q)) or p == q or abs(p - q) < 1e-9, c


def test_structure_in_any_order_equals_batch(spark):
    """Two symbols; rows of a part overlap the next part's by less than the delay."""
    rows = sorted(walk(1, 90, "A") + walk(2, 90, "B"), key=lambda r: r[1])
    batch = spark.createDataFrame(rows, BAR)
    for k in range(20, 160, 40):                 # neighbouring rows change parts
        rows[k:k + 6] = reversed(rows[k:k + 6])
    given = parts(spark, rows, BAR, (43, 61, 76), 3)
    make = lambda: LV.LiveStructure(window=7200)
    found = LV.replay(spark, [*given, LV.closing(batch)], lambda s: LV.stream_structure(s, make, delay="2 hours"))
    assert found.where("late").count() == 0
    want = structure(range_scale(number_rows(batch, ["symbol"]), 900, window=7200))
    cols = ["symbol", "time", "range_scale", "swing", "swing_price", "swing_time", "retrace", "bos", "bos_level", "bos_time"]
    same(found.select(cols).toPandas(), want.withColumn("time", F.unix_seconds("ts")).select(cols).toPandas(), ["symbol", "time"])


def test_late_rows_are_told_and_change_nothing(spark):
    """Rows older than what was released come out as late, each once; the rest is as if they had never come."""
    rows = walk(5, 80, "A")
    first, second = rows[:40], rows[40:]
    missing = [first.pop(k) for k in (31, 12, 3)]
    # 40 bars, then those three, hours behind, with the rest
    given = [spark.createDataFrame(first, BAR), spark.createDataFrame(second[:20] + missing, BAR), spark.createDataFrame(second[20:], BAR)]
    batch = spark.createDataFrame(first + second, BAR)
    make = lambda: LV.LiveStructure(window=7200)
    found = LV.replay(spark, [*given, LV.closing(batch)], lambda s: LV.stream_structure(s, make, delay="30 minutes"))
    late = found.where("late").collect()
    assert sorted(r.time for r in late) == sorted(int(r[1].timestamp()) for r in missing)
    assert all(r.range_scale is None and r.swing is None and r.symbol == "A" for r in late)
    want = structure(range_scale(number_rows(batch, ["symbol"]), 900, window=7200))
    cols = ["symbol", "time", "range_scale", "swing", "swing_price", "swing_time", "bos", "bos_level"]
    same(found.where("not late").select(cols).toPandas(),
         want.withColumn("time", F.unix_seconds("ts")).select(cols).toPandas(), ["symbol", "time"])


def test_quiet_symbols_are_released_by_others(spark):
    """A symbol that receives nothing more still leaves once event time has moved on elsewhere."""
    rows = walk(1, 12, "A")
    later = [("B", at(60 * 24), 1.0, 2.0, 1.0, 1.5, 3)]
    given = [spark.createDataFrame(rows, BAR), spark.createDataFrame(later, BAR)]
    found = LV.replay(spark, given, lambda s: LV.stream_structure(s, delay="1 minute"))
    assert {r.symbol for r in found.collect()} == {"A"} and found.count() == 12


QUOTE = "symbol string, ts timestamp, time long, kind int, seq long, price double, bid double, ask double"


def test_quotes_in_any_order_equal_batch(spark):
    rng, rows = random.Random(4), []
    for k in range(400):
        t = at(k // 3)
        if rng.random() < 0.4:
            rows.append(("A", t, int(t.timestamp()), 0, k, None, rng.choice([None, k * 0.25]), rng.choice([None, k * 0.25 + 1])))
        else:
            rows.append(("A", t, int(t.timestamp()), 1, k, float(k), None, None))
    merged = spark.createDataFrame(rows, QUOTE)
    found = LV.replay(spark, [*parts(spark, rows, QUOTE, (130, 130, 140), 8), LV.closing(merged)],
                      lambda s: LV.stream_prevailing(s, delay="5 minutes"))
    assert found.where("late").count() == 0
    want = QT.prevailing(merged.where("kind = 1").select("symbol", "ts", "seq", "price"),
                         merged.where("kind = 0").select("symbol", "ts", "seq", "bid", "ask"))
    cols = ["seq", "price", "bid", "ask"]
    same(found.select(cols).toPandas(), want.select(cols).toPandas(), ["seq"])


def test_a_late_quote_changes_no_trade(spark):
    trade = lambda m, seq: ("A", at(m), int(at(m).timestamp()), 1, seq, 1.0, None, None)
    quote = lambda m, seq, bid: ("A", at(m), int(at(m).timestamp()), 0, seq, None, bid, bid + 1)
    # the trade of minute 50 has left when the quote of minute 2 comes
    given = [[quote(0, 0, 5.0), trade(1, 1), trade(50, 2), trade(100, 4)], [quote(2, 3, 9.0), trade(101, 5)], [trade(300, 6)]]
    found = LV.replay(spark, [spark.createDataFrame(g, QUOTE) for g in given], lambda s: LV.stream_prevailing(s, delay="1 minute"))
    got = sorted((r.seq, r.late, r.bid) for r in found.collect())
    assert got == [(1, False, 5.0), (2, False, 5.0), (3, True, 9.0), (4, False, 5.0), (5, False, 5.0)]


def test_bars_without_range_or_levels(spark):
    """A bar without high and low has no scale; one without levels feeds no profile; nothing breaks."""
    rows = walk(3, 60, "A")
    rows[20] = (*rows[20][:3], None, None, None, rows[20][6])
    bars = spark.createDataFrame(rows, BAR).withColumns({c: F.lit(None).cast("long") for c in ("delta", "buy_volume", "sell_volume", "trades")})
    levels = [{"ticks": None, "volumes": None, "buys": None}] * 60
    given = bars.withColumns({c: F.lit(None).cast("array<long>") for c in ("ticks", "volumes", "buys")})
    given = given.withColumn("ticks", F.when((F.unix_seconds("ts") % 2700 != 0) & F.col("close").isNotNull(), F.array(F.floor(F.col("close") / 0.25))))
    given = given.withColumns({c: F.when(F.col("ticks").isNotNull(), F.array(F.lit(n).cast("long"))) for c, n in (("volumes", 4), ("buys", 1))})
    found = LV.replay(spark, [given, LV.closing(given)], lambda s: RW.stream_rows(s, dials=SN.Dials(7200, 7200)))
    out = found.where("not late").orderBy("ts").collect()
    assert len(out) == 60 == len(levels) and found.columns[-1] == "late"
    assert out[20].range_scale is None and out[20].swing is None and out[21].range_scale is not None
    assert set(SN.fields()) <= set(found.columns) and any(r.profile_poc is not None for r in out)
    assert all(np.isclose(sum(b.volume for b in r.profile_bins), r.profile_volume) for r in out if r.profile_bins)


def test_rows_travel_in_packs():
    """A key's rows of a batch are one row for the stateful operator, with their first and last time."""
    import pyarrow as pa
    from tickframe.streaming.ordered import _packs
    n = 6000
    us = pa.array(np.random.default_rng(2).permutation(n).astype(np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(["A", "B", None] * (n // 3)), us, us.cast(pa.timestamp("us", "UTC")), pa.array(range(n))],
                                       names=["symbol", "us", "ts", "seq"])
    (out,) = _packs([batch])
    assert sorted(map(str, out.column("symbol").to_pylist())) == ["A", "B", "None"]
    schema = pa.schema([("us", pa.int64()), ("seq", pa.int64())])
    for row in out.to_pylist():
        held = pa.ipc.read_record_batch(pa.py_buffer(row["rows"]), schema).to_pydict()
        want = [(u, k) for s, u, k in zip(batch.column(0).to_pylist(), us.to_pylist(), range(n)) if s == row["symbol"]]
        assert list(zip(held["us"], held["seq"])) == want
        assert (row["lo"], row["hi"]) == (min(held["us"]), max(held["us"])) and row["ts"].timestamp() == pytest.approx(row["hi"] / 1e6)


class Kept:
    """One state of a key as the store keeps it: a list is one value, every entry of a map is one. ``moved`` counts the
    bytes read and written (the store reads a value before it adds to it), ``largest`` is the largest value."""

    moved = largest = 0

    def __init__(self, listed):
        self.listed, self.held = listed, {}

    def _at(self, key):
        size = sum(len(x) for row in self.held.get(key, ()) for x in row if isinstance(x, bytes))
        Kept.moved, Kept.largest = Kept.moved + size, max(Kept.largest, size)
        return self.held.get(key, [])

    def exists(self):
        return bool(self.held)

    def clear(self):
        self.held = {}

    def get(self):
        return self._at(0) if self.listed else self._at(0)[0]

    def update(self, row):
        self.updateValue(0, row)

    def appendList(self, rows):
        self.held[0] = [*self._at(0), *rows]
        self._at(0)

    def keys(self):
        return iter([*reversed(self.held)])

    def getValue(self, key):
        return self._at(key)[0]

    def updateValue(self, key, row):
        self.held[key] = [row]
        self._at(key)

    def removeKey(self, key):
        del self.held[key]


class Handle:
    """States and timers of one key, without a store."""

    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return Kept(True)

    def getMapState(self, *_):
        return Kept(False)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_what_waits_is_a_value_a_pack():
    """Packs that come cost their own bytes and not those of all that wait, whatever the size of a symbol; rows of a
    time come in order of arrival."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from tickframe.streaming import ordered as O

    class Processor(O.InOrder):
        def feed(self, frame):
            return frame

    given = T.StructType([T.StructField("us", T.LongType()), T.StructField("seq", T.LongType())])
    p = Processor(given, T.StructType([*given.fields, T.StructField("late", T.BooleanType())]), ["us"], 0)
    p.init(handle := Handle())
    # Packs that reach over the same hour, every second one over an hour of the next day too.
    rng, n, packs = np.random.default_rng(7), 200, 60
    at = [np.concatenate([rng.integers(0, 3600, n), rng.integers(86_400, 90_000, n if k % 2 else 0)]) for k in range(packs)]
    frames = [pd.DataFrame({"us": (s * 1000 + O.GRACE) * 1000, "seq": k * 1000 + np.arange(len(s))}) for k, s in enumerate(at)]
    frames[0].loc[0, "us"] = frames[-1].loc[0, "us"] = (1800_000 + O.GRACE) * 1000
    data = [pa.RecordBatch.from_pandas(f, preserve_index=False).serialize().to_pybytes() for f in frames]
    came = pd.DataFrame({"lo": [f["us"].min() for f in frames], "hi": [f["us"].max() for f in frames], "rows": data})
    rows = pd.concat(frames).sort_values("us", kind="stable")

    Kept.moved = Kept.largest = 0
    assert list(p.handleInputRows(("A",), iter([came[:20], came[20:]]), Watermark(0))) == []
    assert Kept.largest == max(map(len, data)) and Kept.moved <= 2 * sum(map(len, data))
    early = rows["us"] <= (7_200_000 + O.GRACE) * 1000
    found = pd.concat(p._release(("A",), Watermark(7_200_000)))
    assert found["seq"].tolist() == rows["seq"][early].tolist() and not found["late"].any()
    assert len(handle.timers) == 1 and Kept.moved <= 6 * sum(map(len, data))
    again = pd.concat(p.handleInputRows(("A",), iter([came[:1]]), Watermark(7_200_000)))
    assert sorted(again["seq"]) == frames[0]["seq"].tolist() and again["late"].all()
    found = pd.concat(p._release(("A",), Watermark(90_000_000)))
    assert found["seq"].tolist() == rows["seq"][~early].tolist() and list(p.waiting.keys()) == []


def test_many_rows_are_packed_by_time_and_merged():
    """A symbol of many rows is cut by time; packs are opened as their time comes, not all at once."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from tickframe.streaming import ordered as O

    class Processor(O.InOrder):
        def feed(self, frame):
            return frame

    rng, n, runs = np.random.default_rng(3), 45_000, 4
    given = T.StructType([T.StructField("us", T.LongType()), T.StructField("seq", T.LongType())])
    p = Processor(given, T.StructType([*given.fields, T.StructField("late", T.BooleanType())]), ["us"], 0)
    p.init(Handle())
    frames = [pd.DataFrame({"symbol": np.where(rng.random(n) < 0.01, "B", "A"), "us": (rng.integers(0, 5000, n) * 1000 + O.GRACE) * 1000,
                            "seq": k * n + np.arange(n)}) for k in range(runs)]
    batches = [[pa.RecordBatch.from_pandas(f.assign(ts=pd.to_datetime(f["us"], unit="us"))[a:a + 9000], preserve_index=False)
                for a in range(0, n, 9000)] for f in frames]
    came = [pa.Table.from_batches(list(O._packs(b))).to_pandas() for b in batches]
    for table, frame in zip(came, frames):
        packs = table[table["symbol"] == "A"]
        held = [pa.ipc.read_record_batch(pa.py_buffer(r), pa.schema([("us", pa.int64()), ("seq", pa.int64())])).to_pandas() for r in packs["rows"]]
        assert len(packs) == 5 and (packs["lo"].iloc[1:].to_numpy() >= packs["hi"].iloc[:-1].to_numpy()).all()
        assert all(len(h) <= O.BATCH and h["seq"].is_monotonic_increasing for h in held)
        assert sorted(pd.concat(held)["seq"]) == frame["seq"][frame["symbol"] == "A"].tolist()
    tables = [t[t["symbol"] == "A"] for t in came]
    assert list(p.handleInputRows(("A",), iter(tables), Watermark(0))) == []
    found = p._release(("A",), Watermark(4_000_000))
    first = next(found)
    assert len([*p.waiting.keys()]) >= 10
    got = [*pd.concat([first, *found])["seq"], *pd.concat(p._release(("A",), Watermark(9_000_000)))["seq"]]
    rows = pd.concat(frames)
    assert got == rows[rows["symbol"] == "A"].sort_values("us", kind="stable")["seq"].tolist()
