"""Rows of a key in order of time, however they arrive.

A stream brings rows out of order. ``InOrder`` keeps a key's rows in list state until event time has
moved ``hold`` past them, then hands them on sorted; an event-time timer wakes keys that receive nothing
themselves. A row at or before the time already handed on comes too late: it goes out as it came, marked
``late``, and changes nothing. Spark's own watermark trails by ``GRACE``, far behind, so that late rows reach the
processor and are reported instead of dropped.

Rows travel and wait in packs: before the shuffle a key's rows become Arrow messages with their first and last time, cut by
time where they are many. So a dense symbol costs the stateful operator a row a pack, and a late row is looked for only in packs
that reach back. Packs are opened in order of time and their rows merged, so memory is what overlaps. Every waiting pack is an entry of its own in map state, under its times and number: list state is one value a key, which the
store reads whole for each pack that joins it. Packs that stay are not written again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

GRACE_DAYS = 3650
GRACE = GRACE_DAYS * 86_400_000       # milliseconds
BATCH = 10_000                        # rows handed on at once, and rows of a pack
GATHER = 32 << 20                     # bytes of rows gathered before they are packed
PACK = "lo long, hi long, rows binary"
PLACE = "lo long, hi long, n long"    # first and last time of a waiting pack, its number in order of arrival


def _gathered(batches) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``GATHER`` bytes; empty ones are left out."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.nbytes
        if size >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packs(batches) -> Iterator[pa.RecordBatch]:
    """A row per key and pack: its last ``ts``, first and last ``us``, and the rest of its rows as one message."""
    for batch in _gathered(batches):
        symbol = batch.column("symbol").dictionary_encode(null_encoding="encode")
        code, us = symbol.indices.to_numpy(zero_copy_only=False), batch.column("us").to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        cuts = []
        for a, b in itertools.pairwise([0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]):
            cuts += range(a, b, BATCH)
            if b - a > BATCH:          # by time; within a pack, and at one time, as they came
                own = order[a:b]
                own = own[np.argsort(us[own], kind="stable")]
                order[a:b] = np.concatenate([np.sort(own[k:k + BATCH]) for k in range(0, b - a, BATCH)])
        cuts.append(len(code))
        batch, us = batch.take(pa.array(order)), us[order]
        kept = batch.drop_columns(["symbol", "ts"])
        rows = [(kept.slice(a, b - a).serialize().to_pybytes(), a, a + int(us[a:b].argmax()), us[a:b].min(), us[a:b].max())
                for a, b in itertools.pairwise(cuts)]
        data, first, last, lo, hi = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("symbol").take(pa.array(first)), batch.column("ts").take(pa.array(last)), pa.array(lo, pa.int64()),
             pa.array(hi, pa.int64()), pa.array(data, pa.binary())], names=["symbol", "ts", "lo", "hi", "rows"])


class InOrder(StatefulProcessor):
    """Calls ``feed(frame)`` with rows in ``order``, oldest first; a subclass keeps its own states beside.

    ``rows`` is the schema of the rows kept; its first field after the key is ``us``, the event time in microseconds.
    ``start`` (open states), ``load`` and ``save`` are called once a key and batch in which rows are handed on.
    """

    def __init__(self, rows: T.StructType, out: T.StructType, order: Sequence[str], hold: int):
        self.rows, self.out, self.order, self.hold = rows, out, list(order), hold

    def init(self, handle):
        self.handle, self.arrow = handle, to_arrow_schema(self.rows)
        self.waiting = handle.getMapState("waiting", PLACE, "rows binary")
        self.count = handle.getValueState("count", "n long")
        self.released = handle.getValueState("released", "us long")
        self.alarm = handle.getValueState("alarm", "ms long")
        self.start(handle)

    def start(self, handle) -> None: ...

    def load(self) -> None: ...

    def save(self) -> None: ...

    def feed(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def frame(self, rows: pa.Table) -> pd.DataFrame:
        """The rows as ``feed`` takes them: plain values, None where one is missing."""
        return pd.DataFrame({c: pd.Series(_known(rows.column(c)).to_pylist(), dtype=object) for c in rows.column_names})

    def _shaped(self, key, frame: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = frame.assign(symbol=key[0], late=late).reindex(columns=self.out.fieldNames())
        gaps = [c for c in out if out[c].hasnans]
        return out.astype(dict.fromkeys(gaps, object)).where(out.notna(), None) if gaps else out

    def _unpacked(self, data: bytes) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(data), self.arrow)])

    def _wait(self, n: int, rows: pa.Table) -> tuple[int, int, int]:
        """Keep rows as a pack of this number; its place."""
        us = pc.min_max(rows.column("us")).as_py()
        place = (us["min"], us["max"], n)
        self.waiting.updateValue(place, (rows.combine_chunks().to_batches()[0].serialize().to_pybytes(),))
        return place

    def handleInputRows(self, key, rows, timerValues):
        done = self.released.get()[0] if self.released.exists() else None
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            for lo, hi, data in zip(frame["lo"].tolist(), frame["hi"].tolist(), frame["rows"].tolist()):
                n += 1
                if done is None or lo > done:
                    self.waiting.updateValue((lo, hi, n), (bytes(data),))
                    continue
                given = self._unpacked(bytes(data))
                late = pc.less_equal(given.column("us"), done)
                yield self._shaped(key, self.frame(given.filter(late)), True)
                if hi > done:
                    self._wait(n, given.filter(pc.invert(late)))
        self.count.update((n,))
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.alarm.exists() and self.alarm.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.alarm.clear()
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        horizon = (now + GRACE - self.hold) * 1000 if now > 0 else None
        ready, rest = [], []
        for place in self.waiting.keys():
            (rest if horizon is None or place[0] > horizon else ready).append(place)
        if ready:
            self.load()
            for held in self._merged(sorted(ready), horizon, rest):
                for at in range(0, len(held), BATCH):
                    yield self._shaped(key, self.feed(self.frame(held.slice(at, BATCH))), False)
            self.released.update((held.column("us")[-1].as_py(),))
            self.save()
        if rest:
            wanted = min(lo for lo, *_ in rest) // 1000 + 1 - GRACE + self.hold
            old = self.alarm.get()[0] if self.alarm.exists() else None
            if old is None or wanted < old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(max(wanted, now + 1))
                self.alarm.update((max(wanted, now + 1),))

    def _merged(self, ready: list[tuple], horizon: int, rest: list[tuple]) -> Iterator[pa.Table]:
        """The rows of packs up to the horizon, in order; what is left of a pack beyond it waits on and joins ``rest``."""
        opened, left = [], 0
        for (lo, hi, n), after in itertools.zip_longest(ready, (p[0] for p in ready[1:])):
            held = self._unpacked(self.waiting.getValue((lo, hi, n))[0])
            self.waiting.removeKey((lo, hi, n))
            if hi > horizon:
                now_ = pc.less_equal(held.column("us"), horizon)
                rest.append(self._wait(n, held.filter(pc.invert(now_))))
                held = held.filter(now_)
            opened.append(held.append_column("_n", pa.array(np.full(len(held), n))))
            if after is not None and sum(map(len, opened)) < 2 * left + BATCH:
                continue
            held = pa.concat_tables(opened)
            if after is not None:      # rows from the next pack's first time on wait for it
                now_ = pc.less(held.column("us"), after)
                opened, held = [held.filter(pc.invert(now_))], held.filter(now_)
                left = len(opened[0])
            if len(held):
                yield held.take(pc.sort_indices(held, [(c, "ascending") for c in (*self.order, "_n")])).drop_columns(["_n"])

    def close(self):
        pass


def _known(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The column with null for what is not a number."""
    if not pa.types.is_floating(column.type):
        return column
    return pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column)


def in_order(rows: DataFrame, make: Callable[[T.StructType], InOrder], warm: DataFrame | None = None) -> DataFrame:
    """Run a processor over ``rows`` (symbol, ts, ...) a symbol at a time; the result has ``late``.

    A late row keeps the columns that the result shares with the input, its other fields are null.
    """
    held = rows.where("ts is not null").select(
        "symbol", F.unix_micros("ts").alias("us"), "ts", *[c for c in rows.columns if c not in ("symbol", "ts", "us")])
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in held.schema.fields if f.name not in ("symbol", "ts")])
    processor = make(kept)
    packs = held.mapInArrow(_packs, f"symbol {held.schema['symbol'].dataType.simpleString()}, ts {held.schema['ts'].dataType.simpleString()}, {PACK}")
    return packs.withWatermark("ts", f"{GRACE_DAYS} days").groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.out, outputMode="Append", timeMode="EventTime",
        initialState=None if warm is None else warm.groupBy("symbol"))


def milliseconds(duration: str) -> int:
    """``"90 seconds"``, ``"2 minutes"``, ``"1 hour"``, ``"3 days"`` in milliseconds."""
    number, unit = duration.split()
    return int(float(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])
