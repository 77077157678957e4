"""Streams: closed bars, prevailing quotes, and the structure fold with its own scale.

Event time rules: rows later than the watermark are dropped (the query's progress counts them as
``numRowsDroppedByWatermark``; ``observe`` counts what came in); bars
leave once the watermark passes their close. Stateful streams need the session's state store provider
set to RocksDB.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import config
from tickframe.operators.bars import _flow_sums
from tickframe.operators.series import shared_folder
from tickframe.operators.structure import FIELDS, StructureFold
from tickframe.functions.columns import aggressor
from tickframe.schemas import FLOW, OHLC
from tickframe.streaming.ordered import InOrder, in_order, milliseconds


def stream_bars(ticks: DataFrame, step: int, delay: str = "1 minute") -> DataFrame:
    """Close-stamped bars of a tick stream, emitted when closed."""
    side = F.col("side") if "side" in ticks.columns else aggressor()
    # Windows are closed on the left; a step back of one microsecond closes them on the right.
    rows = (ticks.select("symbol", (F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).alias("edge"),
                         "seq", "price", "volume", side.alias("side"))
            .observe("ingest", F.count(F.lit(1)).alias("rows"), F.max("edge").alias("newest"))
            .withWatermark("edge", delay))
    return (rows.groupBy("symbol", F.window("edge", f"{step} seconds").alias("w"))
            .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
                 *_flow_sums(F.col("side")))
            .select("symbol", F.col("w.end").alias("ts"), *OHLC, "volume", *FLOW))


def stream_rungs(ticks: DataFrame, timeframes: Iterable[str], delay: str = "1 minute"):
    """One closed-bar stream per timeframe over the same source."""
    return {name: stream_bars(ticks, config.seconds(name), delay) for name in timeframes}


class LiveStructure:
    """Scale and structure of one series, bar by bar: what the batch windows and fold give.
    A bar without a range has no scale and leaves the swings as they are.

    Serves the stream and the silent warm-up alike; ``save`` holds all there is to know.
    """

    def __init__(self, retrace=config.RETRACE, window=config.SCALE_WINDOW, floor=config.SCALE_MIN_BARS):
        self.fold = StructureFold(retrace)
        self.window, self.floor = window, floor
        self.seen: list[list] = []

    def save(self) -> str:
        return json.dumps([self.seen, self.fold.save()])

    def load(self, text: str) -> None:
        self.seen, inner = json.loads(text)
        self.fold.load(inner)

    def scale(self, t, spread):
        if spread is None or spread != spread:
            return None
        self.seen.append([t, spread])
        fresh = sum(1 for at, _ in self.seen if at > t - self.window)
        self.seen = self.seen[-max(fresh, self.floor):]
        if len(self.seen) < self.floor:
            return None
        median = float(np.median([s for _, s in self.seen]))
        return median if median > 0 else None

    def feed(self, frame: pd.DataFrame) -> pd.DataFrame:
        scales = [self.scale(t, h - low) for t, h, low in
                  zip(frame["time"].tolist(), frame["high"].tolist(), frame["low"].tolist())]
        return self.fold.feed(frame.assign(range_scale=pd.Series(scales, index=frame.index, dtype="float64")))


def live_schema() -> T.StructType:
    return T.StructType([
        T.StructField("symbol", T.StringType()), T.StructField("time", T.LongType()),
        T.StructField("range_scale", T.DoubleType()), *[T.StructField(n, t) for n, t in FIELDS],
        T.StructField("late", T.BooleanType())])


class _StructureProcessor(InOrder):
    """Keeps a ``LiveStructure`` per symbol, fed in order of time."""

    def __init__(self, rows: T.StructType, hold: int, make: Callable[[], LiveStructure]):
        super().__init__(rows, live_schema(), ["us"], hold)
        self.make = make

    def start(self, handle):
        self.kept = handle.getValueState("fold", "text string")

    def handleInitialState(self, key, initialState, timerValues):
        self.kept.update((initialState["text"].iloc[0],))

    def load(self):
        self.live = self.make()
        if self.kept.exists():
            self.live.load(self.kept.get()[0])

    def save(self):
        self.kept.update((self.live.save(),))

    def feed(self, frame):
        return self.live.feed(frame.astype({"high": "float64", "low": "float64", "close": "float64"}))


def _rows(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", F.unix_seconds("ts").alias("time"), "high", "low", "close")


def stream_structure(bars: DataFrame, make: Callable[[], LiveStructure] = LiveStructure,
                     warm: DataFrame | None = None, delay: str = "1 minute") -> DataFrame:
    """Swings and breaks of a bar stream; ``warm`` (symbol, text) starts it mid-way.

    Bars may arrive in any order: they wait until event time is ``delay`` past them. What comes later than
    that is a row with ``late`` set and no fields, and leaves the rest as it was.
    """
    hold = milliseconds(delay)
    return in_order(_rows(bars), lambda rows: _StructureProcessor(rows, hold, make), warm)


def warm_state(bars: DataFrame, make: Callable[[], LiveStructure] = LiveStructure) -> DataFrame:
    """Silent replay of past bars: the state a stream would hold after them, per symbol."""
    schema = "symbol string, text string"

    def run(batches):
        current, live = None, None
        for frame in batches:
            for symbol, piece in frame.groupby("symbol", sort=False):
                if symbol != current:
                    if live is not None:
                        yield pd.DataFrame({"symbol": [current], "text": [live.save()]})
                    current, live = symbol, make()
                live.feed(piece)
        if live is not None:
            yield pd.DataFrame({"symbol": [current], "text": [live.save()]})

    return (_rows(bars).repartition("symbol").sortWithinPartitions("symbol", "time")
            .mapInPandas(run, schema))


class _QuoteProcessor(InOrder):
    """Holds the last known bid and ask per symbol and stamps them on trades."""

    def __init__(self, rows: T.StructType, hold: int):
        super().__init__(rows, T.StructType.fromDDL(
            "symbol string, time long, seq long, kind int, price double, bid double, ask double, late boolean"), ["us", "kind", "seq"], hold)

    def start(self, handle):
        self.kept = handle.getValueState("quote", "bid double, ask double")

    def load(self):
        self.known = dict(zip(("bid", "ask"), self.kept.get() if self.kept.exists() else (None, None)))

    def save(self):
        self.kept.update((self.known["bid"], self.known["ask"]))

    def frame(self, rows):
        """Whole columns instead of plain values; numbers that may be missing stay whole."""
        return rows.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)

    def feed(self, frame):
        for side, value in self.known.items():
            frame[side] = frame[side].ffill()
            if value is not None:
                frame[side] = frame[side].fillna(value)
            last = frame[side].iloc[-1]
            self.known[side] = None if pd.isna(last) else float(last)
        return frame[frame["kind"] == 1]


def stream_prevailing(merged: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Trades of a merged stream (symbol, ts, time, kind 0 quote / 1 trade, seq, price, bid, ask) with the prevailing
    quote of each side, whatever order both arrive in.

    A trade leaves once event time is ``delay`` past it. Trades and quotes that come later are rows with ``late``
    set, as they came; a late quote changes no trade.
    """
    hold = milliseconds(delay)
    return in_order(merged, lambda rows: _QuoteProcessor(rows, hold))


def closing(rows: DataFrame) -> DataFrame:
    """One row of a symbol of its own, a year on: it moves event time past all others and never leaves itself."""
    last = rows.agg(F.max("ts")).select(F.lit("~").alias("symbol"), (F.col("max(ts)") + F.expr("INTERVAL 1 YEAR")).alias("ts"))
    return rows.limit(0).unionByName(last, allowMissingColumns=True).select(rows.columns)


def replay(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Play stored rows through a stream: each slice arrives, the stream catches up and stops,
    and the next start goes on from its checkpoint. Returns what the sink holds at the end."""
    home = shared_folder(spark).rstrip("/") + "/replay-" + np.random.default_rng().bytes(8).hex()
    schema = slices[0].schema
    for rows in slices:
        rows.write.mode("append").parquet(f"{home}/in")
        query = (build(spark.readStream.schema(schema).parquet(f"{home}/in"))
                 .writeStream.format("parquet").option("path", f"{home}/out")
                 .option("checkpointLocation", f"{home}/log").outputMode("append")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(f"{home}/out")
