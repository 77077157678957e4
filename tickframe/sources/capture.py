"""Captured live events: JSON lines of trades and quotes, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.schemas import CAPTURE, LIVE_QUOTE, LIVE_TRADES

TRADE_EVENT, QUOTE_EVENT = "GatewayTrade", "GatewayQuote"
BROKEN = "_corrupt_record"


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE).json(path)


def stream_capture(spark: SparkSession, path: str) -> DataFrame:
    """Captured lines as they arrive; a line that is no JSON object stands in ``BROKEN`` with all else null."""
    schema = T.StructType([*CAPTURE.fields, T.StructField(BROKEN, T.StringType())])
    return spark.readStream.schema(schema).option("columnNameOfCorruptRecord", BROKEN).json(path)


def _told(events: DataFrame) -> Column:
    """Whether an event can be used: whole, with an arrival time, and with a payload its kind allows."""
    payload = F.col("payload")
    body = F.when(payload.rlike(r"^\s*\["), F.get_json_object(payload, "$[1]")).otherwise(payload)
    fine = (F.when(F.col("event") == TRADE_EVENT, F.from_json(_listed(payload), LIVE_TRADES).isNotNull())
            .when(F.col("event") == QUOTE_EVENT, F.from_json(body, LIVE_QUOTE)["lastUpdated"].isNotNull()).otherwise(True))
    corrupt = F.col(BROKEN).isNotNull() if BROKEN in events.columns else F.lit(False)
    return ~corrupt & F.col("recv").try_cast("timestamp").isNotNull() & F.col("event").isNotNull() & F.coalesce(fine, F.lit(False))


def broken(events: DataFrame) -> DataFrame:
    """The lines that cannot be used, as they came."""
    return events.where(~_told(events))


def once(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Usable events, each once: one sent again (after a reconnect, say) within ``delay`` of its first arrival is left out.

    Equal are events of the same kind, contract and payload. State is kept no longer than ``delay``.
    """
    return (events.where(_told(events)).withColumn("arrived", F.col("recv").cast("timestamp")).withWatermark("arrived", delay)
            .dropDuplicatesWithinWatermark(["event", "contract", "payload"]))


def ingest(events: DataFrame, out: str, log: str, delay: str = "10 minutes", trigger: dict | None = None) -> list:
    """Start the two queries of a capture: trades and quotes, each once, and the broken lines, as tables under ``out``.

    A batch that is run again after a failure replaces what it wrote the first time.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("trades", trades(batch)), ("quotes", quotes(batch))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    told = trigger or {"processingTime": "10 seconds"}
    good = once(events, delay).writeStream.foreachBatch(store).option("checkpointLocation", f"{log}/events").trigger(**told).start()
    bad = (broken(events).writeStream.format("parquet").option("path", f"{out}/broken")
           .option("checkpointLocation", f"{log}/broken").trigger(**told).start())
    return [good, bad]


def _listed(payload: Column) -> Column:
    """The list of a trade payload: the payload itself or the second of ``[contract, list]``."""
    return F.when(payload.rlike(r'^\s*\[\s*"'), F.get_json_object(payload, "$[1]")).otherwise(payload)


def trades(events: DataFrame) -> DataFrame:
    """One row per trade: an event carries a list of them.

    The payload is the list itself or ``[contract, list]``. The aggressor is the trade's own
    ``type`` (0 bought, 1 sold), never guessed from a quote.
    """
    listed = _listed(F.col("payload"))
    rows = (events.where(F.col("event") == TRADE_EVENT)
            .select("recv", "contract", F.posexplode(F.from_json(listed, LIVE_TRADES)).alias("at", "t")))
    return rows.select(
        F.col("contract").alias("symbol"), F.col("t.timestamp").cast("timestamp").alias("ts"),
        "recv", "at", F.col("t.price").alias("price"), F.col("t.volume").alias("volume"),
        F.when(F.col("t.type") == 0, 1).when(F.col("t.type") == 1, -1).otherwise(0)
         .cast("long").alias("side"))


def quotes(events: DataFrame) -> DataFrame:
    """Quote changes; a side that was not sent is null. Event time is ``lastUpdated``."""
    text = F.col("payload")
    body = F.when(text.rlike(r'^\s*\['), F.get_json_object(text, "$[1]")).otherwise(text)
    q = F.from_json(body, LIVE_QUOTE)
    return (events.where(F.col("event") == QUOTE_EVENT).select("contract", q.alias("q"))
            .select(F.col("contract").alias("symbol"), F.col("q.lastUpdated").cast("timestamp").alias("ts"),
                    F.col("q.bestBid").alias("bid"), F.col("q.bestAsk").alias("ask")))
