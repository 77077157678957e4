"""Static schemas. Optional order-flow columns are nullable: absent is null, never zero."""

from pyspark.sql import types as T

TICK = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("adj", T.DoubleType()),
])

OHLC = ("open", "high", "low", "close")
FLOW = ("delta", "buy_volume", "sell_volume", "trades")

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in OHLC]
    + [T.StructField("volume", T.LongType())]
    + [T.StructField(name, T.LongType()) for name in FLOW]
)

LEVEL = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tick", T.LongType()),
    T.StructField("volume", T.LongType()),
    T.StructField("buy", T.LongType()),
])

# One captured market event per JSON line; the payload stays text until its kind is known.
CAPTURE = T.StructType([
    T.StructField("recv", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("contract", T.StringType()),
    T.StructField("payload", T.StringType()),
])

LIVE_TRADES = T.ArrayType(T.StructType([
    T.StructField("symbolId", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("volume", T.LongType()),
]))

LIVE_QUOTE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("bestBid", T.DoubleType()),
    T.StructField("bestAsk", T.DoubleType()),
    T.StructField("lastUpdated", T.StringType()),
])
