"""The given tables seen as market data: ``events`` becomes trades with quotes.

Prices are a walk of integer ticks, so they are exact; ``ts`` is cut to the minute, which makes
timestamp ties that only ``seq`` resolves; ``adj`` has roll segments; every tenth print sits
between the quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import bars as B
from tickframe.operators.series import Running, running, settle

TEST_WINDOW = 7200      # scale and recent window on this data, seconds
SEALED_FROM = "2024-01-21 00:00:00"
POINT_VALUE = 20.0
STEP = 900


def session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    return (spark.read.parquet(f"{sf_dir}/events.parquet")
            .withColumn("ts", F.col("ts").cast("timestamp")))


def ticks(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """Trades of every event; ``by`` is the symbol column, or ``ALL`` for one dense symbol."""
    symbol = F.lit("ALL") if by == "ALL" else F.col(by)
    rows = events(spark, sf_dir).select(
        symbol.alias("symbol"), "ts", F.col("event_id").alias("seq"), "user_id",
        F.floor((F.col("value") - 50.0) / 5.0 + 0.5).cast("long").alias("move"))
    walked = running(rows, ["symbol"], ["ts", "seq"],
                     {"walk": Running("sum", F.col("move"))}, span=3600)
    adj = (F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp"), 0.0)
           .when(F.col("ts") < F.lit("2024-01-21").cast("timestamp"), 211.0).otherwise(481.0))
    price = (F.col("walk") + 80000) * 0.25 + F.col("adj")
    kind = F.pmod(F.col("seq"), F.lit(10))
    return (walked.withColumn("adj", adj).withColumn("price", price)
            .select("symbol", F.date_trunc("minute", "ts").alias("ts"), "seq", "price",
                    (F.col("price") - F.when((kind >= 5) & (kind < 9), 0.0).otherwise(0.25))
                    .alias("bid"),
                    (F.col("price") + F.when(kind < 5, 0.0).otherwise(0.25)).alias("ask"),
                    (1 + F.pmod(F.col("user_id"), F.lit(7))).cast("long").alias("volume"), "adj"))


def bars(spark: SparkSession, sf_dir: str, by: str = "ALL", step: int = STEP) -> DataFrame:
    """Base bars, written once and read back: everything downstream reads them repeatedly."""
    return settle(B.fold_ticks(ticks(spark, sf_dir, by), step))


def levels(spark: SparkSession, sf_dir: str, by: str = "ALL", step: int = STEP) -> DataFrame:
    return settle(B.price_levels(B.back_adjust(ticks(spark, sf_dir, by)), step))
