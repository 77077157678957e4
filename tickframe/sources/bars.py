"""Bar, tick and level tables on Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe import config
from tickframe.schemas import FLOW, OHLC

TICK_COLUMNS = ("ts", "price", "bid", "ask", "volume", "adj")


def has_flow(df: DataFrame) -> bool:
    """Order flow is there only when all four columns are."""
    return set(FLOW) <= {c.lower() for c in df.columns}


def normalise(raw: DataFrame, time: str = "ts", zone: str | None = None) -> DataFrame:
    """Lower-case names, require OHLCV, keep flow columns or null them, drop the rest.

    ``zone`` is the zone of wall-clock stamps; without it they are UTC already. NaN becomes null.
    """
    named = raw.toDF(*[c.lower() for c in raw.columns])
    missing = [c for c in (time.lower(), *OHLC, "volume") if c not in named.columns]
    if missing:
        raise ValueError(f"bars lack {missing}")
    ts = F.col(time.lower()).cast("timestamp")
    ts = F.to_utc_timestamp(ts, zone) if zone else ts
    keys = [c for c in ("symbol", "timeframe") if c in named.columns]
    flow = FLOW if has_flow(named) else ()

    def clean(c: str, kind: str):
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value).cast(kind).alias(c)

    return named.select(
        *keys, ts.alias("ts"), *[clean(c, "double") for c in OHLC], clean("volume", "long"),
        *[clean(c, "long") if c in flow else F.lit(None).cast("long").alias(c) for c in FLOW])


def write_bars(bars: DataFrame, root: str) -> None:
    """One partition per symbol and timeframe; only partitions present in ``bars`` are replaced."""
    (bars.repartition("symbol", "timeframe", F.to_date(F.date_trunc("month", "ts")))
     .sortWithinPartitions("symbol", "timeframe", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol", "timeframe").parquet(root))


def read_bars(spark: SparkSession, root: str, symbol: str | None = None,
              timeframe: str | None = None) -> DataFrame:
    """Stored bars; symbol and timeframe prune partitions. A dataset that is not there is an error."""
    if timeframe is not None and timeframe not in config.TIMEFRAMES:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    out = spark.read.parquet(root)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    if timeframe is not None:
        out = out.where(F.col("timeframe") == timeframe)
    if (symbol is not None or timeframe is not None) and out.isEmpty():
        raise LookupError(f"no bars of {symbol or 'any symbol'}, {timeframe or 'any timeframe'} in {root}")
    return out


def read_ticks(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Ticks with ``file`` and ``seq``, their row in it - the only order equal stamps have.

    Several files count in name order. Only the needed columns are read, and no tick is moved.
    """
    raw = spark.read.parquet(path)
    name = F.lit(symbol) if symbol is not None else F.col("symbol")
    return raw.select(name.alias("symbol"), *TICK_COLUMNS, F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.row_index").alias("seq"))


def write_levels(levels: DataFrame, root: str) -> None:
    """Volume at price by symbol and day, sorted so that row groups prune by time."""
    day = F.to_date(F.timestamp_micros(F.unix_micros("ts") - 1))
    (levels.withColumn("day", day).repartition("symbol", "day")
     .sortWithinPartitions("symbol", "day", "ts", "tick")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol", "day").parquet(root))


def read_levels(spark: SparkSession, root: str, symbol: str | None = None) -> DataFrame:
    out = spark.read.parquet(root)
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def with_instrument(df: DataFrame, specs: dict = config.INSTRUMENTS) -> DataFrame:
    """Tick size, tick value and point value per symbol; an unknown symbol is an error."""
    known = F.create_map(*[x for s, v in specs.items() for x in (
        F.lit(s), F.struct(*[F.lit(n).alias(c) for c, n in zip(
            ("tick_size", "tick_value", "point_value"), v)]))])
    spec = F.element_at(known, F.col("symbol"))
    checked = F.coalesce(spec, F.raise_error(F.concat(F.lit("unknown instrument "), F.col("symbol")))
                         .cast(_spec_type()))
    return df.withColumn("_spec", checked).select(*df.columns, "_spec.*")


def _spec_type():
    return "struct<tick_size:double,tick_value:double,point_value:double>"


def columns_for(groups: dict[str, Sequence[str]], only: Sequence[str] | None = None,
                details: Sequence[str] = ()) -> list[str]:
    """Columns of the chosen feature groups behind the bar columns; detail columns stay hidden."""
    unknown = set(only or ()) - set(groups)
    if unknown:
        raise ValueError(f"unknown groups {sorted(unknown)}")
    chosen = groups if only is None else {g: groups[g] for g in groups if g in set(only)}
    return ["symbol", "ts", *OHLC, "volume",
            *[f for fields in chosen.values() for f in fields if f not in set(details)]]
