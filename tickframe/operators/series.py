"""Ordered computations over long series without putting a series into one task.

Two tools cover every per-series window in the library:

* ``running`` - unbounded running values (sum, max, min, last, previous). Each series is cut
  into time slices; slices are folded in parallel, one summary row per slice is scanned in
  order, and the carry is joined back. Exact, whatever the slice length.
* ``in_blocks`` - bounded look-back windows. Rows are numbered, cut into equal blocks, and
  each block is handed copies of the rows just before it.

Both therefore split a hot symbol over many tasks. Only slice summaries (one row per series
and slice, so bounded by the calendar) are ever ordered within a whole series.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 7 * 86400        # slice length of `running`, seconds
BLOCK = 16384           # rows per block of `in_blocks`


def secs(ts: str | Column = "ts") -> Column:
    """Whole epoch seconds of a timestamp column."""
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


class Running(NamedTuple):
    """One running value: ``kind`` is sum, max, min, last (non-null) or prev (previous row)."""

    kind: str
    value: Column
    before: bool = False      # leave the current row out


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _local(spec: Running, order_w, frame):
    if spec.kind == "prev":
        return F.lag(F.struct(spec.value.alias("v"))).over(order_w)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(frame)
    return _AGG[spec.kind](spec.value).over(frame)


def _summary(spec: Running, at: Column):
    if spec.kind == "prev":
        return F.max_by(spec.value, at)
    if spec.kind == "last":
        return F.max_by(spec.value, F.when(spec.value.isNotNull(), at))
    return _AGG[spec.kind](spec.value)


def _carry(spec: Running, column: str, slices, frame):
    if spec.kind == "prev":
        return F.lag(column).over(slices)
    if spec.kind == "last":
        return F.last(column, ignorenulls=True).over(frame)
    return _AGG[spec.kind](column).over(frame)


def _combine(spec: Running, local: str, carry: str):
    a, b = F.col(local), F.col(carry)
    if spec.kind == "prev":
        return F.when(a.isNotNull(), a["v"]).otherwise(b)
    if spec.kind == "last":
        return F.coalesce(a, b)
    if spec.kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if spec.kind == "max" else F.least(a, b)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            specs: dict[str, Running], *, time: str = "ts", span: int = SPAN) -> DataFrame:
    """Add one running column per spec, in ``order`` within ``keys``.

    ``time`` must be the leading sort column (or agree with it): it assigns the slice.
    """
    sliced = df.withColumn("_slice", F.floor(secs(time) / span))
    by = [*keys, "_slice"]
    order_w = Window.partitionBy(*by).orderBy(*order)
    frames = {False: order_w.rowsBetween(Window.unboundedPreceding, 0),
              True: order_w.rowsBetween(Window.unboundedPreceding, -1)}
    local = sliced.select("*", *[
        _local(s, order_w, frames[s.before]).alias(f"_l_{n}") for n, s in specs.items()])
    # One long as the sort key keeps the summary a hash aggregation.
    at = F.unix_micros(time) if list(order) == [time] else F.struct(*order)
    totals = sliced.groupBy(*by).agg(*[
        _summary(s, at).alias(f"_t_{n}") for n, s in specs.items()])
    slices = Window.partitionBy(*keys).orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, *[
        _carry(s, f"_t_{n}", slices, earlier).alias(f"_c_{n}") for n, s in specs.items()])
    keep = [c for c in df.columns if c not in specs]
    return local.join(carried, by, "left").select(*keep, *[
        _combine(s, f"_l_{n}", f"_c_{n}").alias(n) for n, s in specs.items()])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",), *,
                name: str = "bar_no", time: str = "ts", span: int = SPAN) -> DataFrame:
    """Zero-based position of each row in its series."""
    counted = running(df, keys, order, {name: Running("sum", F.lit(1).cast("long"))},
                      time=time, span=span)
    return counted.withColumn(name, F.col(name) - 1)


def in_blocks(df: DataFrame, keys: Sequence[str], lookback: int,
              compute: Callable[[DataFrame, list[str]], DataFrame], *,
              number: str = "bar_no", block: int | None = None) -> DataFrame:
    """Run ``compute(rows, partition columns)`` where windows reach ``lookback`` rows back.

    ``df`` carries the row number. Every block also sees the ``lookback`` rows before it;
    those copies are dropped again afterwards, so the output has the rows of ``df``.
    """
    block = max(BLOCK if block is None else block, lookback)
    n = F.col(number)
    home = F.floor(n / block)
    spread = (df.withColumn("_home", home)
              .withColumn("_block", F.explode(
                  F.when(F.pmod(n, F.lit(block)) >= block - lookback,
                         F.array(home, home + 1)).otherwise(F.array(home)))))
    done = compute(spread, [*keys, "_block"])
    return done.where("_block = _home").drop("_block", "_home")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local session gets a temporary one;
    on a cluster that is an error, as executors could not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tickframe-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def settle(df: DataFrame, *partitions: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, work is done once.

    Used where several branches read the same intermediate (base bars, fold states). The table
    survives lost executors and is read back with column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
