"""Ordered folds: the few operators whose state depends on the whole path before them.

A fold is a small object with ``feed(frame) -> frame``, ``save() -> str`` and ``load(str)``.
Spark partitions and sorts; the fold sees one series at a time in Arrow batches, so its memory
is one batch plus its own state. The same object serves batch and streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.series import settle


def _pieces(frame: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Split a frame sorted by ``keys`` where a key changes."""
    if not len(frame):
        return
    changed = np.zeros(len(frame), dtype=bool)
    for k in keys:
        col = frame[k].to_numpy()
        changed[1:] |= col[1:] != col[:-1]
    cuts = [0, *np.flatnonzero(changed).tolist(), len(frame)]
    for a, b in zip(cuts, cuts[1:]):
        piece = frame.iloc[a:b]
        yield tuple(piece[k].iloc[0] for k in keys), piece


def _gather(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole keys per partition, sorted. The partition count is named, so that small rows with
    costly folds are not merged into few tasks by their size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 make: Callable[[], object], schema: T.StructType) -> DataFrame:
    """Run one fold per key, rows in ``order``. Output columns are exactly ``schema``.

    A fold with a ``finish() -> frame`` is asked for its remaining rows when its key ends.
    """
    names = schema.fieldNames()
    keys = list(keys)

    def rest(fold, key):
        out = fold.finish() if hasattr(fold, "finish") else ()
        if len(out):
            yield out.assign(**dict(zip(keys, key)))[names]

    def run(batches):
        current, fold = None, None
        for frame in batches:
            for key, piece in _pieces(frame, keys):
                if key != current:
                    yield from rest(fold, current)
                    current, fold = key, make()
                out = fold.feed(piece)
                if len(out):
                    yield out[names]
        yield from rest(fold, current)

    return _gather(df, keys, order).mapInPandas(run, schema)


def chunked_fold(df: DataFrame, keys: Sequence[str], number: str, make: Callable[[], object],
                 schema: T.StructType, block: int) -> DataFrame:
    """``ordered_fold`` with every series cut into blocks that run at the same time, exactly.

    Each block first starts from an empty state. Its end state becomes the next block's start;
    blocks whose start changed run again, until no start changes. Then every start is right
    (the first block's always was, and each one follows from the one before), and the rows
    are produced. Folds that forget their start soon settle in two or three rounds; one that
    never does still ends, after at most as many rounds as blocks.
    """
    keys = list(keys)
    by = [*keys, "_block"]
    data = settle(df.withColumn("_block", F.floor(F.col(number) / block)))
    key_fields = [f for f in data.schema.fields if f.name in by]
    end_schema = T.StructType([*key_fields, T.StructField("_end", T.StringType())])

    def ends(batches):
        current, fold = None, None
        for frame in batches:
            for key, piece in _pieces(frame, by):
                if key != current:
                    if fold is not None:
                        yield pd.DataFrame([[*current, fold.save()]], columns=[*by, "_end"])
                    current, fold = key, make()
                    start = piece["_start"].iloc[0]
                    if isinstance(start, str):
                        fold.load(start)
                fold.feed(piece)
        if fold is not None:
            yield pd.DataFrame([[*current, fold.save()]], columns=[*by, "_end"])

    def run_ends(rows: DataFrame) -> DataFrame:
        return _gather(rows, by, [number]).mapInPandas(ends, end_schema)

    before = Window.partitionBy(*keys).orderBy("_block")
    none = F.lit(None).cast("string")
    state = settle(run_ends(data.withColumn("_start", none)).withColumn("_start", none))
    while True:
        wanted = state.withColumn("_want", F.lag("_end").over(before))
        stale = settle(wanted.where(~F.col("_want").eqNullSafe(F.col("_start")))
                       .select(*by, F.col("_want").alias("_start")))
        if stale.isEmpty():
            break
        fresh = run_ends(data.join(stale, by)).join(stale, by)
        state = settle(state.join(stale, by, "left_anti").unionByName(fresh))

    names = schema.fieldNames()

    def produce(batches):
        current, fold = None, None
        for frame in batches:
            for key, piece in _pieces(frame, by):
                if key != current:
                    current, fold = key, make()
                    start = piece["_start"].iloc[0]
                    if isinstance(start, str):
                        fold.load(start)
                out = fold.feed(piece)
                if len(out):
                    yield out[names]

    return _gather(data.join(state.select(*by, "_start"), by), by, [number]).mapInPandas(produce, schema)
