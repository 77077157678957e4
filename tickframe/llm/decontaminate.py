"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``size`` consecutive benchmark words (an item of fewer is one
window). Per window length m, a shift table on hashed blocks of ``BLOCK`` words tells how far a
cursor may move when a block is in no window, or only further left in one; where it may not
move, the bucket of windows that end in that block selects the test strings, their first block
thins them out, and the words themselves are compared. Cursors of many text spans advance together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.llm import words
from tickframe.operators.series import settle

BLOCK = 2
TABLE = 1 << 20    # entries of a shift table, one byte each
HELD = 64 << 20    # bytes of windows, with what goes with each, that are broadcast at once
NO_ID = -(1 << 63)     # stands for a null item_id while windows are gathered
SPAN = 256         # words a cursor covers


@dataclass
class Patterns:
    """Windows of one length with their shift table and suffix buckets."""

    length: int
    block: int
    texts: list[bytes]
    items: list[list]
    hashes: np.ndarray          # windows x length word hashes, in bucket order
    shift: np.ndarray
    bucket: np.ndarray          # first window of a suffix slot, by position in ``slots``
    slots: np.ndarray           # the suffix slots in use, ascending

    def candidates(self, found: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """End places (exclusive) of windows whose last block ends some test string."""
        m, first, last = self.length, owned[:-1] + self.length, owned[1:]
        spans = np.maximum(0, -(-(last - first + 1) // SPAN))
        row = np.repeat(np.arange(len(first)), spans)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
        cursor = first[row] + nth * SPAN
        limit = np.minimum(cursor + SPAN, last[row] + 1)
        hits = []
        while len(cursor):
            step = self.shift[_slots(found, cursor, self.block)]
            hits.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            alive = cursor < limit
            cursor, limit = cursor[alive], limit[alive]
        return np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)

    def search(self, data, found, starts, ends, owned) -> list[tuple[int, int]]:
        """(first word, window number) of every occurrence."""
        at = self.candidates(found, owned)
        if not len(at):
            return []
        place = np.searchsorted(self.slots, _slots(found, at, self.block))
        sizes = np.diff(self.bucket)[place]
        which = np.repeat(self.bucket[place], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(at, sizes) - self.length
        for k in range(self.length):            # the first words thin the bucket out, the rest confirm
            same = found[at + k] == self.hashes[which, k]
            at, which = at[same], which[same]
        out = []
        for a, w in zip(at.tolist(), which.tolist()):
            text = b" ".join(data[starts[k]:ends[k]].tobytes() for k in range(a, a + self.length)).lower()
            if text == self.texts[w]:
                out.append((a, w))
        return out


def _slots(found: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    total = found[end - block]
    for k in range(block - 1, 0, -1):
        total = total * words.U(words.BASE) + found[end - k]
    return (words.mix(total) & words.U(TABLE - 1)).astype(np.int64)


def compile_patterns(windows: list[tuple[str, list]]) -> list[Patterns]:
    """Tables for windows given as space-joined words with the ids of their items."""
    by_length: dict[int, list[tuple[str, list]]] = {}
    for text, items in windows:
        by_length.setdefault(text.count(" ") + 1, []).append((text, items))
    out = []
    for m, group in sorted(by_length.items()):
        data, limits = words.buffers(pa.array([t for t, _ in group]))
        found, _, _, _ = words.word_hashes(data, limits, "alnum")
        found = found.reshape(-1, m)
        block = min(BLOCK, m)
        shift = np.full(TABLE, m - block + 1, np.uint8)
        for q in range(block, m + 1):           # ascending, so the smallest shift is written last
            shift[_slots(found.T.copy(), np.full(1, q), block)] = m - q
        suffix = _slots(found.T.copy(), np.full(1, m), block).ravel()
        order = np.argsort(suffix, kind="stable")
        slots, first = np.unique(suffix[order], return_index=True)
        out.append(Patterns(m, block, [group[k][0].encode() for k in order], [group[k][1] for k in order],
                            found[order], shift, np.append(first, len(order)), slots))
    return out


def _windows(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                data, limits = words.buffers(pa.array([text], pa.string()))
                _, starts, ends, _ = words.word_hashes(data, limits, "alnum")
                own = [data[a:b].tobytes().lower().decode() for a, b in zip(starts.tolist(), ends.tolist())]
                for k in range(max(1, len(own) - size + 1) if own else 0):
                    ids.append(item)
                    texts.append(" ".join(own[k:k + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())],
                                             names=["item_id", "text"])
    return run


FOUND = "n_words long, n_hit long, hits array<struct<first:long,end:long>>, items array<long>"


def _scan(patterns, others: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = words.buffers(batch.column("text"))
            counts, hit_counts, hits, items = [], [], [], []
            for a, b in words.slices(limits):
                part = data[limits[a]:limits[b]]
                found, starts, ends, owned = words.word_hashes(part, limits[a:b + 1] - limits[a], "alnum")
                mark = np.zeros(len(found) + 1, np.int32)
                own: list[set] = [set() for _ in range(b - a)]
                for p in patterns.value:
                    for at, which in p.search(part, found, starts, ends, owned):
                        mark[at] += 1
                        mark[at + p.length] -= 1
                        own[int(np.searchsorted(owned, at, side="right")) - 1].update(p.items[which])
                hit = np.cumsum(mark[:-1]) > 0
                before = np.concatenate([[0], np.cumsum(hit)])[owned]
                counts += np.diff(owned).tolist()
                hit_counts += np.diff(before).tolist()
                for k in range(b - a):
                    one = hit[owned[k]:owned[k + 1]] if own[k] else hit[:0]
                    edge = np.diff(np.concatenate([[0], one.astype(np.int8), [0]]))
                    hits.append([{"first": x, "end": y} for x, y in zip(
                        np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())])
                    items.append(sorted(own[k] - {NO_ID}, key=str) + [None] * (NO_ID in own[k]))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in others), pa.array(counts, pa.int64()), pa.array(hit_counts, pa.int64()),
                 pa.array(hits, span), pa.array(items, pa.list_(pa.int64()))],
                names=[*others, "n_words", "n_hit", "hits", "items"])
    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, block: int = 2_000_000) -> DataFrame:
    """``docs`` with the words that benchmark windows cover.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence), ``hits`` (those words as merged
    ranges), ``items`` (ids with an occurring window, as sorted strings) and ``contaminated``;
    columns of these names are replaced, others pass through. Null and empty texts have no
    words; a benchmark item without words has no windows. Items with a null id count as one item, a null at
    the end of ``items``. Repeated windows and items count once. An empty benchmark hits nothing, an
    empty corpus gives no rows.

    At most ``block`` windows or ``HELD`` bytes of them are broadcast at once. A larger benchmark is searched in blocks:
    one pass each, the ranges of which are united row by row in the same stage.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hits", "items", "contaminated"]
    docs = docs.drop(*added)
    own = docs.columns
    windows = settle(benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), "text")
                     .mapInArrow(_windows(size), "item_id long, text string")
                     .groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids")))
    count, weight = windows.agg(F.count("*"), F.sum(F.octet_length("text") + 8 * F.size("ids") + 8 * size + 100)).first()
    blocks = max(1, -(-count // block), -(-(weight or 0) // HELD))
    out = docs
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow()
        held = spark.sparkContext.broadcast(
            compile_patterns(list(zip(part["text"].to_pylist(), part["ids"].to_pylist()))))
        names = out.columns
        schema = StructType([*out.schema.fields])
        for field in StructType.fromDDL(FOUND):
            schema.add(field)
        out = out.mapInArrow(_scan(held, names), schema)
        if k + 1 < blocks:
            out = out.select(*own, *(F.col(c) for c in names if c not in own),
                             F.col("hits").alias(f"_hits{k}"), F.col("items").alias(f"_items{k}"))
    for k in range(blocks - 1):
        out = (out.withColumn("hits", F.concat("hits", f"_hits{k}"))
               .withColumn("items", F.array_distinct(F.concat("items", f"_items{k}"))))
    if blocks > 1:
        merged = F.aggregate(
            F.array_sort("hits"), F.lit([]).cast("array<struct<first:long,end:long>>"),
            lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["first"]), F.concat(
                F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))))
            .otherwise(F.concat(done, F.array(x))))
        out = (out.withColumn("hits", merged).withColumn("n_hit", F.aggregate(
            "hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"]))
            .withColumn("items", F.array_sort(F.col("items").cast("array<string>")).cast("array<long>")))
    return out.withColumn("contaminated", F.col("n_hit") > 0).select(*own, *added)


def items_digest(items: list) -> str:
    """The digest of sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(map(str, items)).encode()).hexdigest()
