"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``huge`` characters is cut into chunks that overlap. Each chunk is encoded
with offsets. The scan into pre-tokens runs from left to right and looks one character ahead, so
once a chunk begins a pre-token where the chunk before it also begins one, and that place is
proven (the chunk before goes on past it), both agree from there on: the counts are spliced
there. Where no such place lies in an overlap, that text is done again with a wider overlap, in
the end with one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.tokens import byte_counter, load
from tickframe.operators.series import settle

MARGIN = 64       # characters a place must lie before its chunk's end: a special string and one more
_SPOTS = "array<struct<place:long,before:long>>"


def _chunks(size: int, overlap: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                k, done = 0, False
                while not done:
                    part = text[k * size:(k + 1) * size + overlap]
                    done = (k + 1) * size + overlap >= len(text)
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()),
                                                      "part": [part], "last": [done]})
                    k += 1
    return run


def _spots(path: str, size: int, overlap: int):
    """Per chunk: its tokens, and the pre-tokens that begin in its first and last overlap."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            rows: dict[str, list] = {"key": [], "k": [], "last": [], "tokens": [], "head": [], "tail": []}
            for key, k, part, last in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "part", "last"))):
                code = tokenizer.encode(part, add_special_tokens=False)
                head, tail, previous = [], [], None
                for n, (word, (a, _)) in enumerate(zip(code.word_ids, code.offsets)):
                    if word is not None and word != previous and a:
                        if a < overlap:
                            head.append({"place": k * size + a, "before": n})
                        if size <= a < len(part) - MARGIN:
                            tail.append({"place": k * size + a, "before": n})
                    previous = word
                for name, value in zip(rows, (key, k, last, len(code.ids), head, tail)):
                    rows[name].append(value)
            spots = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), spots, spots)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
    return run


def huge_counts(texts: DataFrame, path: str, *, size: int, overlap: int) -> DataFrame:
    """``texts`` (key, text) → (key, n_tokens), a row per different key."""
    keys, out = texts.select("key", "text"), None
    while True:
        chunks = keys.mapInArrow(_chunks(size, overlap), "key string, k int, part string, last boolean")
        spots = chunks.dropDuplicates(["key", "k"]).mapInArrow(
            _spots(path, size, overlap),
            f"key string, k int, last boolean, tokens long, head {_SPOTS}, tail {_SPOTS}")
        here = settle(spots).selectExpr(
            "*", "lead(head) over (partition by key order by k) as after")
        met = F.array_min(F.array_intersect("tail.place", "after.place"))
        at = lambda spots: F.try_element_at(F.filter(spots, lambda x: x["place"] == F.col("met")), F.lit(1))["before"]
        here = (here.withColumn("met", met).withColumn("leave", F.when(F.col("last"), F.col("tokens")).otherwise(at("tail")))
                .withColumn("enter", F.when(F.col("last"), F.lit(0)).otherwise(at("after"))))
        sums = settle(here.groupBy("key").agg(
            F.sum(F.col("leave") - F.col("enter")).alias("n_tokens"),
            F.bool_or(F.col("leave").isNull() | F.col("enter").isNull()).alias("failed")))
        done = sums.where("not failed").select("key", "n_tokens")
        out = done if out is None else out.unionByName(done)
        if sums.where("failed").isEmpty():
            return out
        keys = settle(keys.join(sums.where("failed").select("key"), "key", "left_semi"))
        overlap *= 8


def _counts(path: str, others: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        counter = byte_counter(path)
        for batch in batches:
            tokens = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(tokens, pa.int64())],
                                             names=[*others, "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, *, limit: int = 1024, huge: int = 1 << 16, size: int = 1 << 15,
                 overlap: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) → doc_id, n_bytes, n_tokens, over_limit; a row per row.

    Counts are those of the byte-level tokenizer at ``path`` without begin, end or added special
    tokens; special strings inside texts are handled as is its default. Null and empty texts have
    0 bytes and 0 tokens. Repeated rows give repeated rows, and equal huge texts are encoded once.
    No rows give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    large = F.coalesce(F.length("text"), F.lit(0)) > huge
    small = docs.where(~large).mapInArrow(_counts(path, ["doc_id", "n_bytes"]), "doc_id long, n_bytes long, n_tokens long")
    long = docs.where(large).withColumn("key", F.md5("text"))
    counted = huge_counts(long, path, size=size, overlap=overlap)
    out = small.unionByName(long.select("doc_id", "n_bytes", "key").join(counted, "key").drop("key"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
