"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Texts are encoded once. Documents are laid out in ranges by a lexical anchor (two minimum hashes
of their token set), so like ones come to the same shard, whatever the sizes of the groups. A
shard is a bounded run of documents with its own inverted index; document frequencies, the number
and the mean length of documents are those of the whole corpus, over the tokenizer's bounded vocabulary.
The next unused document seeds a window; all its terms ask the index of its own shard, which returns its unused
neighbours by BM25 score, and they fill the window in that order; the one that no longer fits is cut, and its rest seeds the next.
What is left of a task's documents goes to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.tokens import word_encoder
from tickframe.operators.series import settle

K1, B = 1.2, 0.75
VOCABULARY = 1 << 16
_RANDOM = np.random.default_rng(12345)
_ORDERS = [_RANDOM.permutation(VOCABULARY).astype(np.uint16) for _ in range(2)]
COUNTED = 256     # documents whose terms are counted by one sort


def _encoded(path: str, end: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_encoder(path), np.array([end], np.uint16).tobytes()
        for batch in batches:
            ids = [encoder.encode(t) + tail for t in batch.column("text").to_pylist()]
            anchors = []
            for x in ids:
                own = np.frombuffer(x, np.uint16)
                anchors.append(int(_ORDERS[0][own].min()) << 16 | int(_ORDERS[1][own].min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()),
                 pa.array(anchors, pa.int64())], names=["doc_id", "ids", "n", "anchor"])
    return run


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the different terms of each document, by one sort of all."""
    kind = np.uint32 if len(docs) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(docs), dtype=kind) << kind(16), [len(x) for x in docs]) | np.concatenate(docs)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    found = keys[first]
    return (found >> kind(16)).astype(np.int64), (found & kind(VOCABULARY - 1)).astype(np.uint16), np.diff(np.append(first, len(keys)))


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    """Documents with each term, summed over the task; -1 and -2 stand for documents and tokens."""
    seen, docs, tokens = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("ids")]
        for at in range(0, len(own), COUNTED):
            seen += np.bincount(_terms(own[at:at + COUNTED])[1], minlength=VOCABULARY)
        docs, tokens = docs + len(own), tokens + sum(map(len, own))
    terms = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(seen[terms], [docs, tokens]))],
                                     names=["term", "df"])


class Shard:
    """A BM25 inverted index over a bounded run of documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None = None):
        owner, terms, tf = _terms(docs)
        starts = np.searchsorted(owner, np.arange(len(docs)))
        size = np.array([len(x) for x in docs])[owner]
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))
        self.queries = [t if query_terms is None else t[np.argsort(-idf[t], kind="stable")[:query_terms]] for t in np.split(terms, starts[1:])]
        self.count = len(docs)
        # the same by document (none is without its end id), for seeds that would read much of the index
        self.terms, self.by_doc = terms, weight
        self.starts = starts

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the seed's terms."""
        query = self.queries[seed]
        a, b = self.first[query], self.first[query.astype(np.int64) + 1]
        size = b - a
        if 8 * size.sum() > len(self.terms):
            asked = np.zeros(VOCABULARY)
            asked[query] = 1
            return np.add.reduceat(asked[self.terms] * self.by_doc, self.starts)
        place = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.owner[place], weights=self.weight[place], minlength=self.count)


def _fill(docs: list[tuple], shard: Shard, length: int, final: bool) -> Iterator[tuple[int, list[tuple]]]:
    """Sequences as (length, pieces (doc, start, length)); yields last what stays unused."""
    sizes = [len(x) for _, x, _ in docs]
    begin = [s for _, _, s in docs]
    total = sum(n - s for n, s in zip(sizes, begin))
    unused, cursor, carry = np.ones(len(docs), bool), 0, None
    while total >= length or (final and total):
        room = length if total >= length else 1 << (total.bit_length() - 1)
        goal, pieces, seed, ranked = room, [], carry, None
        if seed is None:
            while not unused[cursor]:
                cursor += 1
            seed = cursor
        take, carry = seed, None
        while room:
            unused[take] = False
            used = min(room, sizes[take] - begin[take])
            pieces.append((take, begin[take], used))
            begin[take] += used
            room -= used
            if begin[take] < sizes[take]:
                carry = take
                break
            if room:
                if ranked is None:
                    scores = shard.scores(seed)
                    free = np.flatnonzero(unused)
                    ranked = iter(free[np.argsort(-scores[free], kind="stable")].tolist())
                take = next(ranked)
        total -= goal
        yield goal, pieces
    rest = np.flatnonzero(unused).tolist()
    yield 0, [(k, begin[k], 0) for k in ([carry] if carry is not None else []) + rest]


def _packed(length: int, shard_tokens: int, query_terms: int | None, known):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, mean = known.value
        sequence = TaskContext.get().partitionId() << 32
        pool: list[tuple] = []

        def pack(final: bool):
            nonlocal pool, sequence
            shard = Shard([x for _, x, _ in pool], idf, mean, query_terms)
            rows: list[tuple] = []
            for size, pieces in _fill(pool, shard, length, final):
                if not size:
                    pool = [(pool[k][0], pool[k][1], s) for k, s, _ in pieces]
                    break
                offset = 0
                for k, start, used in pieces:
                    doc, ids, _ = pool[k]
                    rows.append((doc, start, used, ids[start:start + used].astype("<u4").tobytes(), len(ids),
                                 sequence, offset, size))
                    offset += used
                sequence += 1
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at:at + 4096]))
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[
                    "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        held = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                pool.append((doc, np.frombuffer(ids.as_py(), np.uint16), 0))
                held += len(pool[-1][1])
                if held >= shard_tokens:
                    yield from pack(False)
                    held = sum(len(x) - s for _, x, s in pool)
        if pool:
            yield from pack(True)
    return run


def pack_documents(docs: DataFrame, path: str, *, length: int = 4096, end: int = 2, shard_tokens: int = 1 << 20,
                   query_terms: int | None = None, spread: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) → a row per piece of a document in a packed sequence.

    Columns: doc_id, start (its document's ids before it), length, ids (little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset in the sequence, sequence_length.
    Every id of every document is in exactly one piece. Sequences are full, except at the end of a
    task's documents, where their lengths are powers of two; so nothing is padded. Null and
    empty texts are the end id alone. Repeated rows are packed each for themselves. No rows give
    no rows; other columns are ignored. ``spread``: ranges the documents are laid out in.
    A seed asks with all its terms, or with the ``query_terms`` of highest idf; it asks its own shard only.
    """
    spark = docs.sparkSession
    coded = settle(docs.select("doc_id", "text").mapInArrow(
        _encoded(path, end), "doc_id long, ids binary, n long, anchor long"))
    found = coded.select("ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    table = dict(zip(*found.toArrow().to_pydict().values()))      # at most the vocabulary and two rows
    count, tokens = table.pop(-1, 0), table.pop(-2, 0)
    df = np.zeros(VOCABULARY)
    df[list(table)] = list(table.values())
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    known = spark.sparkContext.broadcast((idf, max(1.0, tokens / max(count, 1))))
    parts = spread or max(1, -(-tokens // (4 * shard_tokens)))
    laid = coded.withColumn("salt", F.xxhash64("doc_id", F.crc32("ids"))).repartitionByRange(
        parts, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    return laid.select("doc_id", "ids").mapInArrow(
        _packed(length, shard_tokens, query_terms, known),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
        "sequence_length long")
