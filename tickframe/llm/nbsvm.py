"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model.

A text's features are which n-grams it holds, of two streams: its words (lower-cased) and their shapes
(kinds of characters with repeats left out, and whether a word repeats the one before it). N-grams are hashed into
2 ** ``BITS`` features. The log-count ratio of every feature is counted over all labelled texts. On a bounded
sample of them the weights are fitted by dual coordinate descent on ratio-scaled indicators of length one, and
margins of the part of the sample not fitted on are turned to probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.llm import words
from tickframe.operators.series import settle

BITS = 17
LABELS = 2_000_000                    # up to so many labels go to the texts; more, and labelled texts go to them
GRAMS = {"words": 2, "shapes": 3}     # the longest n-gram of each stream
_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58] = 48                     # digits
_KIND[65:91] = 65                     # capitals
_KIND[97:123] = 97                    # small letters and every byte beyond ASCII
_KIND[128:] = 97
_KIND[[9, 10, 11, 12, 13]] = 32


def shapes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of texts in which characters are their kinds, each run of one kind once."""
    kinds = _KIND[data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[limits[:-1][limits[:-1] < len(kinds)]] = True
    return kinds[keep], np.concatenate([[0], np.cumsum(keep)])[limits]


def _grams(hashes: np.ndarray, owned: np.ndarray, most: int, stream: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of every n-gram of up to ``most`` words, within rows."""
    row = np.repeat(np.arange(len(owned) - 1), np.diff(owned))
    for n in range(1, most + 1):
        every = words.windows(hashes, n)
        inside = row[:len(every)] == row[n - 1:]
        yield row[:len(every)][inside], (words.mix(every[inside] + np.uint64(16 * stream + n)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each row, sorted, and the rows' limits among them."""
    hashes, _, _, owned = words.word_hashes(data, limits)
    kinds, cuts = shapes(data, limits)
    shaped, _, _, shape_owned = words.word_hashes(kinds, cuts, lower=False)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[owned[:-1][owned[:-1] < len(hashes)]] = False
    shaped = np.where(again, np.uint64(1), shaped)
    pairs = [*_grams(hashes, owned, GRAMS["words"], 0), *_grams(shaped, shape_owned, GRAMS["shapes"], 1)]
    keys = np.unique(np.concatenate([r << BITS | f for r, f in pairs]))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(len(limits)))


def _featured(batch: pa.RecordBatch, text: str):
    """(first row, features, limits) of a batch's rows, slice by slice."""
    data, limits = words.buffers(batch.column(text))
    for a, b in words.slices(limits):
        yield (a, *features(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]))


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Per task: texts of either class with each feature; feature -1 counts the texts."""
    seen, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        good = batch.column("quality").to_numpy(zero_copy_only=False).astype(np.int64)
        texts += np.bincount(good, minlength=2)
        for a, found, cuts in _featured(batch, "text"):
            row = np.repeat(good[a:a + len(cuts) - 1], np.diff(cuts))
            for k in (0, 1):
                seen[k] += np.bincount(found[row == k], minlength=1 << BITS)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], texts[0])),
                                      pa.array(np.append(seen[1][at], texts[1]))], names=["feature", "bad", "good"])


def _listed(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for _, found, cuts in _featured(batch, "text"):
            lists += [found[x:y].astype(np.int32) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(lists, pa.list_(pa.int32()))], names=["quality", "features"])


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, cost: np.ndarray, size: int, *,
                 rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost * max(0, 1 - target * w x), by coordinate descent in the dual.

    ``rows`` are (places, values) of each x. Ends when no projected gradient of a round exceeds ``tolerance``.
    """
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for k in order.permutation(len(rows)).tolist():
            at, value = rows[k]
            if not square[k]:
                continue
            slope = target[k] * float(weights[at] @ value) - 1
            open_ = min(slope, 0) if alpha[k] <= 0 else max(slope, 0) if alpha[k] >= cost[k] else slope
            if open_:
                worst = max(worst, abs(open_))
                moved = min(max(alpha[k] - slope / square[k], 0.0), cost[k])
                weights[at] += (moved - alpha[k]) * target[k] * value
                alpha[k] = moved
        if worst < tolerance:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) of the logistic of the margin that fits weighted outcomes, pulled to even odds by one text a class."""
    n = [float(weight[good == k].sum()) for k in (0, 1)]
    goal = np.where(good == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    theta = np.array([1.0, np.log((n[1] + 1) / (n[0] + 1))])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (p - goal))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


@dataclass
class QualityModel:
    """``ratio`` scales indicators, ``weights`` (with the bias last) give margins, ``slope`` and ``offset`` scores.

    Where labels knew one class or none, ``constant`` is every text's score.
    """

    ratio: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def row(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text: ratio-scaled indicators of length one, and the bias."""
        value = self.ratio[found]
        length = np.sqrt(value @ value)
        return np.append(found, len(self.ratio)), np.append(value / length if length else value, 1.0)

    def margins(self, found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        value = self.ratio[found]
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        sums = lambda x: np.bincount(row, weights=x, minlength=len(cuts) - 1).astype(float)
        length = np.sqrt(sums(value * value))
        told = sums(value * self.weights[found])
        return np.divide(told, length, out=np.zeros_like(told), where=length > 0) + self.weights[-1]

    def scores(self, found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(cuts) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(found, cuts) + self.offset, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 3000, smooth: float = 1.0, cost: float = 1.0) -> QualityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Ratios count every labelled text; they are at most 2 ** BITS numbers. Weights and probabilities are fitted on at most
    ``rows`` texts of either class, the first by a hash of id and text, every third for the probabilities,
    weighted to the classes' shares. A doc_id's repeated labels count as the smallest; rows without id or label take no
    part; repeated documents count each; null texts hold nothing. With one class the score is 1 or 0, without labels a half.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = settle(known)
    if known.count() <= LABELS:
        known = F.broadcast(known)
    docs = docs.select("doc_id", "text")
    told = docs.join(known, "doc_id")
    counts = (told.select("text", "quality").mapInArrow(_counted, "feature long, bad long, good long")
              .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow())
    table = np.zeros((2, 1 << BITS))
    at = counts["feature"].to_numpy()
    texts = np.zeros(2)
    for k, name in enumerate(("bad", "good")):
        value = counts[name].to_numpy()
        table[k][at[at >= 0]], texts[k] = value[at >= 0], value[at < 0].sum()
    if not texts.all():
        return QualityModel(constant=0.5 if not texts.any() else float(texts[1] > 0))
    table += smooth
    model = QualityModel(ratio=np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum()))

    mark = docs.withColumn("_at", F.xxhash64("doc_id", "text")).select("doc_id", "_at").join(known, "doc_id")
    first = [mark.where(F.col("quality") == k).orderBy("_at", "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]).distinct())
    sample = (docs.withColumn("_at", F.xxhash64("doc_id", "text")).join(chosen, ["doc_id", "_at"]).select("quality", "text")
              .mapInArrow(_listed, "quality int, features array<int>").toArrow())
    flat = sample["features"].combine_chunks()
    cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy().astype(np.int64)
    lists = [values[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    good = sample["quality"].to_numpy().astype(np.int64)
    order = np.lexsort((np.array([zlib.crc32(x.tobytes()) for x in lists]), good))       # the same whatever the partitions
    lists, good = [lists[k] for k in order], good[order]
    target, weigh = 2 * good - 1, np.zeros(len(good), bool)
    for k in (0, 1):
        own = np.flatnonzero(good == k)
        weigh[own[2::3] if len(own) > 2 else own] = True
    share = texts / np.maximum(np.bincount(good, minlength=2), 1)
    share = share / share[good].mean()
    data = [model.row(x) for x in lists]
    train = [k for k in range(len(good)) if not weigh[k] or (good == good[k]).sum() < 3]
    model.weights = dual_descent([data[k] for k in train], target[train], np.full(len(train), cost), (1 << BITS) + 1)
    margins = np.array([float(model.weights[a] @ v) for a, v in data])
    model.slope, model.offset = sigmoid_fit(margins[weigh], good[weigh], share[good][weigh])
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` added: the probability, 0 to 1, that a text is of label 1, from the whole text alone.

    Null, empty and wordless texts hold no feature; they get the bias's score. A column called ``score`` is replaced,
    others pass through. Repeated rows score alike. No rows give no rows.
    """
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.scores(found, cuts) for _, found, cuts in _featured(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *out]))],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", "double"))
