"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch with smallest period q and at least 2q words. For every dyadic scale
t a synchronising set picks positions by hash: i is chosen where the least hash of the t-word
windows from i to i + t is that of the first or of the last of them, windows of period t/3 or
less left out. Whether i is chosen depends on the 2t words from i alone, so a run of period 3t <=
q < 6t holds a chosen i whose context stands q words later again, and that place is chosen too:
pairs of chosen places with equal contexts propose the periods, and both ends are then found by
bisection over prefix hashes.

What the choice omits is supplied separately: periods below 6 are read off where words equal
those p back, and where a stretch of a run's period has a small period itself nothing is chosen
in it, which happens only between two neighbouring runs of that small period; their phases give
the periods that can be meant. Every run returned has been compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickframe.llm import words

U = np.uint64
FIRST = 2                      # the first scale; periods below 3 * FIRST are read off directly
_BASE, _BACK = U(words.BASE), U(pow(words.BASE, -1, 1 << 64))


class Sequence:
    """Word symbols with prefix hashes: equal stretches in O(1), common extensions by bisection.

    ``limits`` are the texts' ends; a stretch never leaves its text.
    """

    def __init__(self, symbols: np.ndarray, limits: np.ndarray):
        n = len(symbols)
        self.symbols, self.n = symbols, n
        self.text = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
        self.first, self.end = limits[:-1][self.text], limits[1:][self.text]
        self.grow = np.full(n + 1, _BASE)
        self.grow[:1] = 1
        self.back = np.full(n + 1, _BACK)
        self.back[:1] = 1
        np.multiply.accumulate(self.grow, out=self.grow)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * self.grow[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """One hash for the ``size`` words from each place."""
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of ``size`` words, those across two texts too."""
        count = self.n - size + 1
        return words.mix((self.sums[size:] - self.sums[:count]) * self.back[:count] + U(size))

    def _extend(self, most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            good = equal(middle)
            low = np.where(open_ & good, middle, low)
            high = np.where(open_ & ~good, middle - 1, high)
        return low

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest [start, end) around each place that keeps ``period``; the place and the one
        a period on must be in one text."""
        ahead = self._extend(self.end[at] - at - period, lambda k: self.hashes(at, k) == self.hashes(at + period, k))
        behind = self._extend(at - self.first[at], lambda k: self.hashes(at - k, k) == self.hashes(at + period - k, k))
        return at - behind, at + period + ahead


def least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of every ``reach`` consecutive values, by block minima from both sides."""
    count = len(values) - reach + 1
    blocks = -(-len(values) // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, U)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, reach)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[reach - 1:reach - 1 + count])


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in any of the [start, end)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1]) > 0


def synchronising_set(seq: Sequence, scale: int, runs: np.ndarray) -> np.ndarray:
    """The chosen places of a scale. ``runs`` (start, end, period) holds all runs of small period."""
    most = np.iinfo(np.uint64).max
    hashes = seq.windows(scale)
    np.minimum(hashes, most - U(1), out=hashes)
    dull = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    if len(dull):
        hashes[_covered(len(hashes), dull[:, 0], dull[:, 1] - scale + 1)] = most
    if len(hashes) <= scale:
        return np.zeros(0, np.int64)
    least = least_in_reach(hashes, scale + 1)
    count = len(least)
    chosen = (least < most) & ((hashes[:count] == least) | (hashes[scale:scale + count] == least))
    at = np.flatnonzero(chosen)
    return at[at + 2 * scale <= seq.end[at]]


def _proposed(seq: Sequence, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of chosen places with equal contexts, 3 to 6 scales apart.

    Equal contexts of chosen places are more than a third of a scale apart, so a place has
    fewer than 18 of its own within reach.
    """
    at = synchronising_set(seq, scale, runs)
    context = seq.hashes(at, 2 * scale)
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    places, periods = [], []
    for lag in range(1, len(at)):
        gap = at[lag:] - at[:-lag]
        near = (context[lag:] == context[:-lag]) & (gap < 6 * scale)
        if not near.any():
            break
        near &= (gap >= 3 * scale) & (seq.text[at[lag:]] == seq.text[at[:-lag]])
        places.append(at[:-lag][near])
        periods.append(gap[near])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _between(seq: Sequence, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from neighbouring runs of one small period, 3 to 6 scales long.

    Where nothing is chosen, [s, e - q) lies in one run of a period p <= scale / 3 and [s + q, e) in the next,
    which begins less than p before the first one's end. Their phases fix q modulo p.
    """
    long_ = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= 3 * scale)]
    long_ = long_[np.lexsort((long_[:, 0], long_[:, 2]))]
    places, periods = [], []
    same = (long_[1:, 2] == long_[:-1, 2]) & (long_[1:, 0] <= long_[:-1, 1]) & (long_[1:, 0] > long_[:-1, 1] - long_[1:, 2])
    for k in np.flatnonzero(same).tolist():
        (s1, e1, p), (s2, e2, _) = long_[k].tolist(), long_[k + 1].tolist()
        if seq.text[s1] != seq.text[s2]:
            continue
        phase = np.flatnonzero(seq.hashes(np.arange(s1, s1 + p), p) == seq.hashes(np.array([s2]), p))
        if not len(phase):
            continue
        low, high = 3 * scale, min(6 * scale - 1, e1 - s1, e2 - s2, (e2 - s1) // 2)
        q = np.arange(low + (s2 - s1 - int(phase[0]) - low) % p, high + 1, p)
        places.append(np.maximum(s1, s2 - q))
        periods.append(q)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs over the same words the one of smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs


def _compared(seq: Sequence, runs: np.ndarray) -> np.ndarray:
    """Stretches of two periods or more, word by word: should a hash have lied, one is cut at the
    first word that differs."""
    runs = runs[runs[:, 1] - runs[:, 0] >= 2 * runs[:, 2]]
    for k, (s, e, q) in enumerate(runs.tolist()):
        bad = np.flatnonzero(seq.symbols[s:e - q] != seq.symbols[s + q:e])
        if len(bad):
            runs[k, 1] = s + int(bad[0]) + q
    return runs[runs[:, 1] - runs[:, 0] >= 2 * runs[:, 2]]


def find_runs(symbols: np.ndarray, limits: np.ndarray, least: int = 2) -> np.ndarray:
    """All runs of ``least`` words or more of texts laid one after the other: rows (start, end, period).

    ``symbols`` are 64-bit values, equal for equal words; ``limits`` the texts' ends among them.
    """
    seq = Sequence(symbols, limits)
    found = []
    for p in range(1, 3 * FIRST):
        if p >= seq.n:
            break
        same = (symbols[p:] == symbols[:-p]) & (seq.text[p:] == seq.text[:-p])
        edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        # shorter runs of three periods matter too: nothing is chosen in them
        keep = end - start >= min(max(least, 2 * p), max(4, 3 * p))
        found.append(np.stack([start[keep], end[keep], np.full(keep.sum(), p)], axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = _smallest(runs)
    sizes, scale, left, home, near = np.diff(limits), FIRST, seq, np.arange(seq.n), runs
    while len(sizes) and int(sizes.max()) >= 6 * scale:
        # texts too short for the scale are left behind once they are half of what is left
        wide = sizes >= 6 * scale
        if 2 * int(sizes[wide].sum()) <= left.n:
            keep = np.repeat(wide, sizes)
            home, sizes = home[keep], sizes[wide]
            left = Sequence(left.symbols[keep], np.concatenate([[0], np.cumsum(sizes)]))
            near = runs[np.isin(runs[:, 0], home)].copy()
            near[:, 1] += np.searchsorted(home, near[:, 0]) - near[:, 0]
            near[:, 0] = np.searchsorted(home, near[:, 0])
        at, period = (np.concatenate(x) for x in zip(_proposed(left, scale, near), _between(left, scale, near)))
        if len(at):
            start, end = left.stretch(at, period)
            more = _compared(left, _smallest(np.stack([start, end, period], axis=1)))
            near = _smallest(np.concatenate([near, more]))
            more[:, 1] += home[more[:, 0]] - more[:, 0]
            more[:, 0] = home[more[:, 0]]
            runs = _smallest(np.concatenate([runs, more]))
        scale *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(count: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    return ~_covered(count, runs[:, 0] + runs[:, 2], runs[:, 1])


def _found(others: list[str], text: str, least: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = words.buffers(batch.column(text))
            counts, lists, collapsed = [], [], []
            for a, b in words.slices(limits):
                part = data[limits[a]:limits[b]]
                hashes, starts, ends, owned = words.word_hashes(part, limits[a:b + 1] - limits[a], lower=False)
                runs = find_runs(hashes, owned, least)
                kept = kept_words(len(hashes), runs)
                cuts = np.searchsorted(runs[:, 0], owned)
                raw = part.tobytes()
                for k, (x, y) in enumerate(zip(owned[:-1].tolist(), owned[1:].tolist())):
                    own = runs[cuts[k]:cuts[k + 1]]
                    counts.append(y - x)
                    lists.append([{"start": s - x, "length": e - s, "period": q} for s, e, q in own.tolist()])
                    chosen = np.flatnonzero(kept[x:y]) + x
                    collapsed.append(b" ".join([raw[s:e] for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist())])
                                     .decode("utf-8"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in others), pa.array(counts, pa.int64()), pa.array(lists, kind),
                 pa.array(collapsed, pa.string())], names=[*others, "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, *keep: str, text: str = "text", least: int = 12) -> DataFrame:
    """The named columns of ``docs``, ``n_words``, ``runs`` and ``collapsed`` of each whole text.

    ``runs`` are all maximal stretches of at least ``least`` words and two smallest periods, as
    (start, length, period) in words, by start, then period. ``collapsed`` are the words that no run
    holds beyond its first period, joined by one space. Null, empty and wordless texts have no
    runs and collapse to the empty text. Repeated rows each give their row; no rows give no rows.
    Columns not named are ignored; a named one called like a result is an error. Texts go through
    in slices of 256 KB, a longer one alone, with about a hundred bytes a word in memory.
    """
    clash = {"n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    own = docs.select(*keep).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "n_words long",
                        "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    source = docs.select(*keep, docs[text].alias("_text")) if text not in keep else docs.select(*keep)
    return source.mapInArrow(_found(list(keep), text if text in keep else "_text", least), fields)
