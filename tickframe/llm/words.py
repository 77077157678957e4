"""Words of whole texts as 64-bit hashes, straight from Arrow buffers.

Texts are handled in slices of about ``SLICE`` bytes (a longer text alone, in pieces), so that a
task's memory does not follow the length of a text beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, dtype=bool)          # after lower-casing: 0-9, a-z and every non-ASCII byte
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
#: Word bytes by rule: everything but ASCII white space, or letters and digits only.
WORD = {"space": ~_SPACE, "alnum": _ALNUM}

_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


def _powers() -> list[np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below SLICE."""
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(SLICE + 1, U(base))
            steps[0] = U(1)
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the int64 row limits of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def slices(limits: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes together; a longer row stands alone."""
    row, rows = 0, len(limits) - 1
    while row < rows:
        end = int(np.searchsorted(limits, limits[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    grow, back = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * grow[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _giant(word: np.ndarray) -> np.ndarray:
    """The hash of one word that is longer than a piece: pieces summed at their powers."""
    grow, _ = _powers()
    total, scale = 0, 1
    for at in range(0, len(word), SLICE):
        part = word[at:at + SLICE]
        total += scale * int((_BYTE[part] * grow[:len(part)]).sum(dtype=np.uint64))
        scale = scale * int(grow[len(part)]) % (1 << 64)
    return mix(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))


def word_hashes(data: np.ndarray, limits: np.ndarray, rule: str = "space", lower: bool = True):
    """Hash, first byte and end byte of every word of the rows, and the rows' limits among words."""
    if lower:
        data = _LOWER[data]
    inside = WORD[rule][data]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[1:-1] = inside[1:] & ~inside[:-1]
    if len(data):
        edge[0] = inside[0]
    cuts = limits[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    out = np.zeros(len(data) + 1, bool)
    if len(data):
        out[1:-1] = inside[:-1] & ~inside[1:]
        out[-1] = inside[-1]
        out[cuts] |= inside[cuts - 1]
    ends = np.flatnonzero(out)
    owned = np.searchsorted(starts, limits, side="left")
    if len(data) <= SLICE:
        return _piece(data, starts, ends), starts, ends, owned
    hashes, word = np.empty(len(starts), np.uint64), 0
    while word < len(starts):
        first = starts[word]
        end = int(np.searchsorted(ends, first + SLICE, side="right"))
        if end == word:
            hashes[word:word + 1] = _giant(data[first:ends[word]])
            word += 1
            continue
        hashes[word:end] = _piece(data[first:ends[end - 1]], starts[word:end] - first,
                                  ends[word:end] - first)
        word = end
    return hashes, starts, ends, owned


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive words; rows must be minded by the caller."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:count].copy()
    for step in range(1, size):
        total = total * U(BASE) + hashes[step:step + count]
    return mix(total + U(size))


def shingle_sets(data: np.ndarray, limits: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its ``size``-word shingles.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    hashes, _, _, owned = word_hashes(data, limits)
    every = windows(hashes, size)
    for a, b in zip(owned[:-1].tolist(), owned[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def batches(columns: dict[str, np.ndarray | pa.Array], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Equal-length columns as record batches of bounded length."""
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    whole = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
    for at in range(0, whole.num_rows, most):
        yield whole.slice(at, most)
