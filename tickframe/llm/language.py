"""Language by cross-parsing entropy: suffix automata of labelled text, fewest phrases wins.

For each language a suffix automaton of sampled labelled text answers the longest match at any
place. A text is parsed greedily into phrases: each is the longest string from here that occurs
in the language's sample, or one unknown character. The language needing the fewest phrases,
each counted at log2 of its sample's length, describes the text with the fewest bits.

Texts are read whole: lower-cased letters, every run of other characters as one space. Parsing
starts anew every ``SPAN`` characters, so all spans of many texts advance together in NumPy and
a long text is no longer a walk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.llm import words

UNKNOWN = "und"
SPAN = 256
PIECE = 1 << 19     # characters parsed at once
DENSE = 64          # symbols a language whose edges are a dense table
POINTS = 0x110000


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of a column's text modulo ``folds``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


class Automaton:
    """Edges of an automaton: a dense table of the most used symbols, the others' as sorted keys.

    ``shape`` is states and symbols; ``automaton[state]`` is a state's row, symbol → state or -1.
    """

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        used, counts = np.unique(symbols, return_counts=True)
        dense = used[np.lexsort((used, -counts))][:DENSE]
        self.width = len(dense) + 1
        self.column = np.full(shape[1], len(dense), np.int32)      # the last column has no edges
        self.column[dense] = np.arange(len(dense))
        # one state more, from which nothing goes on: before the first phrase and after an unknown character
        self.flat = np.full((shape[0] + 1) * self.width, -1, np.int32)
        column = self.column[symbols]
        near = column < len(dense)
        self.flat[states[near] * self.width + column[near]] = to[near]
        self.rare = np.zeros(shape[1], bool)
        self.rare[used] = self.column[used] == len(dense)
        keys = states[~near] * shape[1] + symbols[~near]
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], to[~near][order]

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, state: int) -> np.ndarray:
        return self.step(np.full(self.shape[1], state, np.int64), np.arange(self.shape[1]))

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where each state goes by its symbol, or -1."""
        to = self.flat[states * self.width + self.column[symbols]]
        if len(self.keys):
            at = np.flatnonzero(self.rare[symbols])
            if len(at):
                key = states[at].astype(np.int64) * self.shape[1] + symbols[at]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[at] = np.where(self.keys[place] == key, self.targets[place], -1)
        return to


def suffix_automaton(codes: Sequence[int], symbols: int) -> Automaton:
    """The suffix automaton of a string of symbols."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in codes:
        here = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = here
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[here] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[here] = copy
        last = here
    states = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
    return Automaton(states, np.array([c for x in nexts for c in x], np.int64),
                     np.array([t for x in nexts for t in x.values()], np.int32), (len(nexts), symbols))


def point_classes() -> np.ndarray:
    """For every code point: its lower-case letter's code point, 0 for what is no letter."""
    table = np.zeros(POINTS, np.int32)
    for point in range(POINTS):
        if (c := chr(point)).isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def fold(points: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with runs of others as one 0, and each text's place among them."""
    low = classes[points]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    inner = starts[starts < len(low)]
    keep[inner] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[Automaton]      # an automaton per language; the last symbol is in none
    bits: np.ndarray             # log2 of each sample's length
    symbols: np.ndarray          # code point → symbol
    classes: np.ndarray          # code point → lower-case letter, 0 for others

    def phrases(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases per text and language; ``starts`` are the texts' limits among the symbols."""
        counts = np.zeros((len(starts) - 1, len(self.languages)), np.int64)
        sizes = np.diff(starts)
        spans = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), spans)
        if not len(owner):
            return counts
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = starts[:-1][owner] + nth * SPAN
        length = np.minimum(SPAN, starts[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        steps = [symbols[begin[:n] + k] for k, n in enumerate(alive.tolist())]
        for at, table in enumerate(self.tables):
            root = np.where(table[0] < 0, len(table), table[0])
            state = np.full(len(begin), len(table), np.int32)
            made = np.zeros(len(begin), np.int32)
            for n, c in zip(alive.tolist(), steps):
                to = table.step(state[:n], c)
                failed = to < 0
                # where the automaton cannot go on, a phrase begins with c
                made[:n] += failed
                state[:n] = np.where(failed, root[c], to)
            counts[:, at] = np.bincount(owner, weights=made, minlength=len(sizes)).astype(np.int64)
        return counts

    def predict(self, data: np.ndarray, limits: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every text given as UTF-8 bytes with row limits."""
        total = np.zeros((len(limits) - 1, len(self.languages)))
        letters = np.zeros(len(limits) - 1, bool)
        for a, b, low, starts in _folded(data, limits, self.classes):
            seen = np.concatenate([[0], np.cumsum(low != 0)])
            letters[a:b] |= np.diff(seen[starts]) > 0
            total[a:b] += self.phrases(self.symbols[low], starts)
        cost = total * self.bits
        best = cost.argmin(axis=1)
        weight = 1 / np.maximum(cost, 1e-9)
        score = np.where(letters, weight[np.arange(len(best)), best] / weight.sum(axis=1), 0.0)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist())]
        return names, score


def _points(part: np.ndarray) -> np.ndarray:
    return np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _folded(data: np.ndarray, limits: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, folded characters and the rows' limits among them, in pieces of bounded size.

    A long text comes in several, each of whole spans but the last, so it is parsed as in one piece.
    """
    for a, b in words.slices(limits, PIECE):
        part, cuts = data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]
        if len(part) <= PIECE:
            points = _points(part)
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[cuts]
            yield (a, b, *fold(points, classes, np.minimum(lead, len(points))))
            continue
        at, left, last = 0, np.zeros(0, np.int32), -1
        while at < len(part):
            end = min(at + PIECE, len(part))
            while end < len(part) and part[end] & 0xC0 == 0x80:
                end += 1
            low, _ = fold(_points(part[at:end]), classes, np.array([0]))
            low = low[1:] if last == 0 and len(low) and low[0] == 0 else low
            last, at = int(low[-1]) if len(low) else last, end
            left = np.concatenate([left, low])
            whole = len(left) // SPAN * SPAN if at < len(part) else len(left)
            yield a, b, left[:whole], np.array([0, whole])
            left = left[whole:]


def sample_texts(docs: DataFrame, language: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts a language, the first by a hash of the text.

    Equal texts count once. Ranks are cut before and after the shuffle, so that a language of
    any size sends a bounded number of narrow rows; texts are fetched for the chosen only.
    """
    named = docs.where(F.col(language).isNotNull() & F.col("text").isNotNull())
    mark = F.xxhash64("text")
    chosen = (named.select(language, mark.alias("_mark")).distinct()
              .selectExpr("*", f"row_number() over (partition by {language} order by _mark) as _at")
              .where(F.col("_at") <= rows).select(language, "_mark"))
    return (named.select(language, "text", mark.alias("_mark")).join(F.broadcast(chosen), [language, "_mark"])
            .groupBy(language, "_mark").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, *, language: str = "lang", rows: int = 120, chars: int = 300) -> LanguageModel:
    """A model from ``docs`` (text, language).

    The sample is bounded and documented: per language at most ``rows`` texts of a labelled
    corpus, of each a passage of ``chars`` folded characters from its middle, so an automaton of at most
    ``2 * rows * chars`` states. Every letter of the sample is a symbol; unknown to a language are those its
    own sample lacks.
    Without labelled rows there is no language and every prediction is ``und``.
    """
    classes = point_classes()
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def passages(batches):
        for batch in batches:
            cut = []
            for text in batch.column("text"):
                points = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
                low, _ = fold(points, held.value, np.array([0, len(points)]))
                at = max(0, (len(low) - chars) // 2)
                cut.append(low[at:at + chars] if low.any() else low[:0])
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("_mark"), pa.array(cut, pa.list_(pa.int32()))],
                                             names=["name", "_mark", "passage"])

    found = sample_texts(docs, language, rows).select(F.col(language).cast("string").alias("name"), "_mark", "text").mapInArrow(
        passages, "name string, _mark long, passage array<int>")
    joined: dict[str, list[np.ndarray]] = {}
    for row in found.orderBy("name", "_mark", "passage").collect():      # at most ``rows`` passages a language
        if row["passage"]:
            joined.setdefault(row["name"], []).append(np.append(np.array(row["passage"], np.int32), 0))
    texts = {k: np.concatenate(v) for k, v in sorted(joined.items())}
    letters = np.unique(np.concatenate([*texts.values(), np.zeros(1, np.int32)]))
    table = np.full(POINTS, len(letters), np.int32)
    table[letters] = np.arange(len(letters))
    tables = [suffix_automaton(table[v].tolist(), len(letters) + 1) for v in texts.values()]
    return LanguageModel(list(texts), tables, np.log2([len(v) + 1 for v in texts.values()]), table, classes)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added, from the whole text alone.

    ``und`` with score 0 where the text is null, empty or without letters, or the model knows no
    language. Other columns pass through; a column already called so is replaced. Ties go to the
    language first by name. No rows give no rows.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = words.buffers(batch.column("text"))
            if held.value.languages:
                names, score = held.value.predict(data, limits)
            else:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)
