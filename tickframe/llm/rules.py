"""Quality rules as a learned decision list.

Statistics of whole texts are counted in one pass. On a bounded sample of labelled rows,
sequential covering grows one conjunction of thresholds at a time (by information gain on grow
rows), prunes it (on prune rows) and removes what it covers. The list that comes out is ordered,
readable, and applied as a Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_different_words")

_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
_CLASSES = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_digits": bytes(range(48, 58)),
            "n_marks": b"!?\"()[]{}=/\\_~^@+"}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}

#: What rules may test: shares and means of the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "different_words": "n_different_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    own = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(own), len(own) - len(set(own))


def _statistics(others: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = words.buffers(batch.column("text"))
            rows: dict[str, list] = {k: [] for k in COUNTS}
            for a, b in words.slices(limits):
                part, cuts = data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]
                found, starts, ends, owned = words.word_hashes(part, cuts, lower=False)
                lead = _LEAD[part]
                sums = np.concatenate([[0], np.cumsum(lead)])
                inside = np.concatenate([[0], np.cumsum(sums[ends] - sums[starts])])
                rows["n_words"] += np.diff(owned).tolist()
                rows["word_chars"] += np.diff(inside[owned]).tolist()
                rows["n_chars"] += np.diff(sums[cuts]).tolist()
                for name, table in _TABLES.items():
                    rows[name] += np.diff(np.concatenate([[0], np.cumsum(table[part])])[cuts]).tolist()
                every = words.windows(found, WINDOW)
                for k in range(b - a):
                    x, y = int(owned[k]), int(owned[k + 1])
                    lines, repeats = _lines(part[cuts[k]:cuts[k + 1]].tobytes())
                    rows["n_lines"].append(lines)
                    rows["n_dup_lines"].append(repeats)
                    rows["n_different_words"].append(len(np.unique(found[x:y])))
                    rows["n_repeat_words"].append(_repeated(every[x:max(x, y - WINDOW + 1)], y - x))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in others), *(pa.array(rows[k], pa.int64()) for k in COUNTS)],
                names=[*others, *COUNTS])
    return run


def _repeated(windows: np.ndarray, count: int) -> int:
    """Words in windows that occur twice or more among these."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(count + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of ``docs`` and the counts of each row's whole ``text``.

    Null and empty texts count 0 throughout. A row per row; no rows give no rows.
    """
    own = docs.select(*keep).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{k} long" for k in COUNTS)])
    return docs.select(*keep, "text").mapInArrow(_statistics(list(keep)), fields)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """An ordered conditional expression over the counts."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for condition in rule:
                test = test & condition.expression()
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        lines = ["reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in rule)
                 for rule in self.rules]
        return "\n".join([*lines, "otherwise keep"])


def _gain(value: np.ndarray, bad: np.ndarray) -> tuple[float, float, bool]:
    """The best threshold of one feature by FOIL gain: (gain, threshold, above)."""
    order = np.argsort(value, kind="stable")
    ranked, target = value[order], bad[order]
    cut = np.flatnonzero(ranked[1:] > ranked[:-1])
    if not len(cut):
        return 0.0, 0.0, True
    p, n = target.sum(), len(target) - target.sum()
    start = np.log2(p / (p + n))
    low_p = np.cumsum(target)[cut]
    low_n = cut + 1 - low_p
    best = (0.0, 0.0, True)
    for above, px, nx in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
        gain = px * (np.log2(np.maximum(px, 1e-9) / np.maximum(px + nx, 1e-9)) - start)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), float((ranked[cut[k]] + ranked[cut[k] + 1]) / 2), above)
    return best


def _covered(rule: list[Condition], table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for condition in rule:
        out &= condition.holds(table)
    return out


def learn(table: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, *, precision: float = 0.9,
          least: int = 5, most_conditions: int = 4, most_rules: int = 24) -> DecisionList:
    """Sequential covering over rows marked ``bad``; ``grow`` marks those that grow rules.

    A rule is accepted if, pruned, at least ``precision`` of all rows it newly covers are bad, and
    at least ``least`` of them. Fewer rows than that give an empty list, which keeps everything.
    """
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (left & bad & grow).sum() >= least:
        rows, rule = left & grow, []
        while len(rule) < most_conditions and (rows & bad).any() and (rows & ~bad).any():
            options = [(*_gain(v[rows], bad[rows]), k) for k, v in table.items()]
            gain, threshold, above, feature = max(options, key=lambda x: x[0])
            if gain <= 0:
                break
            rule.append(Condition(feature, above, threshold))
            rows = _covered(rule, table, left & grow)

        def worth(size: int) -> float:
            got = _covered(rule[:size], table, left & ~grow)
            return ((got & bad).sum() - (got & ~bad).sum()) / max(1, got.sum())

        if not rule:
            break
        size = max(range(1, len(rule) + 1), key=lambda s: (worth(s), -s))
        rule = rule[:size]
        got = _covered(rule, table, left)
        if (got & bad).sum() < max(least, precision * got.sum()):
            break
        rules.append(tuple(rule))
        left &= ~got
    return DecisionList(tuple(rules))


def fit(statistics: DataFrame, labels: DataFrame, *, rows: int = 20_000) -> DecisionList:
    """A decision list from counts with doc_id and labels (doc_id, quality 0 or 1).

    The sample is bounded: at most ``rows`` labelled rows, the first by a hash of their id and counts.
    Every third is for pruning. Rows without a label or id take no part.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = statistics.join(known, "doc_id").select(
        "quality", F.xxhash64("doc_id", *COUNTS).alias("_at"), *(F.expr(v).alias(k) for k, v in FEATURES.items()))
    found = joined.orderBy("_at", "quality").limit(rows).toArrow()
    table = {k: found[k].to_numpy(zero_copy_only=False).astype(float) for k in FEATURES}
    return learn(table, found["quality"].to_numpy() == 0, np.arange(found.num_rows) % 3 != 0)


def base_failed(least_words: int = 10, repeated_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))


def judge(statistics: DataFrame, verdict: DecisionList) -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept`` added (replaced if there)."""
    return (statistics.drop("base_failed", "kept").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict.keeps()))
