"""Periodic runs against all pairs of periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, corpus
from tickframe.llm import queries, runs, words

SF = "/root/testdata/sf0.001"


def brute(s, least=2):
    out = {}
    for p in range(1, len(s) // 2 + 1):
        k = 0
        while k < len(s) - p:
            b = k
            while k < len(s) - p and s[k] == s[k + p]:
                k += 1
            if k + p - b >= max(2 * p, least):
                out.setdefault((b, k + p), p)
            k += 1
    return sorted(((b, e, p) for (b, e), p in out.items()), key=lambda x: (x[0], x[2]))


def powers(rng, n):
    """Squares of words that are powers themselves, with and without a letter between."""
    out = []
    while len(out) < n:
        v = [rng.randrange(2) for _ in range(rng.randrange(1, 5))]
        u = v * rng.randrange(1, 40) + v[:rng.randrange(len(v) + 1)] + [rng.randrange(2)] * rng.randrange(2)
        out += u * rng.randrange(1, 4)
    return out[:n]


def mirrored(rng, n):
    """Two neighbouring runs of one period: every period of one phase between them."""
    v = [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
    return v * (n // (2 * len(v))) + v[:rng.randrange(len(v) + 1)] + v[rng.randrange(len(v)):] + v * (n // (2 * len(v)))


def fibonacci(rng, n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(rng, n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return t[:n]


def planted(rng, n):
    s = [rng.randrange(50) for _ in range(n)]
    for _ in range(3):
        a, p = rng.randrange(n), 1 + rng.randrange(n // 4 + 1)
        for i in range(a, min(n, a + rng.randrange(n))):
            s[i] = s[a + (i - a) % p]
    return s


KINDS = {"two": lambda rng, n: [rng.randrange(2) for _ in range(n)], "four": lambda rng, n: [rng.randrange(4) for _ in range(n)],
         "one": lambda rng, n: [7] * n, "powers": powers, "mirrored": mirrored, "fibonacci": fibonacci,
         "thue_morse": thue_morse, "planted": planted}


@pytest.mark.parametrize("kind", list(KINDS))
def test_all_runs_are_found(kind):
    rng, table = random.Random(kind), words.mix(np.arange(1, 100, dtype=np.uint64) * np.uint64(12345))
    for _ in range(6):
        texts = [KINDS[kind](rng, n) for n in (1, 5, 12, rng.randrange(30, 600), 250)]
        texts.insert(rng.randrange(6), [])
        limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        symbols = table[np.array(sum(texts, []), np.int64)]
        for least in (2, 12):
            want = [(b + int(at), e + int(at), p) for t, at in zip(texts, limits) for b, e, p in brute(t, least)]
            assert [tuple(x) for x in runs.find_runs(symbols, limits, least).tolist()] == want


def test_chosen_places_depend_on_their_context_alone():
    rng = random.Random(4)
    piece = [rng.randrange(30) for _ in range(300)]
    text = [rng.randrange(30) for _ in range(77)] + piece + [rng.randrange(30) for _ in range(51)] + piece
    symbols = words.mix(np.array(text, np.uint64) + np.uint64(1))
    seq = runs.Sequence(symbols, np.array([0, len(text)]))
    none = np.zeros((0, 3), np.int64)
    for scale in (2, 4, 8, 16, 32):
        at = runs.synchronising_set(seq, scale, none)
        inside = lambda a: {int(x) - a for x in at if a <= x <= a + 300 - 2 * scale}
        assert inside(77) == inside(77 + 300 + 51) and len(inside(77)) >= 300 // (2 * scale) - 2
        assert np.diff(at).max() <= scale + 1


def by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w, 12)
    gone = {i for b, e, p in found for i in range(b + p, e)}
    top = min(((-(e - b), b, p) for b, e, p in found), default=None)
    length, start, period = (-top[0], top[1], top[2]) if top else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), start, length, period, 1000 * length // period if top else None,
            sha("".join(f"{b},{e - b},{p}\n" for b, e, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if len(r.text or "") < 6000]
    rng = random.Random(9)
    texts += AWKWARD + AWKWARD[:5] + [" ".join(map(str, powers(rng, 400))), "  a b " * 30, ("ab cd " * 9 + "x ") * 7]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 10), (3, "w " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((by_hand(*r) for r in rows), key=repr)


def test_operator_on_awkward_rows(spark):
    docs = corpus(spark, AWKWARD * 2, extra=True)
    got = runs.periodic_runs(docs, "doc_id", "items").collect()
    assert len(got) == 2 * len(AWKWARD)
    named = {r.doc_id: r for r in got}
    assert named[0].runs == [] and named[0].collapsed == "" and named[0].n_words == 0
    long_ = named[AWKWARD.index("word " * 3000)]
    assert [tuple(x) for x in long_.runs] == [(0, 3000, 1)] and long_.collapsed == "word"
    assert runs.periodic_runs(docs.where("doc_id < 0"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs.withColumnRenamed("items", "runs"), "doc_id", "runs")


def test_one_text_beyond_a_slice(spark):
    rng = random.Random(2)
    block = [str(rng.randrange(10 ** 6)) for _ in range(20000)]
    text = " ".join(["x"] * 100 + block + block + block[:77] + ["y"])
    assert len(text) > words.SLICE
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    assert [tuple(x) for x in row.runs] == [(0, 100, 1), (100, 40077, 20000)]
    assert row.collapsed == " ".join(["x"] + block + ["y"])
