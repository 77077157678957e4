"""The Jaccard join against all pairs, and what one of each group stays."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, SCHEMA, corpus
from tickframe.llm import words
from tickframe.llm.jaccard import keep_one, near_duplicates, parity, prefix_length


def brute(texts, size=5, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(k, len(sets[k]), find(k)) for k in range(len(texts))]


def variants(seed, groups=6, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    license_ = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own) + (" " + license_ if rng.random() < 0.4 else ""))
    return out


def test_components_equal_brute_force(spark):
    texts = variants(1) + AWKWARD
    got = near_duplicates(corpus(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_frequent_shingles_and_a_large_group(spark):
    """Every shingle is beyond the frequency bound, so order, salts and hubs are all in use."""
    texts = variants(2, groups=2, copies=60)
    got = near_duplicates(corpus(spark, texts), frequent=3, fragments=3).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute(texts)


def test_rows_of_all_kinds(spark):
    empty = corpus(spark, ["a b"]).where("doc_id < 0")
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0
    rows = [(None, "p q r s t u", None, None, 1), (3, "p q r s t u", None, None, 1), (3, "p q r s t u", None, None, 1),
            (4, None, "en", None, 1), (4, None, "en", None, 1), (5, "z z z z z y", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "root")
    got = near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 3), (3, 3), (3, 3), (4, 4), (4, 4), (5, 5)]))
    kept = keep_one(docs)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "4", "4", "5"] and kept.columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=80), st.sets(st.integers(0, 2 ** 64 - 1), max_size=80))
def test_parity_bounds_the_difference(a, b):
    x, y = (parity(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
    assert sum(bin(int(v) % 2 ** 64).count("1") for v in x ^ y) <= len(a ^ b)


def test_prefix_lengths():
    assert [prefix_length(n, 75) for n in (1, 2, 3, 4, 8, 100)] == [1, 1, 1, 2, 3, 26]


def test_words_across_pieces():
    """A word longer than a piece, and words at its edges, hash like those of short texts."""
    import pyarrow as pa
    long = "ab cd " * 300_000 + "z" * (3 << 20) + " ab"
    data, limits = words.buffers(pa.array([long, "ab cd", None, "z" * (3 << 20)]))
    found = [words.word_hashes(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]) for a, b in words.slices(limits)]
    hashes = np.concatenate([f[0] for f in found])
    assert len(hashes) == 600_002 + 2 + 1
    assert hashes[0] == hashes[600_001] == hashes[600_002] and hashes[600_000] == hashes[-1]


def test_many_near_copies_cost_few_pairs(spark, monkeypatch):
    """Near copies of one text and strangers that share a passage: pairs compared stay far below all pairs."""
    from tickframe.llm import jaccard
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, passage = rng.choices(vocabulary, k=90), rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(passage + rng.choices(vocabulary, k=40)) for _ in range(200)]
    outsider = base[:70] + rng.choices(vocabulary, k=30)
    texts.append(" ".join(outsider))
    counted, plain = [], jaccard.similar_pairs

    def counting(docs, marks, pairs, *rest):
        counted.append(pairs.count())
        return plain(docs, marks, pairs, *rest)

    monkeypatch.setattr(jaccard, "similar_pairs", counting)
    got = near_duplicates(corpus(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts)
    assert sum(counted) < 8 * len(texts)


def test_what_rounds_leave_is_not_compared_at_once(spark, monkeypatch):
    """Rounds that find nothing leave all pairs of two groups; few are compared before their classes are together."""
    from tickframe.llm import jaccard
    texts = [f"{' '.join(f'{g}{k}' for k in range(60))} x{g}{n}" for g in "ab" for n in range(70)]
    counted, plain, few = [], jaccard.similar_pairs, jaccard._few_each

    def counting(docs, marks, pairs, *rest):
        counted.append(pairs.count())
        return plain(docs, marks, pairs, *rest)

    monkeypatch.setattr(jaccard, "similar_pairs", counting)
    monkeypatch.setattr(jaccard, "_few_each", lambda *a: few(*a).limit(0))
    got = near_duplicates(corpus(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts)
    assert sum(counted) < 8 * len(texts)


def edited(seed, copies, size=200):
    """Copies of one text, of which one in 15 has one word changed and the others four: they link by the former only."""
    rng = random.Random(seed)
    base, out = [f"b{k}" for k in range(size)], []
    for k in range(copies):
        own = list(base)
        for at in rng.sample(range(size), 4 if k % 15 else 1):
            own[at] = f"x{rng.randrange(10 ** 9)}"
        out.append(" ".join(own))
    return out


def test_stragglers_meet_the_least_edited_copies(spark, monkeypatch):
    """Rounds link copies near the limit, so few pairs of them and the large group are left to be enumerated."""
    from tickframe.llm import jaccard
    texts, left, plain = edited(5, 300), [], jaccard._all_apart

    def counting(*a):
        left.append(plain(*a).count())
        return plain(*a)

    monkeypatch.setattr(jaccard, "_all_apart", counting)
    got = near_duplicates(corpus(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts)
    assert sum(left) < len(texts)


def test_a_large_group_does_not_ask_after_a_straggler(spark):
    """Under shingles of a group of 500 and 20 classes of their own, the latter ask and the group does not."""
    from tickframe.llm import jaccard
    rows = [(h, c, 100, 0, True, 0 if c < 500 else c, 500 if c < 500 else 1) for h in range(60) for c in range(520)]
    rooted = spark.createDataFrame(rows, "h long, cls long, n int, pos int, late boolean, root long, size long")
    assert 20 <= jaccard._few_each(rooted, None, 75, 1).count() <= 20 * jaccard.TRIES


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    """What is in stars takes no round, and links come to the stars made before, not to all links before."""
    from tickframe.llm import graph, jaccard
    rounds, plain = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda edges, larger: rounds.append(larger) or plain(edges, larger))
    schema = "a long, b long"
    stars = graph.components(spark.createDataFrame([(5, 1), (6, 1), (9, 2)], schema))
    assert sorted(map(tuple, stars.collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)] and not rounds
    grown = jaccard._joined(stars, spark.createDataFrame([(9, 6), (7, 3)], schema))
    assert sorted(map(tuple, grown.collect())) == [(k, 3 if k in (3, 7) else 1) for k in (1, 2, 3, 5, 6, 7, 9)]
    chain = graph.components(spark.createDataFrame([(k + 1, k) for k in range(40)], schema))
    assert {r.root for r in chain.collect()} == {0} and chain.count() == 41
    assert graph.components(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=200))
def test_bitmaps_never_say_no_to_what_they_hold(values):
    from tickframe.llm.jaccard import Bitmap
    bitmap, held = Bitmap(10), np.array(sorted(values), np.uint64)
    place = held & np.uint64(1023)
    np.bitwise_or.at(bitmap.words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    assert bitmap.has(held).all()
