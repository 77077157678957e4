"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm import negatives, queries


def brute(rows, anchor, k=5, low=80, high=100):
    rows = [(i, l, v) for i, l, v in rows
            if None not in (i, l) and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asking = {}
    for i, l, v in rows:
        if anchor(i):
            asking[i] = min(asking.get(i, (l, v)), (l, v))
    for i, (l, v) in asking.items():
        score = lambda w: int(sum(x * y for x, y in zip(v, w)))  # noqa: B023, E731
        others = sorted(((-score(w), j, m) for j, m, w in rows if j != i))
        for s, p, _ in [x for x in others if x[2] == l][:k]:
            fit = [(-t, j) for t, j, m in others if m != l and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, p, n, j, -s, t) for n, (t, j) in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, v array<double>, x string"


def mined(spark, rows, every, **parameters):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).withColumnRenamed("x", "score")
    return sorted(map(tuple, negatives.mine(df.repartition(5), F.col("vec_id") % every == 0, **parameters).collect()))


def cloud(seed, n, dims, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    home = rng.integers(0, labels, n)
    told = np.where(rng.random(n) < 0.2, rng.integers(0, labels, n), home)
    v = np.floor(64 * (centres[home] + spread * rng.normal(size=(n, dims))))
    return [(k, int(told[k]), v[k].tolist()) for k in range(n)]


@pytest.mark.parametrize("spread,parameters", [
    (0.2, {}), (0.2, {"clusters": 1, "bundle": 7}), (1.0, {"block_bytes": 4000, "clusters": 5}),
    (0.05, {"bundle": 3, "clusters": 40, "block_bytes": 20000})])
def test_equals_brute_force(spark, spread, parameters):
    rows = cloud(3, 700, 8, 5, spread)
    assert mined(spark, rows, 20, **parameters) == brute(rows, lambda i: i % 20 == 0)


def test_ties_repeats_and_unfit_rows(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(3), [float(rng.randrange(-2, 4)) for _ in range(3)]) for k in range(300)]
    rows += [(k, k % 2, [3.0, 3.0, 3.0]) for k in range(300, 900)]         # two thirds of all rows in one place
    rows += [(None, 1, [9.0, 9.0, 9.0]), (1001, None, [9.0] * 3), (1002, 1, None), (1003, 1, [9.0, None, 9.0]),
             (1010, 1, [float("nan"), 1.0, 1.0]), (1020, 1, [float("inf"), 1.0, 1.0]), (1030, 1, []), (1040, 2, [0.0, 0.0, 0.0]),
             (1050, 1, [2.0, 2.0]), (1051, 0, [2.0, 2.0, 0.0, 5.0]), (1060, 1, [1.0, 2.0, 3.0]), (1060, 0, [1.0, 2.0, 2.0])]
    assert mined(spark, rows, 10, block_bytes=3000) == brute(rows, lambda i: i % 10 == 0)


def test_nothing(spark):
    assert mined(spark, [(k, None, [1.0]) for k in range(3)], 1) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])], 10) == []
    assert mined(spark, [(10, 0, [1.0]), (2, 1, [1.0])], 10) == []


def test_walks_end_early():
    """In tight clusters a member leaves its list long before the end, and misses nothing."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(50, 16))
    rows = np.vstack([near, rng.normal(size=(5000, 16))])
    shared, best, seen = negatives.SharedList(near[:10], rows), negatives.Best(10, 5), []

    def take(members, which, scores):
        seen.append(len(which))
        best.add(members, which, scores, np.ones_like(scores, bool))

    shared.walk(take, best.floor)
    who, which, scores = best.result(np.arange(len(rows)))
    every = near[:10] @ rows.T
    for k in range(10):
        assert which[who == k].tolist() == np.lexsort((np.arange(len(rows)), -every[k]))[:5].tolist()
    assert sum(seen) < 1000


def test_query_leaves_out_what_is_no_number(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 3)), rng.normal(size=4).astype(np.float32).tolist()) for k in range(400)]
    rows += [(500, 1, [float("nan")] * 4), (600, 1, [None, 1.0, 1.0, 1.0]), (700, None, [1.0] * 4), (800, 1, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    turned = [(i, (l + 1) % 10 if l is not None and i % 7 == 0 else l,
               None if v is None else [None if x is None or not math.isfinite(x) else float(math.floor(256 * x)) for x in v])
              for i, l, v in rows]
    got = sorted(map(tuple, queries.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute(turned, lambda i: i % 100 == 0) and got
