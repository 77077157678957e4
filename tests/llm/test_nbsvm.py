"""The quality classifier: features, the dual's optimum, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, corpus
from tickframe.llm import nbsvm, queries, words


def of(*texts):
    import pyarrow as pa
    found, cuts = nbsvm.features(*words.buffers(pa.array(texts, pa.string())))
    return [set(found[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]


def test_features_are_of_their_text_alone():
    texts = ["one two three", None, "Ab!! cd", "", "one two three", "x", "one ONE one", " \n", "é" * 40]
    together = of(*texts)
    assert together == [of(t)[0] for t in texts]
    assert together[0] == together[4] and not together[1] and not together[3] and not together[7]
    assert len(of("a b")[0]) == 3 + 2          # a, b, a b; one shape and its pair
    assert of("w w w w")[0] != of("w v w v")[0]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    target = np.where(x @ [1.0, -2, 0.5, 0] + 0.7 * rng.normal(size=60) > 0, 1, -1)
    rows = [(np.arange(4), v) for v in x]
    w = nbsvm.dual_descent(rows, target, np.full(60, 0.5), 4, rounds=3000, tolerance=1e-9)
    worth = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - target * (x @ v)).sum()
    for _ in range(300):
        assert worth(w) <= worth(w + 0.05 * rng.normal(size=4)) + 1e-9


def test_ratios_count_every_labelled_text(spark):
    docs = corpus(spark, ["good day", "good night", "bad day", None, "bad bad"])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 1), (4, 0), (4, 0), (None, 1), (1, None), (9, 0)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    day, good, bad = (next(iter(of(w)[0] - of("zzz")[0])) for w in ("day", "good", "bad"))
    assert model.ratio[good] > model.ratio[day] > model.ratio[bad]
    held = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    assert held[0] > held[4] and 0 <= min(held.values()) <= max(held.values()) <= 1


@pytest.mark.parametrize("given,want", [([], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0)], 0.0)])
def test_without_two_classes(spark, given, want):
    docs = corpus(spark, ["a b", "c", None])
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    assert {r.score for r in nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()} == {want}


def test_awkward_rows(spark):
    docs = corpus(spark, AWKWARD * 2).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    got = nbsvm.score(docs, model)
    rows = got.collect()
    assert len(rows) == 2 * len(AWKWARD) and all(0 <= r.score <= 1 for r in rows) and "quality" in got.columns
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.score) == r.score
    assert by[None] == by[""]
    assert nbsvm.score(docs.where("doc_id < 0"), model).count() == 0


def test_the_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = nbsvm.fit(docs, labels), nbsvm.fit(docs.repartition(7), labels.repartition(3))
    assert (a.ratio == b.ratio).all() and np.allclose(a.weights, b.weights) and np.isclose(a.slope, b.slope)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_nb_svm_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    told = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in told if r.quality == 1], [r for r in told if r.quality == 0]
    assert len(told) > 60 and sum(r.predicted for r in good) >= 0.95 * len(good) and sum(r.predicted for r in bad) <= 0.1 * len(bad)
    assert all(r.predicted == (r.score >= 0.7) for r in told)
