"""The registered text queries and the pipeline on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import differences
from tickframe.llm.queries import QUERIES, SQL

SF = os.environ.get("TICKFRAME_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    # none of the fifty smallest pages is among the damaged records
    sf = SF.replace("sf0.001", "sf0.01") if name == "op2_warc_merkle_fixity" else SF
    said, n, _, _ = differences(spark, name, entry.queries()[name], SQL.get(name), sf)
    assert not said and n > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[3] == kept[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


AWKWARD_TEXTS = [None, "", " \n ", "...", "one two three four five six seven eight nine ten", "日本語 の 文", "password=abcdef123 x", "w " * 5000]


def _awkward(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(AWKWARD_TEXTS)] * 2 + [(None, "no id here at all", "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {k: F.lit("extra") for k in ("lang_pred", "score", "root", "items", "spans", "_hash", "n", "ids")})


def test_pipeline_without_labels_keeps_every_document_with_a_letter(spark):
    docs = corpus_pipeline.language_id(spark, _awkward(spark), SF)
    assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == sorted(map(str, [4, 5, 6, 7] * 2 + [None]))


def test_pipeline_names_languages_and_can_choose_among_them(spark, monkeypatch):
    known = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select(*corpus_pipeline.COLUMNS)
    docs = known.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = corpus_pipeline.language_id(spark, docs, SF)
    told = found.where("lang is null").count(), found.join(known.select("doc_id", F.col("lang").alias("real")), "doc_id")
    assert told[0] == 0 and told[1].where("lang = real").count() >= 0.9 * told[1].count()
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de",))
    chosen = corpus_pipeline.language_id(spark, known, SF)
    assert 0 < chosen.count() < known.count() and chosen.where("lang = 'de'").count() >= 0.9 * chosen.count()


def test_stages_stand_awkward_rows(spark):
    docs, ids = _awkward(spark), []
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == list(corpus_pipeline.COLUMNS)
        ids.append(sorted(str(r.doc_id) for r in done.collect()))
    every = sorted([str(k) for k in range(8)] * 2 + ["None"])
    assert ids[0] == sorted(["0", "1", "2"] * 2 + ["3", "4", "5", "6", "7", "None"]) and ids[1] == every and ids[2] == every
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == 9
