"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; a stage's result is
written as Parquet and read again as the next one's documents. The last returns packed pieces,
the others the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontaminate, jaccard, language, packing, secrets
from tickframe.llm.tokens import tokenizer_path
from tickframe.operators.series import settle
from tickframe.ship import ship

#: Texts can be long: rows go to Python in batches of so many bytes, so a task holds a few megabytes.
BATCH = "4m"
#: The languages to keep, or None for all.
LANGUAGES: tuple[str, ...] | None = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(work: Callable) -> Callable:
    """The stage as it runs: the package on the workers, small batches to Python."""
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return work(spark, docs, sf_dir)
    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language, of ``LANGUAGES`` where that is set; names it where ``lang`` is null.

    Null and empty texts and those without a letter go. Without a labelled document no language can be told
    apart: then every document with a letter stays (none, if ``LANGUAGES`` is set) and ``lang`` as it is. Ties go to the
    language first by name. Repeated rows and rows without an id stay like any other; no rows give no rows;
    columns beyond those of documents are dropped. A long text is parsed whole.
    """
    model = language.fit(docs.where(F.coalesce(language.crc_fold("doc_id", 5) != 0, F.lit(True))))
    found = language.identify(docs.select(*COLUMNS), model)
    told = F.col("lang_pred") != language.UNKNOWN
    if LANGUAGES is not None:
        found = found.where(F.col("lang_pred").isin(list(LANGUAGES)))
    elif model.languages:
        found = found.where(told)
    else:
        found = found.where(F.col("text").rlike(r"\p{L}"))
    return found.withColumn("lang", F.coalesce("lang", F.when(told, F.col("lang_pred")))).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest doc_id, nulls last.

    Of repeated rows one stays. Texts without words are like nothing and all stay. No rows give no rows; columns
    beyond those of documents are dropped.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs, whatever its id.

    Null and empty texts have no words and stay, as do all on an empty benchmark. Repeated rows are judged alike; columns
    beyond those of documents are dropped.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.benchmark_hits(docs.select(*COLUMNS), benchmark).where(~F.col("contaminated")).select(*COLUMNS)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and counts ``n_chars`` of masked ones anew; every document stays.

    Null and empty texts have none. Repeated rows are masked alike; no rows give no rows; columns beyond those
    of documents are dropped.
    """
    found = secrets.find_secrets(docs.select(*COLUMNS))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long"))
                            .otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 4096; every id of every document in one piece.

    Null and empty texts are their end id alone. Repeated rows are packed each for themselves; no rows give no rows.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
