"""Result writers: trades, stats, folds, catalogs, percentile tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.columns import finite
from tickframe.operators import history as H

MANIFEST = "run_id string, attempt string, published long, about string, rows map<string,long>"


def storable(df: DataFrame) -> DataFrame:
    """Infinity and NaN become null: JSON has no word for them."""
    return df.select(*[finite(c).alias(c) if kind in ("double", "float") else c for c, kind in df.dtypes])


def write_results(df: DataFrame, path: str, run_id: str, form: str = "parquet") -> None:
    """Append one run's rows under its ``run_id``; form is parquet, csv or json."""
    out = storable(df).withColumn("run_id", F.lit(run_id))
    writer = out.write.mode("append").partitionBy("run_id")
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def publish_run(spark: SparkSession, path: str, run_id: str, tables: dict[str, DataFrame], about: dict | None = None) -> None:
    """Write a run's tables (trades, folds, statistics, ...) and then the manifest that makes them the run.

    Tables go to a folder of their own each time; readers find them through the run's newest manifest. So
    a run written again replaces the earlier one whole, and one that broke off halfway is never read. What
    manifests no longer name can be removed with ``stale``.
    """
    attempt = uuid.uuid4().hex
    counts = {}
    for name, rows in tables.items():
        storable(rows).write.parquet(f"{path}/data/{attempt}/{name}")
        counts[name] = spark.read.parquet(f"{path}/data/{attempt}/{name}").count()
    row = (run_id, attempt, time.time_ns(), json.dumps(about or {}, sort_keys=True), counts)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifests")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest of every run: run_id, attempt, published (ns), about (JSON), rows a table."""
    every = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    newest = F.max_by(F.struct("attempt", "published", "about", "rows"), F.struct("published", "attempt")).alias("m")
    return every.groupBy("run_id").agg(newest).select("run_id", "m.*")


def read_run(spark: SparkSession, path: str, run_id: str, name: str) -> DataFrame:
    """A table of a published run; an unknown run or table is an error."""
    found = manifests(spark, path).where(F.col("run_id") == run_id).first()
    if found is None or name not in found["rows"]:
        raise ValueError(f"no table {name!r} of a published run {run_id!r}")
    return spark.read.parquet(f"{path}/data/{found['attempt']}/{name}")


def stale(spark: SparkSession, path: str) -> DataFrame:
    """Attempts with a manifest that a newer one of the same run has replaced."""
    every = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    return every.join(manifests(spark, path).select("attempt"), "attempt", "left_anti")


def write_catalog(catalog: DataFrame, path: str, include_sealed: bool = False) -> None:
    """Explore and sealed rows go to separate folders; the sealed one only on request."""
    for label in (H.EXPLORE, H.SEALED) if include_sealed else (H.EXPLORE,):
        catalog.where(F.col("split") == label).write.mode("overwrite").parquet(f"{path}/{label}")


def write_percentiles(table: DataFrame, path: str) -> None:
    """One folder per population, so a table can never be read under the wrong name."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("population").parquet(path))


def read_percentiles(spark: SparkSession, path: str, population: str) -> DataFrame:
    """The table of one named population; there is no default."""
    if population not in (H.FULL, H.EXPLORE):
        raise ValueError(f"population must be named, not {population!r}")
    return spark.read.parquet(path).where(F.col("population") == population)


def describe_percentiles(table: DataFrame) -> DataFrame:
    """What a table was built from, in its own words."""
    return table.groupBy("symbol", "session", "population", "cutoff").agg(
        F.max("sessions_seen").alias("sessions_used"), F.max("session_bar").alias("depth"))
