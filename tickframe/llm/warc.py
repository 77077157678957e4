"""Merkle fixity audit of WARC replicas.

Records are hashed, and ordered ranges of ``FANOUT`` nodes are hashed into parents up to one root a
file. Two replicas are compared root by root; only below nodes that differ are the children compared, so
intact files cost one row each and corruption is located by its record and byte range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.series import settle

FANOUT = 16


def warc_record(url: Column, body: Column) -> Column:
    """One response record as text: header, an empty line, the body, two line ends."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def warc_layout(pages: DataFrame, *, per_file: int = 512) -> DataFrame:
    """``pages`` (page_id, url, html) → file, seq, offset, page_id, url, html: where records lie.

    A file takes the ids of one range of ``per_file``; null ids share file -1. Records lie by id, URL
    and html, repeated rows one after the other; null texts are empty. No rows give no rows.
    """
    file = F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long")
    size = F.octet_length(warc_record(F.col("url"), F.col("html"))).cast("long")
    order = "over (partition by file order by page_id, url, html rows unbounded preceding)"
    return pages.select(file.alias("file"), "page_id", "url", "html", size.alias("size")).selectExpr(
        "file", f"row_number() {order} - 1 as seq", f"sum(size) {order} - size as offset", "page_id", "url", "html")


def merkle_levels(leaves: DataFrame, *, fanout: int = FANOUT) -> list[DataFrame]:
    """``leaves`` (file, seq, offset, length, digest) → levels from the leaves up to the roots.

    A level has file, node, first and end (the byte range), digest. A parent's digest is that of
    its children's numbers, lengths and digests in order; at most ``fanout`` meet in a row.
    """
    level = settle(leaves.select("file", F.col("seq").cast("long").alias("node"), F.col("offset").alias("first"),
                                 (F.col("offset") + F.col("length")).alias("end"), "digest"))
    most = level.agg(F.max("node")).first()[0]
    levels = [level]
    while most:
        child = F.struct("node", (F.col("end") - F.col("first")).alias("size"), "digest")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws(
            ":", x["node"].cast("string"), x["size"].cast("string"), x["digest"])), ",")
        level = settle(level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(
            F.min("first").alias("first"), F.max("end").alias("end"), F.sha2(joined, 256).alias("digest")))
        levels.append(level)
        most //= fanout
    return levels


def locate_corruption(ours: list[DataFrame], theirs: list[DataFrame], *, fanout: int = FANOUT) -> DataFrame:
    """Leaves of two replicas' trees that differ: file, seq, offset, length, digest, replica_digest, status.

    ``status`` is changed, missing (in the replica) or extra. Trees of different heights are
    compared from the lower one's top, and equal replicas give no rows.
    """
    top = min(len(ours), len(theirs)) - 1
    bad = None
    for k in range(top, -1, -1):
        a, b = ours[k], theirs[k]
        if bad is not None:
            under = bad.select("file", F.col("node").alias("_up"))
            below = lambda d: d.withColumn("_up", F.floor(F.col("node") / fanout).cast("long")).join(
                under, ["file", "_up"], "left_semi").drop("_up")
            a, b = below(a), below(b)
        both = a.alias("a").join(b.alias("b"), ["file", "node"], "full")
        bad = settle(both.where("not (a.digest <=> b.digest and a.end - a.first <=> b.end - b.first)").select(
            "file", "node", F.coalesce("a.first", "b.first").alias("offset"),
            F.coalesce(F.col("a.end") - F.col("a.first"), F.col("b.end") - F.col("b.first")).alias("length"),
            F.col("a.digest").alias("digest"), F.col("b.digest").alias("replica_digest")))
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return bad.withColumn("status", status).withColumnRenamed("node", "seq")


def hashed(records: DataFrame, record: Column) -> DataFrame:
    """``records`` (file, seq, offset) with the length and digest of each record's bytes."""
    return records.select("file", "seq", "offset", F.octet_length(record).cast("long").alias("length"),
                          F.sha2(record, 256).alias("digest"))


def audit(ours: DataFrame, theirs: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """Two replicas as (file, seq, offset, length, digest) → the records that differ."""
    return locate_corruption(merkle_levels(ours, fanout=fanout), merkle_levels(theirs, fanout=fanout), fanout=fanout)
