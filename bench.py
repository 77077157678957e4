"""Time the headline queries, and bars and levels over a dense stored tape; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name prefix ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "bars_base", "vap_levels", "session_absorption", "range_scale", "ribbon_lines", "regime_label",
    "swings", "structure_events", "profile_readings", "value_area", "card_shape", "card_profile",
    "history_percentiles", "session_catalog", "trade_book", "trade_stats", "bracket_outcomes",
    "sweep_ranked", "walk_forward_oos", "prevailing_quote", "forward_returns", "snapshot")


COPIES = 200        # of the events, a month each: 20 million ticks of one symbol at sf0.1


def throughput(spark, sf_dir: str) -> dict:
    """Ticks a second from stored files to 30 s bars and to volume at price."""
    import tempfile

    from pyspark.sql import functions as F
    from tickframe.operators import bars as B
    from tickframe.plans import market as M
    from tickframe.sources.bars import TICK_COLUMNS, read_ticks

    path = tempfile.mkdtemp(prefix="tickframe-bench-") + "/ticks"
    month = F.make_interval(days=F.col("copy") * 31)
    rows = M.ticks(spark, sf_dir, "ALL").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    (rows.withColumn("ts", F.col("ts") + month + F.make_interval(secs=F.pmod("seq", F.lit(60))))
     .repartitionByRange(16, "copy", "ts").sortWithinPartitions("copy", "ts", "seq")
     .select("symbol", *TICK_COLUMNS).write.parquet(path))
    ticks = read_ticks(spark, path)
    count, out = ticks.count(), {}
    for name, made in (("bars_30s", B.fold_ticks(ticks, 30)), ("levels_30s", B.price_levels(B.back_adjust(ticks), 30))):
        start = time.time()
        made.write.format("noop").mode("overwrite").save()
        took = time.time() - start
        out[name] = {"ticks": count, "sec": round(took, 3), "ticks_per_sec": round(count / took)}
    return out


def main():
    from pyspark.sql import SparkSession
    from tickframe.plans.registered import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tickframe-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    dense = {} if wanted else throughput(spark, sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "dense": dense}))


if __name__ == "__main__":
    main()
