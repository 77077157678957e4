"""Published runs and captured streams."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tickframe.operators.series import shared_folder
from tickframe.plans import registered as R
from tickframe.sources import capture as CP
from tickframe.sources import results as RS


def folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def test_a_run_written_again_replaces_the_first(spark):
    path = folder(spark)
    trades = lambda n: spark.range(n).select(F.col("id").alias("num"), (F.col("id") * 1.5).alias("pnl"))
    folds = spark.createDataFrame([(0, '{"lookback": 5}', float("inf")), (1, '{"lookback": 9}', 2.0)], "fold int, best string, score double")
    RS.publish_run(spark, path, "a", {"trades": trades(5), "folds": folds, "stats": trades(1)}, {"symbol": "NQ"})
    RS.publish_run(spark, path, "b", {"trades": trades(2)})
    RS.publish_run(spark, path, "a", {"trades": trades(3), "folds": folds.where("fold = 1"), "stats": trades(0)}, {"symbol": "ES"})
    assert RS.read_run(spark, path, "a", "trades").count() == 3 and RS.read_run(spark, path, "b", "trades").count() == 2
    assert [(r.fold, r.best, r.score) for r in RS.read_run(spark, path, "a", "folds").collect()] == [(1, '{"lookback": 9}', 2.0)]
    empty = RS.read_run(spark, path, "a", "stats")
    assert empty.count() == 0 and empty.columns == ["num", "pnl"]
    known = {r.run_id: r for r in RS.manifests(spark, path).collect()}
    assert json.loads(known["a"].about) == {"symbol": "ES"} and known["a"].rows == {"trades": 3, "folds": 1, "stats": 0}
    assert RS.stale(spark, path).count() == 1


def test_a_run_that_broke_off_is_never_read(spark):
    path = folder(spark)
    good = spark.range(4)
    RS.publish_run(spark, path, "a", {"trades": good})
    with pytest.raises(Exception):
        RS.publish_run(spark, path, "a", {"trades": spark.range(9), "folds": spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))})
    assert RS.read_run(spark, path, "a", "trades").count() == 4 and RS.manifests(spark, path).count() == 1
    for run, table in (("a", "folds"), ("z", "trades")):
        with pytest.raises(ValueError):
            RS.read_run(spark, path, run, table)


def test_capture_keeps_events_once_and_broken_lines_apart(spark):
    R._stateful(spark)
    home = folder(spark)
    trade = '[{"symbolId": "X", "price": 1.5, "timestamp": "2024-01-01T10:00:%02dZ", "type": 1, "volume": 3}]'
    line = lambda event, payload, recv="2024-01-01 10:00:00": json.dumps(
        {"recv": recv, "event": event, "contract": "X", "payload": payload})
    quote = '{"bestBid": 1.0, "lastUpdated": "2024-01-01T10:00:01Z"}'
    files = [[line(CP.TRADE_EVENT, trade % 1), line(CP.TRADE_EVENT, trade % 1), line(CP.QUOTE_EVENT, quote), '{"recv": "2024', "no json",
              line("GatewayDepth", "[]")],
             [line(CP.TRADE_EVENT, trade % 1, "2024-01-01 10:00:05"), line(CP.TRADE_EVENT, trade % 2), line(CP.TRADE_EVENT, "oops"),
              line(CP.QUOTE_EVENT, "{}"), line(CP.TRADE_EVENT, trade % 3, "no time"), line(CP.QUOTE_EVENT, '["X", %s]' % quote.replace("1.0", "2.0"))]]
    for lines in files:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{home}/in")
        for q in CP.ingest(CP.stream_capture(spark, f"{home}/in"), f"{home}/out", f"{home}/log", "10 minutes", {"availableNow": True}):
            q.awaitTermination()
    trades = spark.read.parquet(f"{home}/out/trades").collect()
    assert sorted((r.symbol, r.ts.second, r.price, r.volume, r.side) for r in trades) == [("X", 1, 1.5, 3, -1), ("X", 2, 1.5, 3, -1)]
    assert sorted((r.bid, r.ask) for r in spark.read.parquet(f"{home}/out/quotes").collect()) == [(1.0, None), (2.0, None)]
    assert spark.read.parquet(f"{home}/out/broken").count() == 5
