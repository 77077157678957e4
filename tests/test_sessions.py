from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tickframe.functions.columns import session_name
from tickframe.operators import history as H
from tickframe.operators import sessions as S


def stamps(spark, times):
    return spark.createDataFrame([("X", int(t.timestamp())) for t in times], "symbol string, t long").withColumn(
        "ts", F.timestamp_seconds("t"))


def expected(t):
    m = t.astimezone(ZoneInfo("America/New_York"))
    m = m.hour * 60 + m.minute
    if m > 1080 or m <= 180:
        return "Asia"
    return "London" if m <= 480 else "NY" if m <= 1020 else None


def test_every_minute_through_both_clock_changes(spark):
    times = [start + timedelta(minutes=i) for start in (
        datetime(2024, 3, 10, tzinfo=timezone.utc), datetime(2024, 11, 3, tzinfo=timezone.utc)) for i in range(1440)]
    got = {r.t: r.s for r in stamps(spark, times).select("t", session_name("ts").alias("s")).collect()}
    assert got == {int(t.timestamp()): expected(t) for t in times}


def test_seconds_are_floored(spark):
    ny = ZoneInfo("America/New_York")
    times = [datetime(2024, 6, 3, 18, 0, 30, tzinfo=ny), datetime(2024, 6, 3, 3, 0, 30, tzinfo=ny)]
    got = [r.s for r in stamps(spark, times).orderBy(F.desc("t")).select(session_name("ts").alias("s")).collect()]
    assert got == [None, "Asia"]


def day(spark):
    ny = ZoneInfo("America/New_York")
    return stamps(spark, [datetime(2024, 6, 3, h, 30, tzinfo=ny) for h in (1, 2, 4, 5, 9, 10, 17)]).withColumns(
        {c: F.lit(1.0) for c in ("open", "high", "low", "close")})


def test_instances_and_boundaries(spark):
    rows = S.identify(S.label(day(spark)))
    got = [(r.session, r.session_new, r.session_bar) for r in rows.orderBy("t").collect()]
    assert got == [("Asia", True, None), ("Asia", False, None), ("London", True, 1), ("London", False, 2),
                   ("NY", True, 1), ("NY", False, 2), (None, True, None)]
    assert S.instances(rows).count() == 2
    events = [(r.event, r.session) for r in S.boundaries(S.label(day(spark))).orderBy("time", "event").collect()]
    assert events == [("close", "Asia"), ("open", "London"), ("close", "London"), ("open", "NY"), ("close", "NY")]


def test_seal_is_exact_and_drift_is_loud(spark):
    cutoff = H.checked_cutoff("2024-06-03 00:00:00")
    df = spark.createDataFrame([(1717372799,), (1717372800,)], "session_id long")
    assert [r[0] for r in df.orderBy("session_id").select(H.split_label(cutoff)).collect()] == ["explore", "sealed"]
    try:
        H.checked_cutoff("2024-06-03 00:00:00", spark.createDataFrame([(1717372801,)], "cutoff_epoch long"))
    except H.CutoffMismatch:
        pass
    else:
        raise AssertionError("drift passed")


def test_population_has_no_default(spark):
    try:
        H.percentile_table(day(spark), population="whole")
    except ValueError:
        return
    raise AssertionError("unnamed population passed")
