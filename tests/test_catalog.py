import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import joins
from millrace.plans.catalog import QUERIES
from millrace.sources import tables
from millrace.streaming import windows
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    compare(spark, *QUERIES[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def stream(spark, query, name, path, mode="append"):
    run = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/c-{name}").trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def streamed(spark, tmp_path):
    """Events in four files in time order, and a last one that closes all windows."""
    batch = spark.read.parquet(f"{SF}/events.parquet")
    rows = batch.orderBy("ts").collect()
    for k in range(4):
        spark.createDataFrame(rows[len(rows) * k // 4 : len(rows) * (k + 1) // 4], batch.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return batch, windows.read_events(spark, f"{tmp_path}/events", batch.schema, 1)


def test_streamed_counts_match_the_batch(spark, tmp_path, streamed):
    batch, events = streamed
    for step in (None, "30 minutes"):
        got = stream(spark, windows.counts(events, step=step), f"counted{bool(step)}", tmp_path, "complete")
        want = batch.withColumn("ts", batch.ts.cast("timestamp")).groupBy(F.window("ts", "1 hour", step).alias("w"), "event_type").count()
        assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(1, at(1), 1, "view", 1.0)], [(2, at(9), 1, "view", 1.0), (1, at(1), 1, "view", 1.0)], [(6, at(9, 1), 1, "view", 1.0)], [(3, at(1, 30), 1, "view", 1.0), (4, at(9, 5), 1, "view", 1.0)], [(5, at(20), 1, "view", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    paths = f"{tmp_path}/in/*"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(paths).withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream(spark, windows.counts(events), "late", tmp_path).collect()
    assert {r.w.start.hour: r.n for r in got} == {1: 2, 9: 3}, got  # the third one came after its window had closed


def test_streamed_duplicates_and_sessions(spark, tmp_path, streamed):
    batch, events = streamed
    batch.limit(50).write.mode("append").parquet(f"{tmp_path}/events")
    assert stream(spark, windows.distinct_events(events, "60 days"), "distinct_ones", tmp_path).count() == batch.count()
    sessions = stream(spark, windows.session_counts(events), "sessions", tmp_path, "complete")
    assert sessions.agg(F.sum("n")).first()[0] == batch.count()  # the rows that came again are too late


def test_streams_joined(spark, tmp_path, streamed):
    batch, events = streamed
    views, errors = (events.where(f"event_type = '{x}'") for x in ("view", "error"))
    got = stream(spark, windows.followed(views, errors, 86_400, "60 days"), "followed", tmp_path)
    want = QUERIES["error_after_view"][0](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_times_without_a_zone(spark, zone):
    at = lambda h, m, s=0: datetime.datetime(2024, 3, 31, h, m, s)
    a = spark.createDataFrame([(1, at(1, 30)), (2, at(2, 30))], "k long, a timestamp_ntz")
    b = spark.createDataFrame([(k, at(*t)) for k in (1, 2) for t in ((1, 30), (2, 30), (2, 30, 1), (3, 30), (3, 31))], "k long, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sorted((r.k, r.b.hour, r.b.minute, r.b.second) for r in joins.within(a, b, "a", "b", 3600, ["k"]).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(1, 1, 30, 0), (1, 2, 30, 0), (2, 2, 30, 0), (2, 2, 30, 1), (2, 3, 30, 0)]
    with pytest.raises(TypeError):
        joins.within(a, b.withColumn("b", F.col("b").cast("timestamp")), "a", "b", 3600, ["k"])


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "quoted", one', 1.5), (2, None, None), (3, "ü", -2.0)], "k long, s string, x double")
    tables.write(df, f"{tmp_path}/t", kind, by=("k",))
    back = tables.read(spark, f"{tmp_path}/t", kind, "s string, x double, k long").select("k", "s", "x")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.where("k = 2").count() == 1
    with pytest.raises(ValueError):
        tables.read(spark, f"{tmp_path}/t", "tar")
