"""A stream of several files gives the rows of the batch form."""

import time

import pytest
from pyspark.sql import functions as F

from wardstone.operators import anonymize as A, events as E, throttle as TH
from wardstone.streaming import jobs as ST


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in four files, oldest first."""
    out = str(tmp_path_factory.mktemp("stream"))
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("user_id") % 5)
    q = df.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    for i, (lo, hi) in enumerate(zip([-1, *q], [*q, 1e18])):
        df.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.parquet(f"{out}/part{i}")
    return out, df


def stream(spark, folder):
    schema = spark.read.parquet(folder[0] + "/part0").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder[0])


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_token_bucket_stream(spark, folder):
    got = ST.run(ST.token_bucket_stream(stream(spark, folder), "user_id", 1, 2)).select("event_id", "allowed", "remaining")
    want = TH.token_bucket(folder[1], "user_id", "ts", "event_id", F.to_date("ts"), 1, 2).select("event_id", "allowed", "remaining")
    assert same(got, want)


def test_lockout_stream(spark, folder):
    got = ST.run(ST.lockout_stream(stream(spark, folder), "user_id", "error", "signup", 2, 86400)).select("event_id", "attempts", "locks", "was_locked")
    want = E.brute_force(folder[1], "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup", F.to_date("ts"), 2, 86400)
    assert same(got, want.select("event_id", "attempts", "locks", "was_locked"))


def test_window_counts_stream(spark, folder):
    got = ST.latest(ST.run(ST.window_counts(stream(spark, folder), "1 day"), "update"), ["window_start", "event_type"])
    assert same(got.select("window_start", "event_type", "n"), E.event_counts(folder[1], "ts", "1 day"))


def test_anonymize_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(10)], "id int, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = ST.run(ST.anonymize_stream(s, "text").select("id", "text"))
    assert same(got, A.anonymize(df, "text").select("id", "text"))


def remaining_state(spark, tmp_path, job):
    """State rows after 40 keys on one day, one key two days on and one more another two days on."""
    day = 86_400
    for n, (first, keys) in enumerate([(0, range(40)), (2 * day, [50]), (4 * day, [51])]):
        rows = [(k, 100 * n + k, 1_704_067_200 + first + k, "error") for k in keys]
        spark.createDataFrame(rows, "user_id bigint, event_id bigint, s bigint, event_type string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / f"in/part{n}"))
        time.sleep(0.1)
    schema = spark.read.parquet(str(tmp_path / "in/part0")).schema
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job(source).writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).outputMode("update" if job in (usage,) else "append").foreachBatch(lambda d, n: d.count() and None).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def usage(s):
    return ST.usage(s, "user_id")


@pytest.mark.parametrize("job", [lambda s: ST.token_bucket_stream(s, "user_id", 1, 2), lambda s: ST.sliding_limit_stream(s, "user_id", 2, 60),
                                 lambda s: ST.lockout_stream(s, "user_id", "error", "signup", 3, 60), usage], ids=["bucket", "sliding", "lockout", "usage"])
def test_state_is_dropped(spark, tmp_path, job):
    sizes = remaining_state(spark, tmp_path, job)
    assert sizes[0] == 40 and sizes[-1] <= 2


def test_sliding_stream_equals_batch(spark, folder):
    got = ST.run(ST.sliding_limit_stream(stream(spark, folder), "user_id", 2, 7200)).select("event_id", "allowed")
    assert same(got, TH.sliding_limit(folder[1], "user_id", "ts", "event_id", None, 2, 7200, chunk_rows=50).select("event_id", "allowed"))


def test_usage_stream(spark, folder):
    got = ST.total_usage(ST.run(ST.usage(stream(spark, folder), "user_id"), "update"), "user_id")
    assert same(got, folder[1].groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_used"), F.count("*").alias("requests")))


def test_late_requests_get_no_verdict(spark, tmp_path):
    start = 1_704_067_200
    for n, rows in enumerate([[(1, 1, start)], [(2, 2, start + 7200)], [(1, 3, start + 7200 - 300)], [(1, 4, start + 60)]]):
        spark.createDataFrame(rows, "user_id bigint, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        time.sleep(0.1)
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "part0")).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = ST.run(ST.sliding_limit_stream(s, "user_id", 1, 60)).select("event_id", "allowed").collect()
    assert {tuple(r) for r in got} == {(1, True), (2, True), (3, True)}  # 3 is five minutes late, 4 is two hours late
