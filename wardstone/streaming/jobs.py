"""Structured Streaming forms of the operators.

Every stateful query carries a ten-minute watermark; rows from before the watermark that the last
batch went by get no verdict and count nowhere. The state of a limiter is dropped by an event-time
timer at the moment from which it equals that of a key never seen, so dropping it changes no
verdict: rows from before that moment come too late to be judged. Counts by key are kept by day. Sinks are append-only Parquet folders;
queries in update mode add the batch number, and readers keep the newest row per key, so a
replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import anonymize as A
from ..operators.throttle import TOKEN, refill
from ..session import workspace

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of parts, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, which may match a file; a plain path of a stream must be a folder
    return reader.parquet(f"{folder}/{name}[.]parquet")


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, WATERMARK)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, then return the sink's rows (newest batch per row in update mode
    is the caller's ``latest``)."""
    spark = stream.sparkSession
    out, marks = workspace(spark, "sink"), workspace(spark, "progress")
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            # one folder per batch: a repeated batch overwrites its own folder
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

        query = writer.foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.schema(_with_batch(stream, mode)).parquet(out)
    return rows if mode == "append" else rows.drop("number")


def _with_batch(stream: DataFrame, mode: str):
    from pyspark.sql.types import IntegerType, StructType

    if mode == "append":
        return stream.schema
    return StructType(stream.schema.fields).add("batch", IntegerType())


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


# ------------------------------------------------------------------------------ stateless
def anonymize_stream(stream: DataFrame, text: str, config: A.Config = A.DEFAULT) -> DataFrame:
    return A.anonymize(stream, text, config)


def route_stream(stream: DataFrame, route_of: Callable[[DataFrame], DataFrame], sinks: dict[str, str], other: str) -> None:
    """Split each micro-batch over several sinks by its ``route`` column. Records whose route has
    no sink (or is null) go to ``other``, with their route: none is lost."""
    marks = workspace(stream.sparkSession, "progress")

    def put(batch: DataFrame, number: int) -> None:
        routed = route_of(batch).persist()
        for route, path in sinks.items():
            routed.filter(F.col("route") == route).drop("route").write.mode("overwrite").parquet(f"{path}/number={number}")
        known = F.coalesce(F.col("route").isin(*sinks), F.lit(False))
        routed.filter(~known).write.mode("overwrite").parquet(f"{other}/number={number}")
        routed.unpersist()

    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


# ------------------------------------------------------------------------------ stateful, built in
def window_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    timed = event_time(stream)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def rate_counters(stream: DataFrame, key: str, width: str = "1 hour") -> DataFrame:
    timed = event_time(stream)
    return timed.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("bucket_start"), "requests")


def usage(stream: DataFrame, key: str) -> DataFrame:
    """Use of each key and day, whose state goes with the day; ``total_usage`` sums days up."""
    return event_time(stream).groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.max("ts").alias("last_used"), F.count("*").alias("requests")).select(
        key, F.col("w.start").alias("day"), "last_used", "requests")


def total_usage(rows: DataFrame, key: str) -> DataFrame:
    return latest(rows, [key, "day"]).groupBy(key).agg(F.max("last_used").alias("last_used"), F.sum("requests").alias("requests"))


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One record per key while the key is inside the watermark."""
    return event_time(stream).dropDuplicatesWithinWatermark(keys)


# ------------------------------------------------------------------------------ stateful, custom
def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # the rows of one key in one micro-batch, whose size the trigger bounds
    return pd.concat(list(frames)).sort_values(["ts_us", "event_id"], kind="stable")


def _keyed(stream: DataFrame, key: str, *more) -> DataFrame:
    # ts stays, since it carries the watermark
    return event_time(stream).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("ts_us"), "event_id", *more).groupBy("key")


def _keep_until(state: GroupState, value: tuple, neutral_us: int) -> None:
    """Keep a state up to the time from which it equals none at all."""
    state.update(value)
    state.setTimeoutTimestamp(max(neutral_us // 1000, state.getCurrentWatermarkMs()) + 1)


def token_bucket_stream(stream: DataFrame, key: str, rate: int, burst: int) -> DataFrame:
    """State per key: tokens and time of the last request."""
    cap = burst * TOKEN

    def step(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(frames)
        level, before = state.get if state.exists else (cap, None)
        out = []
        for ts, event in zip(rows["ts_us"], rows["event_id"]):
            ts = int(ts)
            level, ok = refill(level, 0 if before is None else max(0, ts - before) * rate, cap)
            before = ts if before is None else max(before, ts)  # a late request gains nothing
            out.append((name[0], int(event), ok, level // TOKEN))
        _keep_until(state, (level, before), before + -(-(cap - level) // rate))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "remaining"])

    return _keyed(stream, key).applyInPandasWithState(
        step, "key string, event_id bigint, allowed boolean, remaining bigint", "level bigint, before bigint", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_limit_stream(stream: DataFrame, key: str, limit: int, window_seconds: int) -> DataFrame:
    """State per key: the accepted times inside the window, at most ``limit``."""
    width = window_seconds * 1_000_000

    def step(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(frames)
        log = [int(x) for x in state.get[0]] if state.exists else []
        out = []
        for ts, event in zip(rows["ts_us"], rows["event_id"]):
            log = [t for t in log if ts - t <= width]
            ok = len(log) < limit
            if ok:
                log.append(int(ts))
            out.append((name[0], int(event), ok))
        last = int(rows["ts_us"].max())
        _keep_until(state, (log,), max([last, *(t + width for t in log)]))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    return _keyed(stream, key).applyInPandasWithState(
        step, "key string, event_id bigint, allowed boolean", "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def lockout_stream(stream: DataFrame, key: str, failed: str, succeeded: str, max_failures: int = 5, lock_seconds: int = 900) -> DataFrame:
    """State per key: recent failures since the last success, and the lock in force. Only the
    last ``max_failures`` failure times matter for the verdict, but the count is reported, so
    the log holds the window."""
    width = lock_seconds * 1_000_000

    def step(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(frames)
        log, until = ([int(x) for x in state.get[0]], int(state.get[1])) if state.exists else ([], 0)
        out = []
        for ts, event, kind in zip(rows["ts_us"], rows["event_id"], rows["event_type"]):
            if kind == succeeded:
                log, until = [], 0
            elif kind == failed:
                held = until > ts
                log = [t for t in log if t > ts - width] + [int(ts)]
                locks = len(log) >= max_failures
                until = int(ts) + width if locks else until
                out.append((name[0], int(event), len(log), locks, held))
        if log or until:
            _keep_until(state, (log, until), max([until, *(t + width for t in log)]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "attempts", "locks", "was_locked"])

    return _keyed(stream, key, "event_type").applyInPandasWithState(
        step, "key string, event_id bigint, attempts bigint, locks boolean, was_locked boolean", "log array<bigint>, until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def reservoir_stream(stream: DataFrame, key: str, seed: str, n: int, cells: int = 16) -> DataFrame:
    """Bottom-n by hash, kept per cell (leading hash digit): the sample is the bottom n of the
    union of the cells' rows, so the state spreads over the cells."""
    from ..functions.ordering import hash_key

    h = hash_key(seed, F.col(key))
    hashed = stream.select(F.pmod(F.hash(key), F.lit(cells)).cast("string").alias("cell"), F.col(key).alias("id"), h.alias("h"))

    def step(name, frames, state: GroupState):
        kept = [tuple(x) for x in zip(state.get[0], state.get[1])] if state.exists else []
        for f in frames:
            kept = sorted({*kept, *zip(f["h"], (int(i) for i in f["id"]))})[:n]
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame([(name[0], [k[0] for k in kept], [k[1] for k in kept])], columns=["cell", "hashes", "ids"])

    return hashed.groupBy("cell").applyInPandasWithState(
        step, "cell string, hashes array<string>, ids array<bigint>", "hashes array<string>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)
