"""Event routing, delivery bookkeeping, lockouts, request metrics (batch form)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.conditions import Condition, Rules, compile_rules
from ..functions.ordering import along, first_n, grouped_index, in_cells, join_same
from ..functions.strategies import hmac_sha256
from ..session import cut
from .audit import category_of

# ---- fixed values: histogram bounds ---------------------------------------------------------
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
SIZE_BUCKETS = [10.0**n for n in range(2, 12)]


def route_events(events: DataFrame, subscriptions: DataFrame, predicate: str | None = None, expressions: dict[str, str | Rules | Condition] | None = None) -> DataFrame:
    """Fan out events to subscriptions. Unset filters (null) let everything pass.

    ``subscriptions``: subscription, event_types, categories, active and, where wanted, tenant,
    dataset, user_id and expression. An expression is the name of one of ``expressions`` (SQL text
    or rules over the events' columns); a name that is not among them matches nothing, and so
    does an expression that is null for an event.

    The shape of a subscription says which filters are set; shape and values are the key of the
    join. An event makes one key for each shape that occurs (at most 24, read from the subscriptions
    beforehand), so subscriptions of other tenants, datasets and users never meet it. '*' in a set
    of types or categories stands for any."""
    fields = [c for c in ("tenant", "dataset", "user_id") if c in subscriptions.columns]

    def labels(col: str) -> Column:
        return F.when(F.col(col).isNull() | F.array_contains(col, "*"), F.array(F.lit("*"))).otherwise(F.array_distinct(col))

    rule = F.col("expression") if "expression" in subscriptions.columns else F.lit(None)
    subs = subscriptions.filter("active").select(
        "subscription", rule.cast("string").alias("s_rule"), *[F.col(c).cast("string").alias(f"s_{c}") for c in fields],
        F.explode(labels("event_types")).alias("s_type"), "categories")
    subs = subs.withColumn("s_category", F.explode(labels("categories"))).drop("categories")
    kind = F.when(F.col("s_type") != "*", "t").when(F.col("s_category") != "*", "c").otherwise("*")
    subs = subs.withColumn("shape", F.concat(kind, *[F.when(F.col(f"s_{c}").isNull(), "-").otherwise("+") for c in fields]))
    subs = subs.withColumn("value", F.when(F.col("shape").startswith("t"), F.col("s_type")).when(F.col("shape").startswith("c"), F.col("s_category")).otherwise(""))
    subs = subs.select("subscription", "s_rule", "s_category", "shape", "value", *[F.coalesce(f"s_{c}", F.lit("")).alias(f"k_{c}") for c in fields])
    shapes = sorted(r.shape for r in subs.select("shape").distinct().collect())

    def key(shape: str) -> Column:
        value = {"t": F.col("event_type"), "c": F.col("__cat")}.get(shape[0], F.lit(""))
        parts = [F.col(c).cast("string") if flag == "+" else F.lit("") for c, flag in zip(fields, shape[1:], strict=True)]
        known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts], value.isNotNull())
        return F.when(known, F.struct(F.lit(shape).alias("shape"), value.alias("value"), *[p.alias(f"k_{c}") for c, p in zip(fields, parts, strict=True)]))

    holds = [F.when(F.expr(r) if isinstance(r, str) else compile_rules(r), F.lit(name)) for name, r in (expressions or {}).items()]
    passed = F.array_compact(F.array(*holds)) if holds else F.array().cast("array<string>")
    pool = events if predicate is None else events.filter(predicate)
    keys = F.array_compact(F.array(*[key(s) for s in shapes or ["*" + "-" * len(fields)]]))
    keyed = pool.withColumn("__cat", category_of(F.col("event_type"))).select("event_id", "__cat", passed.alias("__passed"), F.explode(keys).alias("k"))
    keyed = keyed.select("event_id", "__cat", "__passed", "k.*")
    hit = keyed.join(subs, ["shape", "value", *[f"k_{c}" for c in fields]]).filter(
        ((F.col("s_category") == "*") | (F.col("s_category") == F.col("__cat"))) & (F.col("s_rule").isNull() | F.array_contains("__passed", F.col("s_rule"))))
    # an event has one type and one category, so it meets a subscription at most once
    return hit.select("subscription", "event_id")


def event_counts(events: DataFrame, time_col: str | None = None, width: str = "1 hour") -> DataFrame:
    if time_col is None:
        return events.groupBy("event_type").agg(F.count("*").alias("n"))
    return events.groupBy(F.window(F.col(time_col).cast("timestamp"), width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "event_type", "n")


def recent_events(events: DataFrame, order: list[str], n: int) -> DataFrame:
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent_by_type(events: DataFrame, order: list[str], bucket: Column | None, n: int) -> DataFrame:
    return first_n(events, ["event_type"], order, bucket, n, "rank", descending=True)


def batch_events(events: DataFrame, order: list[str], bucket: Column | None, size: int) -> DataFrame:
    placed = grouped_index(events, ["event_type"], order, bucket, "__pos")
    return placed.withColumn("batch", F.floor((F.col("__pos") - 1) / size)).drop("__pos")


def delivery_stats(deliveries: DataFrame, target: str, ok: Column, time_col: str) -> DataFrame:
    good = F.count_if(ok)
    return deliveries.groupBy(target).agg(
        F.count("*").alias("total"), good.alias("delivered"), F.count_if(~ok).alias("failed"),
        F.round(F.when(F.count("*") == 0, 1.0).otherwise(good / F.count("*")), 6).alias("success_rate"),
        F.max(F.when(ok, F.col(time_col))).alias("last_success"), F.max(F.when(~ok, F.col(time_col))).alias("last_failure"))


def failure_streaks(deliveries: DataFrame, target: str, order: list[str], bucket: Column | None, ok: Column, threshold: int) -> DataFrame:
    """Consecutive failures after each delivery, and whether the target is disabled then."""
    base, bucket, cells = in_cells(deliveries, [target], order, bucket)
    placed = along(base, [target], order, bucket, cells=cells, position="__pos")
    seen = along(placed, [target], order, bucket, cells=cells, maxima={"__good": F.when(ok, F.col("__pos"))})
    streak = F.col("__pos") - F.coalesce("__good", F.lit(0))
    return seen.select(*deliveries.columns, streak.alias("consecutive_failures"), (streak >= threshold).alias("disabled"))


def retry_delay(attempt: Column, base: float = 1.0, multiplier: float = 2.0, longest: int = 60) -> Column:
    return F.least(F.floor(base * F.pow(F.lit(multiplier), attempt - 1)), F.lit(longest)).cast("bigint")


def retry_schedule(attempts: DataFrame, delivery: list[str], order: list[str], bucket: Column | None, time_col: str, max_attempts: int, base: float = 1.0,
                   multiplier: float = 2.0, longest: int = 60) -> DataFrame:
    """Failed attempts numbered per delivery with status, delay and next retry (in seconds)."""
    placed = grouped_index(attempts, delivery, order, bucket, "attempt")
    last = F.col("attempt") >= max_attempts
    delay = F.when(~last, retry_delay(F.col("attempt"), base, multiplier, longest))
    at = F.unix_seconds(F.col(time_col).cast("timestamp")) + F.col("delay")
    return placed.withColumn("status", F.when(last, "permanently_failed").otherwise("failed")).withColumn("delay", delay).withColumn("next_retry", at)


def due_retries(schedule: DataFrame, delivery: list[str], now_seconds: Column) -> DataFrame:
    """Deliveries whose latest attempt is due again."""
    latest = schedule.groupBy(*delivery).agg(F.max_by(F.struct("status", "next_retry", "attempt"), "attempt").alias("l"))
    return latest.filter((F.col("l.status") == "failed") & (F.col("l.next_retry") <= now_seconds)).select(*delivery, F.col("l.attempt").alias("attempt"), F.col("l.next_retry").alias("next_retry"))


def dedup_deliveries(deliveries: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    return deliveries.groupBy(*keys).agg(F.min_by(id_col, F.struct(*order)).alias(id_col), F.count("*").alias("copies"))


def replay_check(requests: DataFrame, nonce: str, signed: str, received: str, id_col: str, validity_seconds: int) -> DataFrame:
    """expired / replay / accepted: only an accepted request uses up its nonce."""
    age = F.unix_seconds(F.col(received).cast("timestamp")) - F.unix_seconds(F.col(signed).cast("timestamp"))
    r = requests.withColumn("__expired", age > validity_seconds)
    first = r.filter(~F.col("__expired")).groupBy(nonce).agg(F.min_by(id_col, F.struct(received, id_col)).alias("__first"))
    return r.join(first, nonce, "left").select(
        *requests.columns, F.when(F.col("__expired"), "expired").when(F.col(id_col) == F.col("__first"), "accepted").otherwise("replay").alias("verdict"))


def sign(payload: Column, key: str) -> Column:
    return hmac_sha256(payload, key)


def rate_buckets(events: DataFrame, key: str, time_col: str, units: list[str] = ("minute", "hour", "day")) -> DataFrame:
    """Fixed-window counters. Minutes are counted once, hours and days add up the minutes."""
    minute = events.groupBy(key, F.date_trunc("minute", time_col).alias("start")).agg(F.count("*").alias("n"))
    out = None
    for unit in units:
        part = minute.groupBy(key, F.lit(unit).alias("unit"), F.date_trunc(unit, "start").alias("bucket_start")).agg(F.sum("n").alias("requests"))
        out = part if out is None else out.unionByName(part)
    return out


def brute_force(events: DataFrame, key: str, time_col: str, tie: str, failed: Column, succeeded: Column, bucket: Column | None, max_failures: int = 5, lock_seconds: int = 900) -> DataFrame:
    """Per failure: failures inside the window since the last success, whether that locks the
    key, and whether it was locked already.

    Successes cut a key into islands. The window count runs in time cells as wide as the
    window; each row also visits the next cell as a guest, so a cell sees all it needs and an
    attack of any length spreads over its cells."""
    width = lock_seconds * 1_000_000
    order = ["ts_us", "tie"]
    base = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("ts_us"), F.col(tie).alias("tie"),
                         *([] if bucket is None else [bucket.alias("b")]), failed.alias("bad"), succeeded.alias("good")).filter("bad OR good")
    base, bucket, cells = in_cells(base, ["key"], order, None if bucket is None else F.col("b"))
    base = base.withColumn("b", bucket)
    cutup = along(base, ["key"], order, F.col("b"), cells=cells, sums={"island": F.col("good").cast("bigint")}).filter("bad")
    cell = F.floor(F.col("ts_us") / width)
    visits = cutup.withColumn("v", F.explode(F.array(F.struct(cell.alias("cell"), F.lit(False).alias("guest")), F.struct((cell + 1).alias("cell"), F.lit(True).alias("guest")))))
    near = W.partitionBy("key", "island", "v.cell").orderBy("ts_us").rangeBetween(-(width - 1), 0)
    peers = W.partitionBy("key", "island", "v.cell", "ts_us").orderBy(F.desc("tie"))
    counted = visits.select("*", (F.count("*").over(near) - F.row_number().over(peers) + 1).alias("attempts")).filter(~F.col("v.guest"))
    locks = F.when(F.col("attempts") >= max_failures, F.col("ts_us") + width)
    timed = along(counted.select("key", "ts_us", "tie", "b", "island", "attempts"), ["key", "island"], order, F.col("b"), cells=cells, maxima={"lock_until": locks})
    # the lock in force before this attempt comes from the row before
    final = along(timed, ["key", "island"], order, F.col("b"), cells=cells, lags={"__held": F.col("lock_until")})
    return final.select(F.col("key").alias(key), F.col("tie").alias(tie), "attempts", (F.col("attempts") >= max_failures).alias("locks"),
                        F.coalesce(F.col("__held") > F.col("ts_us"), F.lit(False)).alias("was_locked"))


def usage_rollup(log: DataFrame, key: str, order: list[str], ip: str) -> DataFrame:
    return log.groupBy(key).agg(F.max(order[0]).alias("last_used"), F.max_by(ip, F.struct(*order)).alias("last_ip"), F.count("*").alias("requests"))


def request_metrics(log: DataFrame, status: str) -> DataFrame:
    n, s = F.count("*"), F.col(status)
    good, client, server = (F.count_if(s.between(lo, lo + 99)) for lo in (200, 400, 500))
    return log.agg(
        n.alias("total"), good.alias("ok"), client.alias("client_errors"), server.alias("server_errors"),
        F.round(F.when(n == 0, 1.0).otherwise(good / F.nullif(n, F.lit(0))), 6).alias("success_rate"),
        F.round(F.when(n == 0, 0.0).otherwise((client + server) / F.nullif(n, F.lit(0))), 6).alias("error_rate"))


def histogram(log: DataFrame, dims: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts per dimension: one counter per bound, then one row per bound."""
    counters = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = log.groupBy(*dims).agg(F.count("*").alias("total"), *counters)
    return wide.select(*dims, "total", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select(*dims, "total", "x.le", "x.n")


#: Cells of a round of the selection, values of one group that may meet in a sort, and its salts.
SELECT_CELLS, SELECT_FEW, SELECT_SALTS = 256, 10_000, 16


def magnitude(x: Column) -> Column:
    """A logarithm of either sign: never falls while x rises, 0 at 0, and finite."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.least(F.ln(F.abs(x)) + 745, F.lit(1500.0)))


def exact_quantiles(log: DataFrame, dims: list[str], value: str, marks: dict[str, float], few: int = SELECT_FEW) -> DataFrame:
    """Interpolated quantiles of each group, exact. Null and NaN values are left out; a group
    without values has null quantiles.

    Distributed selection: a quantile lies between two ranks. One aggregate counts the values of a
    group in SELECT_CELLS cells of its range, and only the cell that holds the rank goes on, with
    its own least and largest value as the next range, until the range is one value or holds at
    most ``few``, which are sorted. All groups and ranks go on together, and no buffer ever holds
    the values of a larger group."""
    x = F.col(value).cast("double")
    keyed = log.select(*[F.col(d).alias(f"__d{k}") for k, d in enumerate(dims)], F.when(~F.isnan(x), x).alias("v"))
    keys = [f"__d{k}" for k in range(len(dims))]
    groups = cut(keyed.groupBy(*keys).agg(F.count("v").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    values = keyed.filter("v IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SELECT_SALTS)).cast("int"))
    places = F.array(*[F.struct(F.lit(n).alias("mark"), (F.lit(m) * (F.col("size") - 1)).alias("place")) for n, m in marks.items()])
    wanted = groups.filter("size > 0").select("*", F.explode(places).alias("p"))
    ends = F.array_distinct(F.array(F.floor("p.place"), F.ceil("p.place")))
    open_ = wanted.select(*keys, F.explode(ends).alias("target"), "size", "lo", "hi").distinct().withColumn("rank", F.col("target"))
    settled = None

    def near(ranges: DataFrame) -> DataFrame:
        """Values joined with the ranges they lie in; ranges are repeated for every salt."""
        salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SELECT_SALTS - 1))))
        return join_same(values, salted, [*keys, "salt"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))

    while True:
        done = open_.filter((F.col("lo") == F.col("hi")) | (F.col("size") <= few))
        settled = done if settled is None else settled.unionByName(done)
        open_ = open_.filter((F.col("lo") < F.col("hi")) & (F.col("size") > few))
        if open_.isEmpty():
            break
        ranges = open_.select(*keys, "lo", "hi").distinct()
        # a range of many magnitudes is cut along logarithms, else evenly: a few rounds either way
        lo, hi, at = (magnitude(F.col(c)) for c in ("lo", "hi", "v"))
        even = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        share = F.when(hi - lo > 1, (at - lo) / (hi - lo)).otherwise(even)
        cell = F.least(F.floor(share * SELECT_CELLS), F.lit(SELECT_CELLS - 1))
        counts = near(ranges).groupBy(*keys, "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(W.partitionBy(*keys, "lo", "hi").orderBy("cell"))  # at most SELECT_CELLS rows
        counts = counts.withColumn("upto", upto)
        both = join_same(open_, counts, [*keys, "lo", "hi"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        open_ = cut(both.select(*keys, "target", F.col("n").alias("size"), F.col("least").alias("lo"), F.col("most").alias("hi"),
                                (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    small = settled.filter("lo < hi").select(*keys, "lo", "hi").distinct()
    lists = near(small).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("values"))
    picked = join_same(settled, lists, [*keys, "lo", "hi"], "left")
    found = picked.select(*keys, "target", F.coalesce(F.get("values", F.col("rank").cast("int")), F.col("lo")).alias("found"))
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("target", "found"))).alias("found"))  # two for each mark
    whole = join_same(groups.select(*keys, "size"), held, keys, "left")

    def quantile(m: float) -> Column:
        place = F.lit(m) * (F.col("size") - 1)
        low, high = (F.try_element_at("found", e(place)) for e in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return whole.select(*[F.col(k).alias(d) for k, d in zip(keys, dims, strict=True)], *[F.round(quantile(m), 6).alias(n) for n, m in marks.items()])


def latency_quantiles(log: DataFrame, dims: list[str], value: str, exact: bool = True) -> DataFrame:
    marks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        return exact_quantiles(log, dims, value, marks)
    return log.groupBy(*dims).agg(*[F.approx_percentile(value, m).alias(n) for n, m in marks.items()])


def trace_rollup(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per operation: spans, mean duration, error share. Per parent: number and duration of children."""
    per = spans.groupBy("operation").agg(
        F.count("*").alias("spans"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.round(F.avg((F.col("status") == "error").cast("int")), 6).alias("error_share"))
    kids = spans.filter("parent_span IS NOT NULL").groupBy(F.col("parent_span").alias("span")).agg(F.count("*").alias("children"), F.round(F.sum("duration"), 6).alias("child_duration"))
    return per, spans.select("span", "operation").join(kids, "span", "left").select("span", "operation", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("child_duration", F.lit(0.0)).alias("child_duration"))


def threat_rows(parts: list[DataFrame]) -> DataFrame:
    """Typed threat rows (key, kind, level, at) keyed by address, else user."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
