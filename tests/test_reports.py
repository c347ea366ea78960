"""Reports with a range, routing by all filters, merged rows, history order: cases by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from wardstone.functions.conditions import Condition
from wardstone.operators import compliance as G, events as E, privacy as K, versions as V

SUBS = "subscription string, event_types array<string>, categories array<string>, tenant string, dataset string, user_id bigint, expression string, active boolean"
DAY = datetime.datetime(2025, 3, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


@pytest.fixture(scope="module")
def routed(spark):
    return spark.createDataFrame(
        [(1, "key_rotated", "t1", "d1", 7), (2, "key_rotated", None, None, None), (3, None, "t1", "d2", 7), (4, "unheard_of", "t2", "d1", 8)],
        "event_id bigint, event_type string, tenant string, dataset string, user_id bigint")


def routes(events, subs, **kw):
    df = events.sparkSession.createDataFrame(subs, SUBS)
    return sorted((r.subscription, r.event_id) for r in E.route_events(events, df, **kw).collect())


def test_routing_by_dataset_user_and_expression(routed):
    subs = [("set", None, None, None, "d1", None, None, True), ("both", None, None, "t1", "d2", None, None, True), ("user", ["key_rotated"], None, None, None, 7, None, True),
            ("rule", None, None, None, None, None, "high", True), ("sql", None, None, None, None, None, "low", True), ("unknown", None, None, None, None, None, "none such", True),
            ("off", None, None, None, None, None, None, False), ("empty", [], None, None, None, None, None, True)]
    got = routes(routed, subs, expressions={"high": Condition("user_id", "ge", 8), "low": "user_id < 8"})
    # a rule on a null user holds for nothing
    assert got == [("both", 3), ("rule", 4), ("set", 1), ("set", 4), ("sql", 1), ("sql", 3), ("user", 1)]


def test_catch_all_meets_every_event_once(routed):
    every = [("a", None, None, None, None, None, None, True), ("b", ["*", "key_rotated"], ["*", "security"], None, None, None, None, True), ("c", ["key_rotated", "key_rotated"], ["security"], None, None, None, None, True)]
    assert routes(routed, every) == [(s, k) for s in "ab" for k in (1, 2, 3, 4)] + [("c", 1), ("c", 2)]
    assert routes(routed, []) == [] and routes(routed.limit(0), every) == []


def test_users_do_not_meet_subscriptions_of_others(spark):
    """The key of the join holds the user: the plan has no condition left to test on users."""
    n = 2000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit("key_rotated").alias("event_type"), F.col("id").alias("user_id"))
    subs = spark.range(n).select(F.col("id").cast("string").alias("subscription"), F.lit(None).cast("array<string>").alias("event_types"),
                                 F.lit(None).cast("array<string>").alias("categories"), F.col("id").alias("user_id"), F.lit(True).alias("active"))
    out = E.route_events(events, subs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "k_user_id" in plan.split("Join Inner")[1].split("\n")[0]
    assert out.count() == n and out.filter("subscription <> cast(event_id AS string)").count() == 0


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_access_report_is_half_open(spark):
    log = spark.createDataFrame(
        [(at(0), "u", "record", "r1", "read", True), (at(1), "u", "record", "r1", "write", True), (at(2), "u", "record", "r2", "read", None),
         (at(3), "u", "record", "r3", "read", True), (None, "u", "record", "r9", "read", True), (at(1), None, "record", None, None, True)],
        "ts timestamp, user string, kind string, resource string, action string, allowed boolean")
    got = G.access_report(log, "ts", "user", "kind", "resource", F.col("allowed"), ["read"], at(0), at(3))
    cols = ("user", "requests", "reads", "writes", "denied", "resources", "first_at", "last_at")
    assert rows(got, *cols) == [("u", 3, 1, 1, 1, 2, at(0), at(2)), (None, 1, 0, 1, 0, 0, at(1), at(1))]
    whole = G.access_report(log, "ts", "user", "kind", "resource", F.col("allowed"), ["read"])
    assert ("u", 5) in rows(whole, "user", "requests")
    assert G.access_report(log, "ts", "user", "kind", "resource", F.col("allowed"), ["read"], at(9)).count() == 0


def test_framework_security_and_lineage_reports(spark):
    verdicts = spark.createDataFrame([("gdpr", True, 0, at(0)), ("gdpr", None, None, at(1)), ("hipaa", False, 4, at(1)), ("hipaa", True, 0, at(9))], "framework string, compliant boolean, violations int, ts timestamp")
    assert rows(G.framework_report(verdicts, "ts", end=at(9)), "framework", "verdicts", "compliant", "share", "violations") == [("gdpr", 2, 1, 0.5, 0), ("hipaa", 1, 0, 0.0, 4)]
    log = spark.createDataFrame([(at(h), c, u, bad) for h, c, u, bad in [(0, "security", "a", True), (1, "security", "a", True), (2, "access", "b", True), (3, "access", "c", False), (4, "dataset", "d", True), (30, None, None, None)]],
                                "ts timestamp, category string, user string, bad boolean")
    got = G.security_report(log, "ts", F.col("category"), "user", F.col("bad"))
    assert rows(got, "day", "events", "watched", "failures", "failing_actors", "most_by_one") == [(DAY.date(), 5, 4, 3, 2, 2), (at(30).date(), 1, 0, 0, 0, 0)]
    edges = spark.createDataFrame([("a", "b", "copy", at(0)), ("a", "c", "copy", at(1)), ("b", "c", "copy", at(1)), (None, "c", "join", at(1)), ("x", "y", "copy", at(9))], "parent string, child string, kind string, ts timestamp")
    got = G.lineage_report(edges, "ts", "kind", end=at(9))
    assert rows(got, "kind", "edges", "nodes", "sources", "sinks", "most_out", "most_in") == [("copy", 3, 3, 1, 1, 2, 2), ("join", 1, 1, 0, 1, 0, 1)]


def test_ageing_keeps_what_it_cannot_date(spark):
    log = spark.createDataFrame([(1, "threat", at(0)), (2, "threat", at(30)), (3, "other", at(0)), (4, "threat", None), (5, None, at(0))], "id int, kind string, ts timestamp")
    now = F.lit(at(48))
    assert rows(G.age_log(log, "ts", now, {"threat": 1}, "kind"), "id") == [(2,), (3,), (4,), (5,)]
    assert rows(G.age_log(log, "ts", now, {"threat": 1}, "kind", 1), "id") == [(2,), (4,)]


def versions(spark, *three):
    return [spark.createDataFrame(x, "k int, a string, b int") for x in three]


def test_merged_rows(spark):
    base = [(1, "x", 1), (2, "x", 1), (3, "x", 1), (4, "x", 1), (5, "x", 1), (6, None, None), (7, "x", 1)]
    ours = [(1, "x", 1), (2, "o", 1), (3, "x", 1), (5, "o", 1), (6, None, None), (7, "s", 1), (8, "n", 1), (9, "n", 1), (None, None, None)]
    theirs = [(1, "x", 1), (2, "x", 1), (3, "x", 2), (4, "t", 1), (5, "t", 1), (7, "s", 1), (8, "m", 1), (9, "n", 1)]
    three = versions(spark, base, ours, theirs)
    got = rows(V.merge_rows(*three, ["k"]), "k", "a", "b", "source", "conflict")
    # 6 is a row of nulls that theirs deleted and ours left alone: gone, without conflict
    assert got == sorted([
        (1, "x", 1, "base", None), (2, "o", 1, "ours", None), (3, "x", 2, "theirs", None), (4, None, None, "conflict", "delete_modify"),
        (5, None, None, "conflict", "both_modified"), (7, "s", 1, "both", None), (8, None, None, "conflict", "both_added"), (9, "n", 1, "both", None), (None, None, None, "ours", None)], key=repr)
    seen = {r.k: (r.base_row, r.our_row, r.their_row) for r in V.merge_rows(*three, ["k"]).collect()}
    assert seen[4][1] is None and seen[4][2].a == "t" and seen[5][0].a == "x" and seen[1] == (None, None, None)
    # ours deleted 4, so preferring ours leaves it out
    assert rows(V.merge_rows(*three, ["k"], "ours").filter("conflict IS NOT NULL"), "k", "a", "source") == [(5, "o", "ours"), (8, "n", "ours")]
    assert rows(V.merge_rows(*three, ["k"], "theirs").filter("conflict IS NOT NULL"), "k", "a") == [(4, "t"), (5, "t"), (8, "m")]
    assert V.merge_rows(*[x.limit(0) for x in three], ["k"]).count() == 0


def test_history_order(spark):
    commits = spark.createDataFrame([("a", at(1), []), ("b", at(5), ["a"]), ("c", at(3), ["b"]), ("d", at(5), ["c"])], "commit string, time timestamp, parents array<string>").withColumn("author", F.lit("x")).withColumn("email", F.lit("x")).withColumn("message", F.lit("m"))
    edges = commits.select("commit", F.posexplode("parents").alias("ord", "parent"))
    heads = spark.createDataFrame([("m", "d")], "root string, commit string")

    def order(sort, **kw):
        return [r.commit for r in V.history(commits, edges, heads, sort=sort, **kw).orderBy("rank").collect()]

    assert order("topological") == ["d", "c", "b", "a"]
    assert order("chronological") == ["a", "c", "d", "b"]
    assert order("reverse") == ["d", "b", "c", "a"]  # one time: walk order
    assert order("chronological", skip=1, limit=2) == ["c", "b"]  # pages count in walk order
    with pytest.raises(KeyError):
        order("sideways")


def test_zero_concentrated_budget_adds_up(spark):
    df = spark.createDataFrame([("d", k, 0.4) for k in range(5)], "dataset string, at int, epsilon double")
    out = K.privacy_ledger(df, "dataset", ["at"], "epsilon", None, 1.0, "zero_concentrated")
    assert rows(out, "at", "accepted", "charged_micro") == [(k, k < 2, 400000 if k < 2 else 0) for k in range(5)]
