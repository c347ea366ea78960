"""Cases that once lost data or switched a protection off."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from wardstone.functions.jsontext import leaves
from wardstone.functions.patterns import CATEGORY_OF_TYPE, PROFILES
from wardstone.operators import anonymize as A, compliance as G, detect as D, lineage as L, privacy as K, sampling as M, throttle as T, versions as V
from wardstone.sources import io as IO
from wardstone.streaming import jobs as ST
from wardstone.session import workspace


def requests(spark, key, n=30):
    start = datetime.datetime(2025, 1, 1)
    rows = [(key, start + datetime.timedelta(milliseconds=10 * k), k) for k in range(n)]
    return spark.createDataFrame(rows, "user string, ts timestamp, id bigint")


@pytest.mark.parametrize("key", [None, "u"])
def test_requests_without_a_key_are_limited(spark, key):
    df = requests(spark, key)
    sliding = T.sliding_limit(df, "user", "ts", "id", F.lit(0), 3, 60)
    assert sliding.filter("allowed").count() == 3 and {r.user for r in sliding.collect()} == {key}
    for chunk in (1000, 4):
        bucket = T.token_bucket(df, "user", "ts", "id", F.lit(0), 1, 2, chunk_rows=chunk)
        assert bucket.filter("allowed").count() == 2 and {r.user for r in bucket.collect()} == {key}


def test_integer_keys_keep_their_type(spark):
    df = requests(spark, None).unionByName(requests(spark, "7")).withColumn("user", F.col("user").cast("bigint"))
    out = T.sliding_limit(df, "user", "ts", "id", F.lit(0), 3, 60)
    assert dict(out.dtypes)["user"] == "bigint" and {(r.user, r.n) for r in out.filter("allowed").groupBy("user").agg(F.count("*").alias("n")).collect()} == {(None, 3), (7, 3)}


def test_ledger_of_a_null_dataset(spark):
    df = spark.createDataFrame([(None, k, 1.0) for k in range(30)] + [("d", k, 1.0) for k in range(30)], "dataset string, at int, epsilon double")
    got = {(r.dataset, r.n) for r in K.privacy_ledger(df, "dataset", ["at"], "epsilon", F.lit(0), 3.0).filter("accepted").groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 3), ("d", 3)}


def test_verdict_of_a_null_scope(spark):
    records = spark.createDataFrame([(None,), ("s",)], "scope string")
    bad = spark.createDataFrame([(None, "gdpr", "critical", 1), ("s", "gdpr", "critical", 1)], "scope string, framework string, severity string, violations int")
    assert {r.compliant for r in G.verdicts(records, bad, ["scope"], ["gdpr"]).collect()} == {False}


def test_rows_with_a_null_group_stay(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "g", "c")], "id int, grp string, v string")
    assert sorted(r.v for r in A.shuffle_column(df, "v", "id", ["grp"]).collect()) == ["a", "b", "c"]
    hits = D.detect(spark.createDataFrame([(1, None, "a@b.org")], "id int, source string, text string").withColumn("field", F.lit("text")), "text", ["source", "field", "id"])
    assert D.pii_inventory(hits, "source", "field", "id").count() == 1
    old = spark.createDataFrame([(None, 1)], "k string, v int")
    assert IO.ingest_idempotent(spark.createDataFrame([(None, 2), ("x", 3)], "k string, v int"), ["k"], ["v"], old).count() == 1


def test_json_of_any_shape(spark):
    deep = "[" * 40 + '{"k": "write to a@b.org"}' + "]" * 40
    texts = ['{"a": {"mail":"a@b.org"}, "extra":"keep  me", "n":null, "x":1.50, "a@b.org": 1e5}', deep, '{"broken": "a@b.org', '"caf\\u00e9"', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = [r for r in A.anonymize_json(df, "j", A.Config(default_strategy="redact"), counts=True).orderBy("id").collect()]
    assert got[0].j == '{"a": {"mail":"[REDACTED]"}, "extra":"keep  me", "n":null, "x":1.50, "a@b.org": 1e5}'
    assert got[1].j == deep.replace("a@b.org", "[REDACTED]")
    assert got[2].j == '{"broken": "[REDACTED]' and got[3].j == texts[3] and got[4].j is None
    assert [(r.strings_seen, r.strings_changed) for r in got] == [(2, 1), (1, 1), (None, None), (1, 0), (None, None)]
    found = {(r.id, r.path) for r in D.detect_json(df, "j", ["id"]).collect()}
    assert found == {(0, "a.mail"), (1, ".".join(["[0]"] * 40 + ["k"]))}
    only = A.Config(detect=D.DetectConfig(include_types=("credit_card",)), default_strategy="redact")
    assert A.anonymize_json(df.filter("id = 0"), "j", only).first().j == texts[0]
    quoted = spark.createDataFrame([(1, json.dumps({"t": 'say "a@b.org" \\ ok\n'}))], "id int, j string")
    assert json.loads(A.anonymize_json(quoted, "j", A.Config(default_strategy="redact")).first().j) == {"t": 'say "[REDACTED]" \\ ok\n'}


def test_leaves_and_their_places():
    text = '{"a":{"b":["x",{"c":"y\\"z"}]},"k,":"{"}'
    assert [(x["path"], x["value"]) for x in leaves(text)] == [("a.b.[0]", "x"), ("a.b.[1].c", 'y"z'), ("k,", "{")]
    assert all(json.loads(text[x["start"] : x["end"]]) == x["value"] for x in leaves(text))
    assert len(leaves("[" * 3000 + '"deep"' + "]" * 3000)) == 1 and leaves("{") is None


def test_long_matches_are_not_cut(spark):
    from wardstone.functions.patterns import CRITICAL, Pattern

    key = Pattern("long_key", "credentials", r"key=[0-9a-f]{16,}", 0.9, CRITICAL)
    text = "x " * 3900 + "key=" + "ab" * 2002 + " end " + "y " * 4000 + "key=" + "0" * 20
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    got = D.detect_chunked(df, "text", ["id"], D.DetectConfig(extra_patterns=(key,)), size=4000, overlap=100)
    spans = sorted((r.start_pos, r.end_pos) for r in got.filter("pattern = 'long_key'").collect())
    assert spans == [(7800, 7800 + 4008), (text.rindex("key="), len(text))]


def test_every_type_has_a_category():
    assert {p.pii_type for ps in PROFILES.values() for p in ps} <= set(CATEGORY_OF_TYPE)


def test_allow_list_for_any_type(spark):
    hits = spark.createDataFrame([("iban", "DE1"), ("email", "a@b.org"), ("email", "c@d.org")], "pii_type string, value string")
    allow = spark.createDataFrame([("regex", "^DE|^a@", None, True, None)], "kind string, pattern string, pii_type string, active boolean, expires_at timestamp")
    assert [r.value for r in D.suppress_allowlist(hits, allow, F.current_timestamp()).collect()] == ["c@d.org"]


def test_statistics_of_nothing(spark):
    clean = A.anonymize(spark.createDataFrame([(1, "nothing here")], "id int, text string"), "text")
    rows = A.anonymization_stats(clean, "text").collect()
    assert [(r.pii_type, r.found, r.replaced, r.input_length) for r in rows] == [("*", 0, 0, 12)]


def test_two_updates_of_one_version(spark):
    current = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "k int, version int, v string")
    updates = spark.createDataFrame([(1, 1, "x", 2), (1, 1, "y", 1), (2, 4, "z", 1), (None, 1, "m", 1)], "k int, expected_version int, v string, at int")
    got = {(r.k, r.v, r.version, r.outcome, r.conflicts) for r in V.apply_updates(current, updates, "k", "v", ["at"]).collect()}
    assert got == {(1, "y", 2, "updated", 1), (2, "b", 5, "conflict", 1), (None, "m", 2, "updated", 0)}


def test_version_numbers_with_gaps(spark):
    rows = [(v, k, f"h{k}", "blob", 1) for v in (1, 3) for k in range(4)] + [(3, 9, "new", "blob", 1)]
    snap = spark.createDataFrame(rows, "version int, key int, hash string, kind string, size bigint")
    got = {r.version: (r.added, r.modified, r.deleted, r.records) for r in V.version_stats(snap).collect()}
    assert got == {1: (4, 0, 0, 4), 3: (1, 0, 0, 5)}


def test_deep_files_count(spark):
    files = spark.createDataFrame([("a/b/c/d/e/f/g/h.txt", "1"), ("a/x", "2")], "path string, h string")
    root = lambda df: V.tree_hash(df, "path", "h").filter("depth = 0").first().hash
    assert root(files) != root(files.withColumn("h", F.when(F.col("h") == "1", "3").otherwise(F.col("h"))))
    assert V.tree_clashes(files.union(files.withColumn("h", F.lit("9"))), "path", "h").count() == 2


def test_complete_entries(spark):
    turns = spark.createDataFrame([(1, 1, "user", "q"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 1, "user", " "), (4, 1, "user", "q"), (4, 2, "assistant", "")], "c int, t int, role string, text string")
    truth = spark.createDataFrame([(2, 1, "gold")], "c int, t int, ground_truth string")
    got = {r.c: (r.entry_type, r.complete) for r in M.corpus_entries(turns, "c", "t", "role", "text", truth).collect()}
    assert got == {1: ("prompt_only", True), 2: ("ground_truth", True), 3: ("prompt_only", False), 4: ("prompt_response", False)}


def test_records_without_a_sink_go_to_the_other(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, r string").write.parquet(source)
    stream = spark.readStream.schema("id int, r string").parquet(source)
    sinks, other = {"a": workspace(spark, "route-a")}, workspace(spark, "route-other")
    ST.route_stream(stream, lambda b: b.select("id", F.col("r").alias("route")), sinks, other)
    assert spark.read.schema("id int").parquet(sinks["a"]).count() == 1 and spark.read.schema("id int, route string").parquet(other).count() == 2


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    (tmp_path / "good.txt").write_text("mail a@b.org")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe mail c@d.org")
    (tmp_path / "large.txt").write_text("x" * (1 << 21))
    report = {r.path.rsplit("/", 1)[-1]: (r.scanned, r.hits, r.error) for r in IO.file_report(spark, str(tmp_path), max_mb=1).collect()}
    assert report == {"good.txt": (True, 1, None), "bad.txt": (True, 1, "not UTF-8"), "large.txt": (False, 0, "too large")}
    assert IO.scan_files(spark, str(tmp_path), max_mb=1).count() == 2


def test_store_returns_what_it_adds(spark):
    path = workspace(spark, "store")
    put = lambda *texts: sorted(r.payload for r in IO.put_content(spark.createDataFrame([(t,) for t in texts], "t string"), "t", path).collect())
    assert put("a", "b") == ["a", "b"] and put("b", "c", "c") == ["c"]


def test_sanitising_cuts_nothing_unasked(spark):
    from dataclasses import replace

    from wardstone.functions import text as X

    row = spark.createDataFrame([("y " * 20_000,)], "t string").select(F.length(X.sanitize(F.col("t"))).alias("n"), F.length(X.sanitize(F.col("t"), replace(X.STRICT, max_length=50))).alias("m")).first()
    assert (row.n, row.m) == (39_999, 50)


def test_no_cap_scans_every_file(spark, tmp_path):
    (tmp_path / "large.txt").write_text("mail a@b.org\n" + "plain words\n" * 1_000_000)
    report = [(r.scanned, r.hits, r.error) for r in IO.file_report(spark, str(tmp_path), max_mb=None).collect()]
    assert report == [(True, 1, None)] and IO.scan_files(spark, str(tmp_path), max_mb=None).count() == 1


def test_file_queries_report_every_file_at_any_size(spark, tmp_path, monkeypatch):
    """One source of 12 MB in one task, more than the default cap."""
    from wardstone.plans import tables
    from wardstone.plans.registry import QUERIES

    monkeypatch.setattr(tables, "docs", lambda spark, sf: tables.table(spark, sf, "documents").coalesce(1))
    text = F.concat(F.lit("mail a@b.org "), F.repeat(F.lit("plain words "), 340))
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length(text).cast("bigint").alias("n_chars"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.source, r.scanned, r.hits, r.errors) for r in QUERIES["s05_file_report"](spark, str(tmp_path)).collect()] == [("web", True, 3000, 0)]
    assert [r.hits for r in QUERIES["s05_scan_files"](spark, str(tmp_path)).collect()] == [3000]


def plain_walk(pairs, root):
    depth, front = {root: 0}, [root]
    while front:
        found = {p for c, p in pairs if c in front and p not in depth}
        depth |= {p: depth[front[0]] + 1 for p in found}
        front = list(found)
    return depth


def test_walk_over_chains_branches_and_merges(spark):
    rng = random.Random(3)
    pairs, tips = [], [0]
    for c in range(1, 160):  # mostly chains, with some branches and merges of unequal length
        first = tips[-1] if rng.random() < 0.8 else rng.randrange(c)
        pairs.append((c, first))
        if rng.random() < 0.15:
            pairs.append((c, rng.randrange(c)))
        tips.append(c)
    edges = spark.createDataFrame([(c, p, n) for n, (c, p) in enumerate(pairs)], "commit int, parent int, ord int")
    roots = [159, 120, 77, 0]
    starts = spark.createDataFrame([(f"r{r}", r) for r in roots], "root string, commit int")
    got = {}
    for r in V.history_walk(edges, starts).collect():
        assert (r.root, r.commit) not in got
        got[r.root, r.commit] = r.depth
    assert got == {(f"r{r}", c): d for r in roots for c, d in plain_walk(set(pairs), r).items()}


def test_rounds_of_a_long_chain(spark, monkeypatch):
    cuts = []
    for module in (V, L):
        monkeypatch.setattr(module, "cut", lambda df, whole=module.cut: cuts.append(1) or whole(df))
    n = 10_000
    edges = spark.range(1, n).select(F.col("id").alias("commit"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("ord"))
    walk = V.history_walk(edges, spark.createDataFrame([("r", n - 1)], "root string, commit bigint"))
    assert walk.count() == n and walk.filter(F.col("depth") + F.col("commit") == n - 1).count() == n
    assert len(cuts) <= 26  # 14 doublings of pointers, 3 of steps, one a round of the walk


def test_core_of_chains_rings_and_tails(spark):
    ring = [(f"a{k}", f"a{(k + 1) % 500}") for k in range(500)]
    tail = [("a3", "t0")] + [(f"t{k}", f"t{k + 1}") for k in range(300)]
    lone = [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    edges = spark.createDataFrame(ring + tail + lone + [("q", "a9")], "source string, target string")
    assert {tuple(r) for r in L.cyclic_core(edges).collect()} == set(ring + lone)
    assert L.cyclic_core(edges.limit(0)).isEmpty()
