"""What must hold so that figures grow no faster than the input."""

import re

import pytest
from pyspark.sql import functions as F

from wardstone import session as SE
from wardstone.functions.patterns import ASCII_EDGE, PROFILES
from wardstone.operators import lineage as L, throttle as TH, versions as V
from wardstone.streaming import jobs as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_grow_along_edges_to_their_target(spark, no_broadcast, monkeypatch):
    """a partial path meets only the edges that lead to its own target, not all out of its node."""
    seen, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: (seen.append((df.columns, plan(df))), cut(df))[1])
    edges = [("r", "h"), ("r", "g"), ("g", "h"), ("h", "r"), ("h", "h")] + [("h", f"t{k}") for k in range(20)]
    pairs = [("r", f"t{k}") for k in range(20)] + [("r", "t3"), ("r", "r"), ("x", "t1"), ("h", None)]
    paths = L.find_paths(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(pairs, "source string, target string"), 3)
    got = sorted(">".join(r.path) for r in paths.collect())
    assert got == sorted([f"r>{x}h>t{k}" for x in ("", "g>") for k in [*range(20), 3]])
    steps = [p for columns, p in seen if "path" in columns]
    assert steps and not any(re.search(r"Join \[node#\d+\]", p) for p in steps)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_of_a_table(spark, tmp_path, parts):
    """a table may be one file or a folder of parts."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows.repartition(parts).write.parquet(str(tmp_path / "raw"))
    if parts == 1:
        next((tmp_path / "raw").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "raw").rename(tmp_path / "documents.parquet")
    rows.withColumn("doc_id", -F.col("doc_id") - 1).write.parquet(str(tmp_path / "other.parquet"))
    got = ST.run(ST.read_stream(spark, str(tmp_path), "documents"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(50))


def test_versions_are_not_gathered(spark, no_broadcast):
    """rows meet the version after theirs without being shuffled by version."""
    rows = [(v, k, f"h{k}", "blob", 1) for v in (1, 3) for k in (1, 2, 2, None)] + [(3, 9, "new", "blob", 1)]
    stats = V.version_stats(spark.createDataFrame(rows, "version int, key int, hash string, kind string, size bigint"))
    assert "BroadcastHashJoin" in plan(stats)
    got = {r.version: (r.added, r.modified, r.deleted, r.records, r["size"]) for r in stats.collect()}
    assert got == {1: (4, 0, 0, 4, 4), 3: (1, 0, 0, 7, 7)}


def test_partitions_of_nodes_follow_their_number(spark, no_broadcast, monkeypatch):
    """what a task holds does not grow with the graph."""
    monkeypatch.setattr(SE, "PART_ROWS", 100)
    nodes = spark.range(2000).select(F.col("id").cast("string").alias("node")).union(spark.createDataFrame([(None,)], "node string"))
    edges = nodes.select((F.col("node").cast("int") - F.col("node").cast("int") % 10).cast("string").alias("source"), F.col("node").alias("target")).filter("source <> target")
    leaves, roots = L.graph_leaves(nodes, edges), L.graph_roots(nodes, edges)
    assert {int(n) for n in re.findall(r"hashpartitioning\(node#\d+, (\d+)\)", plan(leaves))} == {39}
    assert leaves.count() == 1801 and {r.node for r in roots.collect()} == {None, *(str(k) for k in range(0, 2000, 10))}


def test_jobs_of_a_busy_key_do_not_grow_with_its_chunks(spark, monkeypatch):
    """the logs at the start of the chunks are found in one pass, however many there are."""
    calls, cut = [], TH.cut
    monkeypatch.setattr(TH, "cut", lambda df: (calls.append(1), cut(df))[1])
    times = [((k * k * 7919) % 97) * 10_000 + k * 60_000 for k in range(400)]
    df = spark.createDataFrame([(k, None if k % 200 == 7 else t) for k, t in enumerate(times)], "i int, us bigint").select("i", F.lit("a").alias("k"), F.timestamp_micros("us").alias("at"))
    log, want = [], {k: True for k in range(400) if k % 200 == 7}
    for t, k in sorted((t, k) for k, t in enumerate(times) if k not in want):
        log = [x for x in log if t - x <= 2_000_000]
        want[k] = len(log) < 3
        log += [t] * want[k]
    used = []
    for rows in (200, 25):
        calls.clear()
        got = {r.i: r.allowed for r in TH.sliding_limit(df, "k", "at", "i", None, 3, 2, chunk_rows=rows).collect()}
        assert got == want
        used.append(len(calls))
    assert used[0] == used[1]


def test_a_known_first_character_is_looked_for_first(spark):
    """the edge of a word is tried only where its first character is; matches stay the same."""
    fast = [p for p in PROFILES["cli"] if p.java.startswith(("(?=", "(?i)(?="))]
    assert {p.name for p in PROFILES["cli"]} - {p.name for p in fast} == {"email"}
    texts = ["call 555-123-4567 or 5551234567, _555-123-4567 é555.123.4567", "Ab Cd Éf Gh Ij X12345678 xX12345678 AB1234567", "12 Oak st, 1 b Ave; mrn:1234567 aMRN1234567 DNA-abcdefghij1",
             "1.2.3.4 a1.2.3.4 1/2/2024 4111 1111 1111 1111 acc 12345678 Acct#123456789", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in [p for name in ("agent", "service", "cli") for p in PROFILES[name]]:
        plain = p.regex.replace(r"\b", ASCII_EDGE)
        for r in df.select("t", F.regexp_extract_all("t", F.lit(p.java), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect():
            assert r.a == r.b, (p.name, r.t)
