import hashlib
import hmac
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardstone.functions import conditions as X, strategies as R, text as T
from wardstone.functions.ordering import along, first_n, fold_hashes
from wardstone.operators import access as AC, audit as U, content as C, events as E, lineage as L, privacy as K, quality as Q, sampling as M, throttle as TH, versions as V
from wardstone.sources import io as S


# ------------------------------------------------------------------ ordered helpers
def test_along_matches_plain_windows_with_a_dominant_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(10_000), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v int")
    got = along(df, ["g"], ["t", "i"], F.floor(F.col("t") / 500), position="p", sums={"s": F.col("v")}, maxima={"hi": F.col("v")},
                minima={"lo": F.col("v")}, lags={"before": F.col("i")}, leads={"after": F.col("i")})
    want = []
    for g in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        s = 0
        for n, r in enumerate(seq):
            s += r[3]
            vs = [x[3] for x in seq[: n + 1]]
            want.append((*r, n + 1, s, max(vs), min(vs), seq[n - 1][2] if n else None, seq[n + 1][2] if n + 1 < len(seq) else None))
    key = lambda r: r[2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_first_n_and_folding(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    top = first_n(df, ["g"], ["id"], F.floor(F.col("id") / 10), 7, descending=True)
    assert {(r.g, r.id, r.position) for r in top.collect()} == {(g, 998 + g - 2 * n, n + 1) for g in (0, 1) for n in range(7)}
    a = fold_hashes(df.withColumn("x", F.col("h")), ["g"], "h", "x").orderBy("g").collect()
    b = fold_hashes(df.repartition(7).withColumn("x", F.col("h")), ["g"], "h", "x").orderBy("g").collect()
    assert a == b and [r.entries for r in a] == [500, 500]


# ------------------------------------------------------------------ throttling
def simulate(times, rate, burst):
    level, before, out = burst * TH.TOKEN, None, []
    for t in times:
        level, ok = TH.refill(level, 0 if before is None else (t - before) * rate, burst * TH.TOKEN)
        before = t
        out.append((ok, level // TH.TOKEN))
    return out


def test_step_functions_agree_with_replay():
    rng = random.Random(3)
    for _ in range(200):
        burst = rng.randrange(1, 6)
        cap = burst * TH.TOKEN
        gains = [rng.choice([0, 1, 300_000, 999_999, 1_000_000, 1_700_000, rng.randrange(3_000_000)]) for _ in range(60)]
        pieces = [(0, 0, 0)]
        for g in gains:
            pieces = TH.advance(pieces, g, cap)
        half = [(0, 0, 0)]
        for g in gains[:25]:
            half = TH.advance(half, g, cap)
        rest = [(0, 0, 0)]
        for g in gains[25:]:
            rest = TH.advance(rest, g, cap)
        both = TH.compose(half, rest, cap)
        assert len(pieces) <= 40  # a size check only: results do not depend on it
        for level in [0, 1, cap, cap - 1, *(rng.randrange(cap + 1) for _ in range(40))]:
            x = level
            for g in gains:
                x, _ = TH.refill(x, g, cap)
            assert TH.apply_pieces(pieces, level) == x == TH.apply_pieces(both, level)


@pytest.mark.parametrize("rate,burst", [(1, 3), (2, 5)])
def test_token_bucket_with_a_hot_key_split_into_chunks(spark, rate, burst):
    rng = random.Random(5)
    rows, t = [], 1_700_000_000_000_000
    for i in range(1500):
        t += rng.choice([1000, 200_000, 500_000, 900_000])
        rows.append(("hot" if i % 3 else f"k{i % 5}", t, i))
    df = spark.createDataFrame(rows, "k string, us bigint, i int").withColumn("at", F.timestamp_micros("us"))
    got = {r.i: (r.allowed, r.remaining) for r in TH.token_bucket(df, "k", "at", "i", F.date_trunc("minute", "at"), rate, burst, chunk_rows=20, fanout=4).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert [got[r[2]] for r in mine] == simulate([r[1] for r in mine], rate, burst)


@pytest.mark.parametrize("shape", ["steady", "gaps", "few"])
def test_sliding_limit_of_one_busy_key(spark, shape):
    """Runs without a pause are cut into chunks; the result is that of a replay in order."""
    rng = random.Random(9)
    rows, t = [], 1_700_000_000_000_000
    for i in range(3000):
        t += {"steady": rng.randrange(1, 400_000), "gaps": rng.choice([1, 900_000, 2_000_000]), "few": 700_000}[shape]
        rows.append((t, i))
    df = spark.createDataFrame(rows, "us bigint, i int").select(F.lit("k").alias("k"), "i", F.timestamp_micros("us").alias("at"))
    got = {r.i: r.allowed for r in TH.sliding_limit(df, "k", "at", "i", None, 3, 2, chunk_rows=100).collect()}
    log, want = [], {}
    for at, i in rows:
        log = [x for x in log if at - x <= 2_000_000]
        want[i] = len(log) < 3
        log += [at] if want[i] else []
    assert got == want and len(got) == 3000


def test_entry_logs_of_chunks(spark):
    rows = [("k", 1, i // 10, 1000 * i, i) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, run bigint, chunk bigint, ts_us bigint, tie int")
    logs = {r.chunk: r.log for r in TH._entry_logs(df, 4, 25_000).collect()}
    log, want = [], {}
    for _, _, chunk, at, i in rows:
        if i % 10 == 0 and log:
            want[chunk] = list(log)
        log = [x for x in log if at - x <= 25_000]
        log += [at] if len(log) < 4 else []
    assert logs == want


def test_suppressed_rows_of_a_lattice(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 21, 25, 37, 38, 64]), rng.choice(["ab", "ac", "bd", None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "age int, zone string")
    steps = {"age": [lambda c: c, lambda c: F.floor(c / 10), lambda c: F.lit(None).cast("int")], "zone": [lambda c: c, lambda c: F.substring(c, 1, 1), lambda c: F.lit("*")]}
    plain = {"age": [lambda x: x, lambda x: None if x is None else x // 10, lambda x: None], "zone": [lambda x: x, lambda x: None if x is None else x[:1], lambda x: "*"]}
    got = K.suppressed_rows(df, steps, 8)
    assert len(got) == 9
    for (a, z), n in got.items():
        sizes = Counter((plain["age"][a](x), plain["zone"][z](y)) for x, y in rows)
        assert n == sum(c for c in sizes.values() if c < 8)
    assert K.choose_node(df.limit(0), steps, 8, 0.0) == (0, 0)


def test_sliding_limit(spark):
    rng = random.Random(6)
    rows, t = [], 1_700_000_000_000_000
    for i in range(800):
        t += rng.choice([1000, 400_000, 1_500_000])
        rows.append((f"k{i % 3}", t, i))
    df = spark.createDataFrame(rows, "k string, us bigint, i int").withColumn("at", F.timestamp_micros("us"))
    got = {r.i: r.allowed for r in TH.sliding_limit(df, "k", "at", "i", F.date_trunc("minute", "at"), 3, 2).collect()}
    for k in ("k0", "k1", "k2"):
        log = []
        for _, at, i in (r for r in rows if r[0] == k):
            log = [x for x in log if at - x <= 2_000_000]
            ok = len(log) < 3
            if ok:
                log.append(at)
            assert got[i] is ok


def test_ledger_matches_a_sequential_run(spark):
    rng = random.Random(8)
    rows = [("d1" if i % 3 else "d2", i, rng.choice([0.1, 0.25, 0.5, 1.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "d string, i int, e double")
    for composition, budget in (("basic", 12.0), ("advanced", 150.0)):
        got = {r.i: r.accepted for r in K.privacy_ledger(df, "d", ["i"], "e", F.floor(F.col("i") / 40), budget, composition).collect()}
        from math import log, sqrt

        state = {}
        for d, i, e in rows:
            total, k = state.get(d, (0, 0))
            cost = round(e * 1e6) if composition == "basic" else round(e * sqrt(2 * (k + 1) * log(1e5)) * 1e6)
            ok = total + cost <= round(budget * 1e6)
            assert got[i] is ok
            state[d] = (total + cost, k + 1) if ok else (total, k)


def test_lockout_after_three_failures_and_retry_delays(spark):
    rows = [(1, 0, "error"), (2, 10, "error"), (3, 20, "error"), (4, 30, "error"), (5, 40, "signup"), (6, 50, "error"), (7, 20, "error")]
    df = spark.createDataFrame(rows, "i int, s int, kind string").select("i", "kind", F.timestamp_seconds("s").alias("at"), F.lit("u").alias("u"))
    got = {r.i: (r.attempts, r.locks, r.was_locked) for r in E.brute_force(df, "u", "at", "i", F.col("kind") == "error", F.col("kind") == "signup", F.to_date("at"), 3, 900).collect()}
    assert got == {1: (1, False, False), 2: (2, False, False), 3: (3, True, False), 7: (4, True, True), 4: (5, True, True), 6: (1, False, False)}
    delays = spark.range(1, 9).select(E.retry_delay(F.col("id")).alias("d")).collect()
    assert [r.d for r in delays] == [1, 2, 4, 8, 16, 32, 60, 60]


# ------------------------------------------------------------------ versions and lineage
def test_two_trees_give_one_of_each_change(spark):
    cols = "key string, hash string, kind string, size bigint"
    old = spark.createDataFrame([("same", "h1", "blob", 10), ("changed", "h2", "blob", 20), ("gone", "h3", "blob", 30), ("old_name", "h4", "blob", 40)], cols)
    new = spark.createDataFrame([("same", "h1", "blob", 10), ("changed", "h5", "blob", 25), ("added", "h6", "blob", 60), ("new_name", "h4", "blob", 40)], cols)
    s = V.diff_stats(V.detect_renames(V.snapshot_diff(old, new))).first()
    assert (s.added, s.deleted, s.modified, s.renamed, s.insertions, s.deletions, s.size_change) == (1, 1, 1, 1, 65, 30, 35)


def test_linear_history_and_merge_base(spark):
    edges = spark.createDataFrame([("c3", "c2", 0), ("c2", "c1", 0), ("x1", "c2", 0)], "commit string, parent string, ord int")
    walk = {(r.commit, r.depth) for r in V.history_walk(edges, spark.createDataFrame([("m", "c3")], "root string, commit string")).collect()}
    assert walk == {("c3", 0), ("c2", 1), ("c1", 2)}
    r = V.merge_base(edges, spark.createDataFrame([(1, "c3", "x1")], "pair int, a string, b string")).first()
    assert (r.merge_base, r.ahead, r.behind) == ("c2", 1, 1)


def graph(spark):
    """Two components: a mill whose grain splits and meets again in the dough, and a lone pair."""
    kinds = {"field": "source", "grain": "dataset", "flour": "dataset", "bran": "dataset", "dough": "model", "bread": "output", "crumbs": "output", "river": "source", "ice": "output"}
    nodes = spark.createDataFrame(list(kinds.items()), "node string, type string")
    flows = [("field", "grain"), ("grain", "flour"), ("grain", "bran"), ("flour", "dough"), ("bran", "dough"), ("dough", "bread"), ("bread", "crumbs"), ("river", "ice")]
    return nodes, spark.createDataFrame(flows, "source string, target string")


def test_lineage_of_a_mill(spark):
    nodes, edges = graph(spark)
    start = spark.createDataFrame([("grain",), ("river",)], "node string")
    rows = {r.start: (r.affected, r.max_depth, r.datasets, r.models, r.outputs) for r in L.impact_analysis(nodes, edges, start).collect()}
    assert rows == {"grain": (5, 4, 2, 1, 2), "river": (1, 1, 0, 0, 1)}
    assert {r.node for r in L.closure(edges, spark.createDataFrame([("dough",)], "node string"), "up").collect()} == {"flour", "bran", "grain", "field"}
    pairs = spark.createDataFrame([("field", "bread"), ("river", "bread")], "source string, target string")
    paths = sorted(p.path for p in L.find_paths(edges, pairs, 6).collect())
    assert paths == [["field", "grain", "bran", "dough", "bread"], ["field", "grain", "flour", "dough", "bread"]]
    kept_nodes, kept_edges = L.remove_node(nodes, edges, spark.createDataFrame([("dough",)], "node string"))
    assert kept_nodes.count() == 8 and kept_edges.count() == 5


def verdicts(spark, edges, proposals):
    names = {x for e in [*edges, *proposals] for x in e[:2]} - {"?"}
    nodes = spark.createDataFrame([(n,) for n in sorted(names)], "node string")
    new = spark.createDataFrame([(*e, k) for k, e in enumerate(proposals)], "source string, target string, at int")
    got = L.admit_edges(nodes, spark.createDataFrame(edges, "source string, target string"), new, "at")
    return [r.reason for r in got.orderBy("at").collect()]


def test_edges_are_admitted_in_order(spark):
    assert verdicts(spark, [("a", "b")], [("b", "c"), ("c", "a")]) == [None, "cycle"]
    assert verdicts(spark, [("a", "b")], [("c", "a"), ("b", "c")]) == [None, "cycle"]
    assert verdicts(spark, [("a", "b")], [("a", "a"), ("a", "?"), ("b", "a"), ("a", "c")]) == ["cycle", "unknown_node", "cycle", None]


def test_admission_equals_one_by_one(spark):
    import random

    rng = random.Random(11)
    for _ in range(2):
        old, proposals = [(f"n{a}", f"n{a + 1 + rng.randrange(3)}") for a in range(5)], list(dict.fromkeys((f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)))
        proposals = [e for e in proposals if e not in old]
        taken, want = set(old), []
        for a, b in proposals:
            seen, todo = {b}, [b]
            while todo:
                x = todo.pop()
                new = {t for s, t in taken if s == x} - seen
                seen |= new
                todo += new
            want.append("cycle" if a in seen else None)
            if a not in seen:
                taken.add((a, b))
        assert verdicts(spark, old, proposals) == want


# ------------------------------------------------------------------ access, audit
def test_policy_order_and_abac_priority(spark):
    df = spark.createDataFrame([("user:a", "read", "dataset:x"), ("user:a", "delete", "dataset:protected-1"), ("bot", "read", "dataset:x")], "p string, a string, r string")
    policies = [AC.AccessPolicy("p1", (AC.Statement("allow", ("user:*",), ("read", "delete"), ("dataset:*",)),), 50), AC.AccessPolicy("p2", (AC.Statement("deny", (), ("delete",), ("dataset:protected-*",)),), 1)]
    rows = df.select(AC.policy_check(F.col("p"), F.col("a"), F.col("r"), policies).alias("d")).select("d.*").collect()
    assert [(r.effect, r.policy) for r in rows] == [("allow", "p1"), ("deny", "p2"), (None, None)]
    rules = [AC.AbacPolicy("low", "allow", 1), AC.AbacPolicy("high", "deny", 10, subject=X.Condition("p", "starts_with", "bot"))]
    got = df.select(AC.abac_check(F.col("r"), F.col("a"), rules).alias("d")).select("d.*").collect()
    assert [r.effect for r in got] == ["allow", "allow", "deny"]


def test_roles_with_a_cycle(spark):
    ur = spark.createDataFrame([("u", "child")], "user_id string, role string")
    parents = spark.createDataFrame([("child", "data-analyst"), ("data-analyst", "child")], "role string, parent string")
    assert {r.role for r in AC.effective_roles(ur, parents).collect()} == {"child", "data-analyst"}


FIELDS = ["kind", "target"]


def test_chain_valid_and_every_tampering_found(spark):
    df = spark.range(25).select(F.lit("t").alias("tenant"), "id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("kind"), F.lit("x").alias("target"))
    chained = U.build_chain(df, "tenant", ["id"], F.floor(F.col("id") / 4), "id", FIELDS, segment_rows=10)
    rows = chained.orderBy("sequence").collect()
    prev = ""
    for i, r in enumerate(rows):
        prev = "" if i % 10 == 0 else prev
        prev = hashlib.sha256(f"{r.id}{i + 1}{r.kind}{r.target}{prev}".encode()).hexdigest()
        assert r.entry_hash == prev

    seals = U.segment_seals(chained, "tenant")
    roots = U.seal_root(seals, "tenant")

    def check(c, kept=seals):
        return U.verify_chain(c, "tenant", "id", FIELDS, kept, roots, segment_rows=10).first()

    assert check(chained).valid and check(chained).verified == 25
    for seq in (1, 10, 11, 25):
        forged = chained.withColumn("target", F.when(F.col("sequence") == seq, "y").otherwise(F.col("target")))
        assert check(forged).first_bad == seq
    assert check(chained.filter("sequence <> 7")).first_bad == 8
    # a segment rewritten as a whole fits itself but not its seal; rewritten seals fit no root
    other = U.build_chain(df.withColumn("target", F.when(F.col("id") == 12, "y").otherwise(F.col("target"))), "tenant", ["id"], F.lit(0), "id", FIELDS, segment_rows=10)
    swapped = chained.filter("segment <> 1").unionByName(other.filter("segment = 1"))
    got = check(swapped)
    assert (got.valid, got.verified, got.first_bad, got.reason) == (False, 10, 11, "segment forged")
    assert check(swapped, U.segment_seals(swapped, "tenant")).reason == "seals forged"
    assert check(chained.filter("segment < 2")).reason == "segment missing"
    assert check(chained.filter("sequence < 25")).reason == "segment forged"
    assert check(chained.limit(0)).first_bad == 1
    sealed = U.seal_segments(chained, "tenant", fanout=2).first()
    changed = U.seal_segments(U.build_chain(df.withColumn("target", F.when(F.col("id") == 24, "y").otherwise(F.col("target"))), "tenant", ["id"], F.lit(0), "id", FIELDS, 10), "tenant", fanout=2).first()
    assert sealed.entries == 25 and sealed.root != changed.root


def test_hmac_equals_the_standard_library(spark):
    for key in ("k", "x" * 100):
        got = spark.createDataFrame([("héllo",)], "v string").select(R.hmac_sha256(F.col("v"), key).alias("h")).first().h
        assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()


# ------------------------------------------------------------------ content, quality, paging
def test_chunks_and_manifest(spark):
    df = spark.createDataFrame([("o", "é" * 1500)], "id string, text string")
    chunks = C.chunk_fixed(df, "text", "id", 1024)
    assert [r.size for r in chunks.orderBy("idx").collect()] == [1024, 1024, 952]
    assert C.validate_manifest(chunks, "id").first().valid
    assert not C.validate_manifest(chunks.filter("idx <> 2"), "id").first().valid
    assert C.reassemble(chunks, "id").select(F.decode("payload", "UTF-8").alias("t")).first().t == "é" * 1500


def test_record_schema(spark):
    schema = Q.Schema((Q.Field("name", "string", nullable=False, min_length=1), Q.Field("age", "integer", min_value=0)), strict=True)
    rows = ['{"name":"a","age":3}', '{"age":3}', '{"name":"","age":-1}', '{"name":null}', '{"name":"a","x":1}', '[1]', 'oops', '{"name":"a","age":1.5}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    got = {r.i: {(e.field, e.constraint) for e in r.errors} for r in Q.validate_json(df, "j", schema).collect()}
    assert got == {0: set(), 1: {("name", "required")}, 2: {("name", "min_length"), ("age", "min_value")}, 3: {("name", "nullable")}, 4: {("x", "unknown_field")},
                   5: {("", "type")}, 6: {("", "type")}, 7: {("age", "type")}}


def test_paging(spark):
    r = M.page(spark.range(35), ["id"], 2, 10).collect()
    assert [x.id for x in r] == list(range(10, 20)) and (r[0].total_pages, r[0].has_previous, r[0].has_next) == (4, True, True)
    c = M.cursor_page(spark.range(35).select(F.lit(1).alias("v"), "id"), ("v", "id"), (1, 30), 10).collect()
    assert [x.id for x in c] == [31, 32, 33, 34] and not c[0].has_more


def test_networks_and_globs(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",), ("bad",)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8", "block"), ("10.1.0.0/16", "allow")], "network string, list string")
    assert {r.ip: r.allowed for r in T.ip_filter(ips, "ip", nets).collect()} == {"10.1.2.3": True, "10.9.9.9": False, "11.0.0.1": True, "bad": False}
    assert X.glob_regex("a.b*?") == r"^a\.b.*.$"
    one = spark.createDataFrame([("10.1.2.3",)], "ip string")
    assert one.filter(X.compile_condition(X.Condition("ip", "ip", ["10.0.0.0/8"]))).count() == 1


def test_k_anonymise_and_risk(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(23)], "q int, i int")
    out = K.k_anonymise(df, {"q": [lambda c: c, lambda c: F.floor(c / 3).cast("int")]}, 5, 0.0)
    assert out.groupBy("q").count().agg(F.min("count")).first()[0] >= 5 and out.count() == 23
    r = K.reid_risk(spark.createDataFrame([(1,), (1,), (2,)], "q int"), ["q"]).first()
    assert (r.prosecutor, r.journalist, r.marketer) == (0.5, round(1 / 3, 9), 0.75)


# ------------------------------------------------------------------ files
def test_jsonl_lines_and_formats(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"a":1}\n\n{"a":2\n{"a":3}} x\n{"a":4}\n')
    good, bad = S.import_jsonl(spark, str(p))
    assert sorted(r.line_number for r in good.collect()) == [1, 5] and sorted(r.line_number for r in bad.collect()) == [3, 4]
    strict, _ = S.import_jsonl(spark, str(p), continue_on_error=False)
    with pytest.raises(Exception, match="malformed JSON at line"):
        strict.collect()
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for fmt, comp in (("json", "gzip"), ("csv", "none"), ("parquet", "zstd"), ("orc", "snappy")):
        S.write_dataset(df, str(tmp_path / fmt), fmt, comp)
        assert S.read_dataset(spark, str(tmp_path / fmt), fmt, "a int, b string").exceptAll(df).isEmpty()
    with pytest.raises(ValueError):
        S.read_dataset(spark, "x", "arrow")


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("mail a@b.org")
    (tmp_path / "sub" / "b.txt").write_text("ip 8.8.8.8")
    (tmp_path / "sub" / "skip.txt").write_text("c@d.org")
    (tmp_path / "c.bin").write_text("e@f.org")
    rows = S.scan_files(spark, str(tmp_path), include="*.txt", exclude="skip*").collect()
    assert {(r.path.rsplit("/", 1)[1], r.value) for r in rows} == {("a.txt", "a@b.org"), ("b.txt", "8.8.8.8")}


def test_content_store_adds_only_new_payloads(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    assert S.put_content(df, "t", str(tmp_path / "store")).count() == 2
    assert S.put_content(df.unionAll(spark.createDataFrame([("c",)], "t string")), "t", str(tmp_path / "store")).count() == 1
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
