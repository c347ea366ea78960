"""Version and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import along
from ..operators import lineage as L, versions as V
from ..session import cut, table
from .detection import docs
from .registry import query

# the hash input of a row, spelled for both engines; prices go through cents to avoid float text
_PRICE = "CAST(round(o_totalprice*100) AS BIGINT)"


def _len(expr):
    return f"(length({expr}::VARCHAR)||':'||{expr}::VARCHAR)"


def _rowhash(price="p"):
    return f"sha256({_len('o_custkey')}||'|'||{_len('o_orderstatus')}||'|'||{_len(price)})"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"))


HCOLS = ["o_custkey", "o_orderstatus", "p"]
_SIZE = "(length(o_custkey::VARCHAR)+length(o_orderstatus)+length(p::VARCHAR))::BIGINT"
BASE = f"o AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_PRICE} AS p FROM orders)"
OLD = f"SELECT o_orderkey AS key, {_rowhash()} AS hash, CASE WHEN o_orderkey%50=0 THEN 'tree' ELSE 'blob' END AS kind, {_SIZE} AS size FROM o"
_NEWX = (f"SELECT CASE WHEN o_orderkey%10=3 THEN o_orderkey+100000000 ELSE o_orderkey END AS key, sha256({_len('o_custkey')}||'|'||{_len('o_orderstatus')}||'|'||{_len('(CASE WHEN o_orderkey%7=1 THEN p*10 ELSE p END)')}) AS hash, "
         "'blob' AS kind, (length(o_custkey::VARCHAR)+length(o_orderstatus)+length((CASE WHEN o_orderkey%7=1 THEN p*10 ELSE p END)::VARCHAR))::BIGINT AS size FROM o WHERE o_orderkey%10<>0 OR o_orderkey%50=0")
DIFF = f"""WITH {BASE}, a AS ({OLD}), b AS ({_NEWX}), d AS (SELECT coalesce(a.key,b.key) AS key,
   CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' WHEN a.kind<>b.kind THEN 'type_changed' WHEN a.hash<>b.hash THEN 'modified' ELSE 'unchanged' END AS change,
   a.hash AS old_hash, b.hash AS new_hash, a.size AS old_size, b.size AS new_size, a.kind AS old_kind, b.kind AS new_kind FROM a FULL JOIN b ON a.key=b.key)"""


def old_snap(spark, sf):
    return V.snapshot(orders(spark, sf), "o_orderkey", HCOLS, F.when(F.col("o_orderkey") % 50 == 0, "tree").otherwise("blob"))


def new_snap(spark, sf):
    k = F.col("o_orderkey")
    o = orders(spark, sf).filter((k % 10 != 0) | (k % 50 == 0)).withColumn("p", F.when(k % 7 == 1, F.col("p") * 10).otherwise(F.col("p")))
    return V.snapshot(o.withColumn("o_orderkey", F.when(k % 10 == 3, k + 100000000).otherwise(k)), "o_orderkey", HCOLS)


def diff(spark, sf):
    return V.snapshot_diff(old_snap(spark, sf), new_snap(spark, sf))


@query("v01_snapshot_diff", DIFF + " SELECT key, change, old_hash, new_hash FROM d WHERE change<>'unchanged'")
def _(spark, sf):
    return diff(spark, sf).select("key", "change", "old_hash", "new_hash")


_REN = DIFF + """, g AS (SELECT old_hash AS hash, key, row_number() OVER (PARTITION BY old_hash ORDER BY sha256(key::VARCHAR)) AS r FROM d WHERE change='deleted' AND old_kind='blob'),
   c AS (SELECT new_hash AS hash, key, new_size AS size, row_number() OVER (PARTITION BY new_hash ORDER BY sha256(key::VARCHAR)) AS r FROM d WHERE change='added' AND new_kind='blob'),
   pr AS (SELECT g.key AS ok, c.key AS nk, size FROM g JOIN c USING (hash, r)),
   fin AS (SELECT nk AS key, 'renamed' AS change, ok AS from_key, 100 AS similarity, size AS old_size, size AS new_size FROM pr
     UNION ALL SELECT key, change, NULL, NULL, old_size, new_size FROM d WHERE change<>'unchanged' AND NOT (change='deleted' AND key IN (SELECT ok FROM pr)) AND NOT (change='added' AND key IN (SELECT nk FROM pr)))"""


@query("v02_detect_renames", _REN + " SELECT key, change, from_key, similarity FROM fin")
def _(spark, sf):
    return V.detect_renames(diff(spark, sf)).select("key", "change", "from_key", "similarity")


@query("v02_rename_copies", """WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents), a AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY sha256('a'||doc_id)) AS r FROM d),
   b AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY sha256('b'||doc_id)) AS r FROM d) SELECT 'a'||a.doc_id AS from_key, 'b'||b.doc_id AS key FROM a JOIN b USING (h, r)""")
def _(spark, sf):
    d = docs(spark, sf)
    old = d.select(F.concat(F.lit("a"), "doc_id").alias("key"), F.sha2("text", 256).alias("hash"), F.lit("blob").alias("kind"), F.octet_length("text").cast("bigint").alias("size"))
    new = old.withColumn("key", F.concat(F.lit("b"), F.substring("key", 2, 20)))
    return V.detect_renames(V.snapshot_diff(old, new)).filter("change = 'renamed'").select("from_key", "key")


_STATS = """count(*) FILTER (change='added') AS added, count(*) FILTER (change='deleted') AS deleted, count(*) FILTER (change IN ('modified','type_changed')) AS modified, count(*) FILTER (change='renamed') AS renamed,
   coalesce(sum(CASE WHEN change='added' THEN new_size WHEN change IN ('modified','type_changed') THEN greatest(new_size-old_size,0) ELSE 0 END),0)::BIGINT AS insertions,
   coalesce(sum(CASE WHEN change='deleted' THEN old_size WHEN change IN ('modified','type_changed') THEN greatest(old_size-new_size,0) ELSE 0 END),0)::BIGINT AS deletions,
   count(*) FILTER (change<>'unchanged') AS total_changed,
   (coalesce(sum(CASE WHEN change='added' THEN new_size WHEN change IN ('modified','type_changed') THEN greatest(new_size-old_size,0) ELSE 0 END),0)
    - coalesce(sum(CASE WHEN change='deleted' THEN old_size WHEN change IN ('modified','type_changed') THEN greatest(old_size-new_size,0) ELSE 0 END),0))::BIGINT AS size_change"""


@query("v03_diff_stats", _REN + f" SELECT {_STATS} FROM fin")
def _(spark, sf):
    return V.diff_stats(V.detect_renames(diff(spark, sf)))


def _side(cond_del, cond_mod, mult, add_mod):
    return f"""SELECT o_orderkey AS key, sha256({_len('o_custkey')}||'|'||{_len('o_orderstatus')}||'|'||{_len(f'(CASE WHEN {cond_mod} THEN p+{mult} ELSE p END)')}) AS hash, CASE WHEN o_orderkey%97=0 AND {mult}=1 THEN 'tree' ELSE 'blob' END AS kind FROM o WHERE NOT ({cond_del})
      UNION ALL SELECT o_orderkey+200000000, sha256({_len('o_custkey')}||'|'||{_len('o_orderstatus')}||'|'||{_len(f'(p+{mult}*(o_orderkey%2))')}), 'blob' FROM o WHERE o_orderkey%{add_mod}=0"""


@query("v04_three_way_merge", f"""WITH {BASE}, b AS (SELECT o_orderkey AS key, {_rowhash()} AS hash, 'blob' AS kind FROM o), us AS ({_side('o_orderkey%11=0', 'o_orderkey%5=0', 1, 40)}), th AS ({_side('o_orderkey%13=0', 'o_orderkey%3=0', 2, 60)}),
   k AS (SELECT key FROM b UNION SELECT key FROM us UNION SELECT key FROM th),
   j AS (SELECT k.key, b.hash AS b, us.hash AS o, th.hash AS t, us.kind AS ok, th.kind AS tk FROM k LEFT JOIN b ON b.key=k.key LEFT JOIN us ON us.key=k.key LEFT JOIN th ON th.key=k.key),
   c AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t OR o IS NOT DISTINCT FROM b OR t IS NOT DISTINCT FROM b THEN NULL WHEN o IS NOT NULL AND t IS NOT NULL AND ok<>tk THEN 'type_conflict' WHEN b IS NULL THEN 'both_added' WHEN o IS NULL THEN 'delete_modify' WHEN t IS NULL THEN 'modify_delete' ELSE 'both_modified' END AS conflict FROM j)
   SELECT key, conflict, CASE WHEN conflict IS NOT NULL THEN NULL WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t ELSE o END AS merged_hash,
    CASE WHEN conflict IS NOT NULL THEN 'conflict' WHEN o IS NOT DISTINCT FROM t THEN (CASE WHEN o IS NOT DISTINCT FROM b THEN 'base' ELSE 'both' END) WHEN o IS NOT DISTINCT FROM b THEN 'theirs' ELSE 'ours' END AS source FROM c""")
def _(spark, sf):
    o, k = orders(spark, sf), F.col("o_orderkey")

    def side(gone, changed, plus, every):
        kept = o.filter(~gone).withColumn("p", F.when(changed, F.col("p") + plus).otherwise(F.col("p")))
        extra = o.filter(k % every == 0).withColumn("p", F.col("p") + plus * (k % 2)).withColumn("o_orderkey", k + 200000000)
        kind = F.when((k % 97 == 0) & (k < 200000000) & F.lit(plus == 1), "tree").otherwise("blob")
        return V.snapshot(kept.unionByName(extra), "o_orderkey", HCOLS, kind)

    base = V.snapshot(o, "o_orderkey", HCOLS)
    return V.three_way_merge(base, side(k % 11 == 0, k % 5 == 0, 1, 40), side(k % 13 == 0, k % 3 == 0, 2, 60))


def changes(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", "props")


def _rows(gone, changed, plus, every):
    return f"""SELECT o_orderkey AS key, o_custkey, o_orderstatus, CASE WHEN {changed} THEN p+{plus} ELSE p END AS p FROM o WHERE NOT ({gone})
      UNION ALL SELECT o_orderkey+200000000, o_custkey, o_orderstatus, p+{plus} FROM o WHERE o_orderkey%{every}=0"""


def _merge_sql(conflict_row, conflict_source):
    """Only p ever differs and no p is null, so p tells presence and change."""
    return f"""WITH {BASE}, us AS ({_rows('o_orderkey%11=0', 'o_orderkey%5=0', 1, 40)}), th AS ({_rows('o_orderkey%13=0', 'o_orderkey%3=0', 2, 60)}), b AS (SELECT o_orderkey AS key, o_custkey, o_orderstatus, p FROM o),
   j AS (SELECT key, coalesce(b.o_custkey,us.o_custkey,th.o_custkey) AS c, coalesce(b.o_orderstatus,us.o_orderstatus,th.o_orderstatus) AS s, b.p AS bp, us.p AS op, th.p AS tp FROM b FULL JOIN us USING (key) FULL JOIN th USING (key)),
   k AS (SELECT *, CASE WHEN op IS NOT DISTINCT FROM tp OR op IS NOT DISTINCT FROM bp OR tp IS NOT DISTINCT FROM bp THEN NULL WHEN bp IS NULL THEN 'both_added' WHEN op IS NULL THEN 'delete_modify' WHEN tp IS NULL THEN 'modify_delete' ELSE 'both_modified' END AS conflict FROM j),
   m AS (SELECT *, CASE WHEN conflict IS NOT NULL THEN {conflict_row} WHEN op IS NOT DISTINCT FROM tp THEN op WHEN op IS NOT DISTINCT FROM bp THEN tp ELSE op END AS p,
     CASE WHEN conflict IS NOT NULL THEN '{conflict_source}' WHEN op IS NOT DISTINCT FROM tp THEN (CASE WHEN op IS NOT DISTINCT FROM bp THEN 'base' ELSE 'both' END) WHEN op IS NOT DISTINCT FROM bp THEN 'theirs' ELSE 'ours' END AS source FROM k)
   SELECT key AS o_orderkey, CASE WHEN p IS NOT NULL THEN c END AS o_custkey, CASE WHEN p IS NOT NULL THEN s END AS o_orderstatus, p, source, conflict, CASE WHEN source='conflict' THEN op END AS our_p, CASE WHEN source='conflict' THEN tp END AS their_p
   FROM m WHERE source='conflict' OR p IS NOT NULL"""


def _merged(spark, sf, prefer=None):
    o, k, p = orders(spark, sf), F.col("o_orderkey"), F.col("p")

    def side(gone, changed, plus, every):
        kept = o.filter(~gone).withColumn("p", F.when(changed, p + plus).otherwise(p))
        return kept.unionByName(o.filter(k % every == 0).withColumn("p", p + plus).withColumn("o_orderkey", k + 200000000))

    out = V.merge_rows(o, side(k % 11 == 0, k % 5 == 0, 1, 40), side(k % 13 == 0, k % 3 == 0, 2, 60), ["o_orderkey"], prefer)
    return out.select("*", F.col("our_row.p").alias("our_p"), F.col("their_row.p").alias("their_p")).drop("base_row", "our_row", "their_row")


@query("v04_merge_rows", _merge_sql("NULL", "conflict"))
def _(spark, sf):
    return _merged(spark, sf)


@query("v04_merge_rows_ours", _merge_sql("op", "ours"))
def _(spark, sf):
    return _merged(spark, sf, "ours")


@query("v06_record_history", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def _(spark, sf):
    return V.number_versions(changes(spark, sf), "user_id", ["ts", "event_id"], None).select("user_id", "event_id", "version")


@query("v06_record_at_version", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v=5")
def _(spark, sf):
    v = V.number_versions(changes(spark, sf), "user_id", ["ts", "event_id"], None)
    return V.record_at_version(v, 5).select("user_id", "event_id")


@query("v06_record_as_of", "SELECT user_id, arg_max(event_id,(ts,event_id)) AS event_id, arg_max(props,(ts,event_id)) AS props FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id")
def _(spark, sf):
    return V.record_as_of(changes(spark, sf), "user_id", ["ts", "event_id"], "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("user_id", "event_id", "props")


@query("v07_apply_updates", """WITH u AS (SELECT *, o_orderpriority='1-URGENT' AS asked, o_totalprice > 300000 AS stale FROM orders) SELECT o_orderkey, CASE WHEN asked AND NOT stale THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
   o_orderkey%3+1+CASE WHEN asked AND NOT stale THEN 1 ELSE 0 END AS version, CASE WHEN NOT asked THEN 'kept' WHEN stale THEN 'conflict' ELSE 'updated' END AS outcome,
   (CASE WHEN asked THEN 1 + (o_orderkey%2=0)::INT - (NOT stale)::INT ELSE 0 END)::BIGINT AS conflicts FROM u""")
def _(spark, sf):
    k = F.col("o_orderkey")
    cur = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (k % 3 + 1).alias("version"))
    stale = (F.col("o_totalprice") > 300000).cast("int")
    upd = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (k % 3 + 1 + stale).alias("expected_version"), F.lit("X").alias("o_orderstatus"), F.lit(1).alias("at"))
    # a second update of the same key and expected version comes too late
    late = upd.filter(k % 2 == 0).withColumns({"o_orderstatus": F.lit("Y"), "at": F.lit(2)})
    return V.apply_updates(cur, upd.unionByName(late), "o_orderkey", "o_orderstatus", ["at"])


@query("v08_blame", """WITH l AS (SELECT user_id, event_id, ts, event_type, props, lag(event_type) OVER w AS pt, lag(props) OVER w AS pp, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   c AS (SELECT user_id, 'event_type' AS field, event_type AS value, event_id, ts FROM l WHERE n=1 OR event_type IS DISTINCT FROM pt UNION ALL SELECT user_id, 'props', props, event_id, ts FROM l WHERE n=1 OR props IS DISTINCT FROM pp)
   SELECT user_id, field, arg_max(event_id,(ts,event_id)) AS last_changed, arg_max(value,(ts,event_id)) AS value, count(*) AS changes FROM c GROUP BY ALL""")
def _(spark, sf):
    return V.blame(changes(spark, sf), "user_id", ["ts", "event_id"], None, ["event_type", "props"], "event_id")


def _fold(src, group, out):
    """SQL of the three-step digest."""
    g = f"{group}, " if group else ""
    ctes, prev = [], src
    for i, digits in enumerate((6, 3, 0)):
        ctes.append(f"{out}_{i} AS (SELECT {g}cell AS h, cell||':'||d AS x, d, n FROM (SELECT {g}left(h,{digits}) AS cell, sha256(string_agg(x, chr(10) ORDER BY x)) AS d, sum(n)::BIGINT AS n FROM {prev} GROUP BY {g}left(h,{digits})))")
        prev = f"{out}_{i}"
    ctes.append(f"{out} AS (SELECT {g}d AS hash, n AS entries FROM {prev})")
    return ctes


def _tree_sql(max_depth=6):
    ctes = ["f AS (SELECT array_to_string(list_filter(string_split(url,'/'), lambda x: x<>''),'/') AS path, len(list_filter(string_split(url,'/'), lambda x: x<>'')) AS depth, min(sha256(html)) AS hash FROM pages GROUP BY 1, 2)"]
    prev = None
    for d in range(max_depth, 0, -1):
        src = f"SELECT path, '100644' AS mode, hash FROM f WHERE depth={d}" + (f" UNION ALL SELECT dir, '040000', hash FROM {prev}" if prev else "")
        ctes.append(f"e{d} AS (SELECT CASE WHEN contains(path,'/') THEN regexp_replace(path,'/[^/]*$','') ELSE '' END AS dir, list_last(string_split(path,'/')) AS name, mode, hash FROM ({src}))")
        ctes.append(f"c{d} AS (SELECT dir, sha256(name) AS h, mode||' '||name||' '||hash AS x, 1 AS n FROM e{d})")
        ctes += _fold(f"c{d}", "dir", f"g{d}")
        ctes.append(f"t{d} AS (SELECT dir, {d - 1} AS depth, hash, entries FROM g{d})")
        prev = f"t{d}"
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM t{d}" for d in range(max_depth, 0, -1))


@query("v09_tree_hash", _tree_sql())
def _(spark, sf):
    p = table(spark, sf, "pages").select("url", F.sha2("html", 256).alias("h"))
    return V.tree_hash(p, "url", "h")


_FP = f"""WITH {BASE}, r AS (SELECT sha256({_len('o_orderkey')}||'|'||{_len('o_custkey')}||'|'||{_len('o_orderstatus')}||'|'||{_len('p')}) AS h FROM o), g AS (SELECT h, count(*) AS n FROM r GROUP BY h),
   l AS (SELECT h, h||'x'||n AS x, 1 AS n FROM g), """ + ", ".join(_fold("l", "", "fp")) + " SELECT hash AS fingerprint, entries AS distinct_rows FROM fp"


@query("v10_dataset_fingerprint", _FP)
def _(spark, sf):
    return V.dataset_fingerprint(orders(spark, sf), ["o_orderkey", *HCOLS])


# commits: one per order; the parent is the customer's previous order, every tenth order also
# merges the one before that
_CG = """g AS (SELECT o_orderkey AS commit, o_custkey AS dataset, o_orderdate AS time, lag(o_orderkey) OVER w AS p1, CASE WHEN o_orderkey%10=0 THEN lag(o_orderkey,2) OVER w END AS p2, row_number() OVER w AS n,
    count(*) OVER (PARTITION BY o_custkey) AS total, o_orderpriority AS author, o_orderstatus AS message FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  e AS (SELECT commit, p1 AS parent, 0 AS ord FROM g WHERE p1 IS NOT NULL UNION ALL SELECT commit, p2, 1 FROM g WHERE p2 IS NOT NULL)"""
# least depth from the head of each dataset, by walking down positions
_WALK = _CG + """, w AS (SELECT dataset AS root, commit, n, 0 AS depth FROM g WHERE n=total UNION ALL SELECT w.root, c.commit, c.n, w.depth+1 FROM w JOIN e ON e.commit=w.commit JOIN g c ON c.commit=e.parent),
  walk AS (SELECT root, commit, min(depth) AS depth FROM w GROUP BY ALL)"""


def commit_graph(spark, sf):
    o = table(spark, sf, "orders")
    order, year = ["o_orderdate", "o_orderkey"], F.date_trunc("year", "o_orderdate")
    one = along(o, ["o_custkey"], order, year, lags={"p1": F.col("o_orderkey")})
    two = along(one, ["o_custkey"], order, year, lags={"p2": F.col("p1")}, leads={"nxt": F.col("o_orderkey")})
    second = F.when(F.col("o_orderkey") % 10 == 0, F.col("p2"))
    commits = cut(two.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("dataset"), F.col("o_orderdate").alias("time"),
                             F.array_compact(F.array("p1", second)).alias("parents"), F.col("o_orderpriority").alias("author"),
                             F.concat("o_orderpriority", F.lit("@example.com")).alias("email"), F.col("o_orderstatus").alias("message"), "nxt"))
    edges = commits.select("commit", F.posexplode("parents").alias("ord", "parent"))
    heads = commits.filter("nxt IS NULL").select(F.col("dataset").alias("root"), "commit")
    return commits, edges, heads


@query("v10_commit_id", "WITH " + _CG + """ SELECT commit, sha256('tree '||sha256(commit::VARCHAR)||chr(10)||coalesce('parent '||p1||chr(10),'')||coalesce('parent '||p2||chr(10),'')||'author '||author||' '||epoch(time)::BIGINT||chr(10)||'dataset '||dataset||chr(10)||chr(10)||message) AS id FROM g""")
def _(spark, sf):
    commits, _, _ = commit_graph(spark, sf)
    return commits.select("commit", V.commit_id(F.sha2(F.col("commit").cast("string"), 256), F.col("parents"), F.col("author"), F.col("time"), F.col("dataset"), F.col("message")).alias("id"))


@query("p05_commit_filter", "WITH " + _CG + " SELECT commit FROM g WHERE contains(author,'1-U') AND contains(message,'F') AND time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' AND (p1 IS NULL OR p2 IS NULL)")
def _(spark, sf):
    commits, _, _ = commit_graph(spark, sf)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return V.commit_filter(commits, author="1-U", message="F", since=at("1995-01-01"), before=at("1998-12-31"), merges=False).select("commit")


@query("v11_history", "WITH RECURSIVE " + _WALK + ", h AS (SELECT root, commit, depth FROM walk JOIN g USING (commit) WHERE message='F')"
       " SELECT root, commit, depth FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, commit) AS pos FROM h) WHERE pos > 1 AND pos <= 4")
def _(spark, sf):
    commits, edges, heads = commit_graph(spark, sf)
    return V.history(commits, edges, heads, message="F", skip=1, limit=3).select("root", "commit", "depth")


@query("v11_history_newest_first", "WITH RECURSIVE " + _WALK + " SELECT root, commit, row_number() OVER (PARTITION BY root ORDER BY time DESC, depth, commit) AS rank FROM walk JOIN g USING (commit)")
def _(spark, sf):
    commits, edges, heads = commit_graph(spark, sf)
    return V.history(commits, edges, heads, sort="reverse").select("root", "commit", "rank")


@query("v11_history_first_parent", "WITH " + _CG + " SELECT dataset AS root, commit, (total-n)::INT AS depth FROM g WHERE n > greatest(0, coalesce((SELECT max(s.n) FROM g s WHERE s.dataset=g.dataset AND s.commit%17=0),0))")
def _(spark, sf):
    _, edges, heads = commit_graph(spark, sf)
    stops = edges.select("commit").unionByName(edges.select(F.col("parent").alias("commit"))).unionByName(heads.select("commit")).filter("commit % 17 = 0").distinct()
    return V.history_walk(edges, heads, stops, first_parent=True)


@query("v12_ancestors", "WITH RECURSIVE " + _WALK + " SELECT * FROM walk")
def _(spark, sf):
    _, edges, heads = commit_graph(spark, sf)
    return V.ancestors(edges, heads)


# two branches per dataset: the head, and a side commit grown from the order three back
@query("v12_merge_base", "WITH " + _CG + " SELECT h.dataset AS pair, b.commit AS merge_base FROM g h JOIN g b ON b.dataset=h.dataset AND b.n=h.n-3 WHERE h.n=h.total")
def _(spark, sf):
    pairs, edges = _branches(spark, sf)
    return V.merge_base(edges, pairs).select("pair", "merge_base")


@query("v13_branch_compare", "WITH RECURSIVE " + _WALK + ", wa AS (SELECT g.dataset AS root, g.commit, g.n, true AS x FROM g WHERE n=total-3 UNION ALL SELECT wa.root, c.commit, c.n, true FROM wa JOIN e ON e.commit=wa.commit JOIN g c ON c.commit=e.parent), side AS (SELECT DISTINCT root, commit FROM wa), hd AS (SELECT root, commit FROM walk)"
       " SELECT r.root AS pair, (SELECT count(*) FROM hd WHERE hd.root=r.root AND NOT EXISTS (SELECT 1 FROM side WHERE side.root=hd.root AND side.commit=hd.commit)) AS behind, 1 AS ahead FROM (SELECT DISTINCT root FROM side) r")
def _(spark, sf):
    pairs, edges = _branches(spark, sf)
    return V.merge_base(edges, pairs).select("pair", "behind", "ahead")


def _branches(spark, sf):
    commits, edges, heads = commit_graph(spark, sf)
    back = edges.filter("ord = 0").select(F.col("commit").alias("c"), "parent")
    at = heads
    for _ in range(3):
        at = at.join(back, F.col("commit") == F.col("c")).select("root", F.col("parent").alias("commit"))
    side = at.select("root", (-F.col("root") - 1).alias("tip"), F.col("commit").alias("parent"))
    more = side.select(F.col("tip").alias("commit"), F.lit(0).alias("ord"), "parent")
    pairs = heads.join(side.select("root", "tip"), "root").select(F.col("root").alias("pair"), F.col("commit").alias("a"), F.col("tip").alias("b"))
    return cut(pairs), edges.unionByName(more)


@query("v14_history_stats", "WITH " + _CG + " SELECT count(*) AS commits, count(*) FILTER (p1 IS NOT NULL AND p2 IS NOT NULL) AS merges, count(DISTINCT author) AS authors, strftime(min(time),'%Y-%m-%d') AS first, strftime(max(time),'%Y-%m-%d') AS last FROM g")
def _(spark, sf):
    commits, _, _ = commit_graph(spark, sf)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return V.history_stats(commits)[0].select("commits", "merges", "authors", day("first"), day("last"))


@query("v14_top_authors", "SELECT user_id AS author, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, author LIMIT 10")
def _(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").alias("author"), F.col("ts").alias("time"), F.array().alias("parents"))
    return V.history_stats(c)[1]


@query("v15_roots_leaves", "WITH " + _CG + " SELECT commit, 'root' AS role FROM g WHERE p1 IS NULL UNION ALL SELECT commit, 'leaf' FROM g WHERE n=total")
def _(spark, sf):
    commits, edges, _ = commit_graph(spark, sf)
    return V.roots(commits).select("commit", F.lit("root").alias("role")).unionByName(V.leaves(commits, edges).select("commit", F.lit("leaf").alias("role")))


@query("v15_children", "WITH " + _CG + " SELECT parent AS commit, count(*) AS children FROM e GROUP BY parent")
def _(spark, sf):
    return V.children(commit_graph(spark, sf)[1])


@query("v17_version_stats", f"""WITH {BASE}, s AS (SELECT v AS version, o_orderkey AS key, sha256(o_orderkey||'|'||(CASE WHEN o_orderkey%9=v THEN p+v ELSE p END)) AS hash, {_SIZE} AS size FROM o, (SELECT unnest([1,2,3]) AS v) WHERE o_orderkey%8<>v),
   a AS (SELECT version+1 AS version, key, hash FROM s), j AS (SELECT coalesce(a.version,b.version) AS version, a.hash AS oh, b.hash AS nh, b.size FROM a FULL JOIN s b ON a.version=b.version AND a.key=b.key)
   SELECT version, count(*) FILTER (oh IS NULL) AS added, count(*) FILTER (oh<>nh) AS modified, count(*) FILTER (nh IS NULL) AS deleted, count(nh) AS records, coalesce(sum(size),0)::BIGINT AS size FROM j WHERE version<=3 GROUP BY version""")
def _(spark, sf):
    k, v = F.col("o_orderkey"), F.col("version")
    s = orders(spark, sf).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter(k % 8 != v)
    p = F.when(k % 9 == v, F.col("p") + v).otherwise(F.col("p"))
    size = sum((F.length(F.col(c).cast("string")) for c in HCOLS), F.lit(0)).cast("bigint")
    snap = s.select("version", k.alias("key"), F.sha2(F.concat_ws("|", k.cast("string"), p.cast("string")), 256).alias("hash"), F.lit("blob").alias("kind"), size.alias("size"))
    return V.version_stats(snap)


# ------------------------------------------------------------------------------- lineage
_ND = """nodes AS (SELECT 'r'||r_regionkey AS node, 'source' AS type, 0 AS created FROM region UNION ALL SELECT 'n'||n_nationkey, 'dataset', 1 FROM nation
   UNION ALL SELECT 'c'||c_custkey, 'model', 2 FROM customer UNION ALL SELECT 'o'||o_orderkey, 'output', 3 FROM orders)"""
_ED = """edges AS (SELECT 'r'||n_regionkey AS source, 'n'||n_nationkey AS target, 'derived' AS kind FROM nation UNION ALL SELECT 'n'||c_nationkey, 'c'||c_custkey, 'filtered' FROM customer UNION ALL SELECT 'c'||o_custkey, 'o'||o_orderkey, 'joined' FROM orders)"""
_DOWN = f"""WITH RECURSIVE {_ND}, {_ED}, w AS (SELECT node AS start, node, 0 AS depth FROM nodes UNION ALL SELECT w.start, e.target, w.depth+1 FROM w JOIN edges e ON e.source=w.node), cl AS (SELECT * FROM w WHERE depth>0)"""


def graph(spark, sf):
    t = lambda n: table(spark, sf, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("region", "r", "r_regionkey", "source", 0), ("nation", "n", "n_nationkey", "dataset", 1), ("customer", "c", "c_custkey", "model", 2), ("orders", "o", "o_orderkey", "output", 3)]
    nodes = None
    for tab, p, key, kind, level in parts:
        rows = t(tab).select(name(p, key).alias("node"), F.lit(kind).alias("type"), F.lit(level).alias("created"),
                             F.array(F.lit(kind), F.concat(F.lit("g"), (F.col(key) % 5).cast("string"))).alias("tags"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    edges = (t("nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"), F.lit("derived").alias("kind"))
             .unionByName(t("customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target"), F.lit("filtered").alias("kind")))
             .unionByName(t("orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"), F.lit("joined").alias("kind"))))
    return nodes, edges


def of_type(nodes, kind):
    return nodes.filter(F.col("type") == kind).select("node")


@query("l01_downstream", _DOWN + " SELECT start, node, depth FROM cl WHERE start LIKE 'r%'")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.closure(edges, of_type(nodes, "source"))


@query("l01_upstream", _DOWN + " SELECT node AS start, start AS node, depth FROM cl WHERE node LIKE 'o%'")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.closure(edges, of_type(nodes, "output"), "up")


@query("l02_neighbours", f"WITH {_ED} SELECT source AS node, target AS neighbour, 'children' AS side FROM edges WHERE source LIKE 'n%' UNION ALL SELECT target, source, 'parents' FROM edges WHERE target LIKE 'n%'")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    of = of_type(nodes, "dataset")
    a = L.neighbours(edges, of, "children").select("node", "neighbour", F.lit("children").alias("side"))
    return a.unionByName(L.neighbours(edges, of, "parents").select("node", "neighbour", F.lit("parents").alias("side")))


@query("l03_find_paths", f"""WITH RECURSIVE {_ED}, more AS (SELECT * FROM edges UNION ALL SELECT 'r'||r_regionkey, 'n'||((r_regionkey+1)%5), 'extra' FROM region),
   w AS (SELECT 'r'||r_regionkey AS source, 'r'||r_regionkey AS node, ['r'||r_regionkey] AS path FROM region UNION ALL SELECT w.source, e.target, list_append(w.path, e.target) FROM w JOIN (SELECT DISTINCT source, target FROM more) e ON e.source=w.node WHERE len(w.path)<=2)
   SELECT source, node AS target, array_to_string(path,'>') AS path, 2 AS length FROM w WHERE node LIKE 'c%' AND len(path)=3""")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    extra = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("source"),
                                              F.concat(F.lit("n"), ((F.col("r_regionkey") + 1) % 5).cast("string")).alias("target"), F.lit("extra").alias("kind"))
    every = edges.unionByName(extra)
    # the wanted pairs are themselves derived: a region and each model below it
    pairs = cut(L.closure(every, of_type(nodes, "source"), max_depth=2).filter("node LIKE 'c%'").select(F.col("start").alias("source"), F.col("node").alias("target")))
    return L.find_paths(every, pairs, 2).withColumn("path", F.array_join("path", ">"))


@query("l04_roots_leaves", f"WITH {_ND}, {_ED} SELECT node, 'root' AS role FROM nodes WHERE node NOT IN (SELECT target FROM edges) UNION ALL SELECT node, 'leaf' FROM nodes WHERE node NOT IN (SELECT source FROM edges)")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.graph_roots(nodes, edges).select("node", F.lit("root").alias("role")).unionByName(L.graph_leaves(nodes, edges).select("node", F.lit("leaf").alias("role")))


@query("l04_graph_counts", f"WITH {_ND}, {_ED} SELECT 'node:'||type AS kind, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge:'||kind, count(*) FROM edges GROUP BY kind")
def _(spark, sf):
    return L.graph_counts(*graph(spark, sf))


@query("l05_impact_analysis", _DOWN + """ SELECT s.node AS start, count(cl.node) AS affected, coalesce(max(depth),0) AS max_depth, count(*) FILTER (n.type='dataset') AS datasets, count(*) FILTER (n.type='model') AS models, count(*) FILTER (n.type='output') AS outputs
   FROM nodes s LEFT JOIN cl ON cl.start=s.node LEFT JOIN nodes n ON n.node=cl.node GROUP BY s.node""")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.impact_analysis(nodes, edges, nodes.select("node"))


# every customer proposes an edge: back into its region (a cycle), to itself, into a node that
# does not exist, or into a new model (fine)
@query("l06_admit_edges", """SELECT 'c'||c_custkey AS source, 'r'||n_regionkey AS target, false AS accepted, 'cycle' AS reason FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_custkey%10=1
   UNION ALL SELECT 'c'||c_custkey, 'm'||c_custkey, true, NULL FROM customer WHERE c_custkey%10 NOT IN (1,3,4) UNION ALL SELECT 'c'||c_custkey, 'x'||c_custkey, false, 'unknown_node' FROM customer WHERE c_custkey%10=3
   UNION ALL SELECT 'c'||c_custkey, 'c'||c_custkey, false, 'cycle' FROM customer WHERE c_custkey%10=4""")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    m, k = F.col("c_custkey") % 10, F.col("c_custkey").cast("string")
    target = F.when(m == 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).when(m == 3, F.concat(F.lit("x"), k)).when(m == 4, F.concat(F.lit("c"), k)).otherwise(F.concat(F.lit("m"), k))
    new = c.select(F.concat(F.lit("c"), k).alias("source"), target.alias("target"))
    extra = c.select(F.concat(F.lit("m"), k).alias("node"))
    return L.admit_edges(nodes.select("node").unionByName(extra), edges, new)


@query("l07_lineage_query", f"""WITH {_ND}, {_ED}, d AS (SELECT source AS start, target AS node, 1 AS depth, 'down' AS direction FROM edges WHERE source LIKE 'c%' AND kind='joined' UNION ALL SELECT target, source, 1, 'up' FROM edges WHERE target LIKE 'c%' AND kind='filtered')
   SELECT d.start, d.node, d.depth, d.direction, type FROM d JOIN nodes ON nodes.node=d.node WHERE type IN ('output','dataset')""")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.lineage_query(nodes, edges, of_type(nodes, "model"), "both", 2, ["joined", "filtered"], ["output", "dataset"])


@query("p04_lineage_nodes", f"WITH {_ND} SELECT node FROM nodes WHERE type IN ('dataset','model') AND (type='dataset' OR substr(node,2)::BIGINT%5 IN (1)) AND created BETWEEN 1 AND 2")
def _(spark, sf):
    nodes, _ = graph(spark, sf)
    return L.lineage_nodes(nodes, ["dataset", "model"], ["dataset", "g1"], F.lit(1), F.lit(2)).select("node")


@query("l08_remove_node", f"WITH {_ED} SELECT source, target, kind FROM edges WHERE NOT (source LIKE 'c%0' OR target LIKE 'c%0')")
def _(spark, sf):
    nodes, edges = graph(spark, sf)
    return L.remove_node(nodes, edges, nodes.filter("node LIKE 'c%0'"))[1].select("source", "target", "kind")


@query("l09_lineage_from_runs", """SELECT DISTINCT i AS source, o AS target, CASE event_type WHEN 'click' THEN 'derived' WHEN 'view' THEN 'aggregated' WHEN 'error' THEN 'filtered' WHEN 'signup' THEN 'anonymized' ELSE 'sampled' END AS kind
   FROM (SELECT event_type, user_id, unnest(['raw'||(user_id%50), 'k'||(props->>'$.k')]) AS i FROM events) a, LATERAL (SELECT 'out'||a.user_id AS o)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    kinds = {"click": "derived", "view": "aggregated", "error": "filtered", "signup": "anonymized"}
    kind = F.lit("sampled")
    for a, b in kinds.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    runs = e.select(kind.alias("kind"), F.array(F.concat(F.lit("raw"), (F.col("user_id") % 50).cast("string")), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("inputs"),
                    F.array(F.concat(F.lit("out"), F.col("user_id").cast("string"))).alias("outputs"))
    return L.lineage_from_runs(runs)
