"""Source, predicate, content, quality and sampling queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import conditions as X, text as T
from ..operators import content as C, detect as D, quality as Q, sampling as M
from ..session import spread, table, workspace
from ..sources import io as S
from .anonymization import hexn, hmac_sql
from .detection import docs, found
from .pii_sql import DOC_DET, q
from .privacy import HIER
from .registry import query


# ------------------------------------------------------------------------------ sources
@query("s01_read_dataset", "SELECT 'parquet' AS fmt, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders UNION ALL SELECT 'json', count(*), round(sum(o_totalprice),2) FROM orders"
       " UNION ALL SELECT 'csv', count(*), round(sum(o_totalprice),2) FROM orders UNION ALL SELECT 'orc', count(*), round(sum(o_totalprice),2) FROM orders")
def _(spark, sf):
    o = S.read_dataset(spark, f"{sf}/orders.parquet", "parquet").select("o_orderkey", "o_totalprice")
    out = None
    for fmt, comp in (("parquet", None), ("json", "gzip"), ("csv", "gzip"), ("orc", "zstd")):
        df = o
        if comp:
            path = workspace(spark, "formats")
            S.write_dataset(o, path, fmt, comp)
            df = S.read_dataset(spark, path, fmt, "o_orderkey bigint, o_totalprice double")
        part = df.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(fmt).alias("fmt"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("s02_import_jsonl", "SELECT CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE 'good' END AS outcome, count(*) AS lines, CAST(coalesce(sum(CASE WHEN event_id % 13 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END),0) AS BIGINT) AS total FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    path = workspace(spark, "jsonl")
    e.select(line.alias("value")).write.text(path)
    good, bad = S.import_jsonl(spark, path)
    a = good.agg(F.count("*").alias("lines"), F.sum(F.variant_get("payload", "$.k", "bigint")).alias("total")).withColumn("outcome", F.lit("good"))
    b = bad.agg(F.count("*").alias("lines"), F.lit(0).cast("bigint").alias("total")).withColumn("outcome", F.lit("bad"))
    return a.unionByName(b)


DOC_SCHEMA = Q.Schema((Q.Field("doc_id", "integer", nullable=False), Q.Field("text", "string", nullable=False, min_length=200),
                       Q.Field("lang", "enum", one_of=("en", "fr", "de")), Q.Field("n", "integer", max_value=5000.0)))
_DOC_ERR = "((length(text)<200)::INT + (lang NOT IN ('en','fr','de'))::INT*2 + (n_chars>5000)::INT)"


def doc_records(spark, sf):
    return docs(spark, sf).select("doc_id", "source", F.to_json(F.struct("doc_id", "text", "lang", F.col("n_chars").alias("n"))).alias("json"))


@query("s03_ingest_validated", f"SELECT source, count(*) FILTER ({_DOC_ERR}=0) AS added, count(*) FILTER ({_DOC_ERR}>0) AS rejected, sum({_DOC_ERR})::BIGINT AS errors FROM documents GROUP BY source")
def _(spark, sf):
    return S.ingest_counts(doc_records(spark, sf), "json", DOC_SCHEMA, ["source"])


@query("s03_rejected_records", f"SELECT doc_id FROM documents WHERE {_DOC_ERR}>0")
def _(spark, sf):
    return S.ingest_validated(doc_records(spark, sf), "json", DOC_SCHEMA)[1].select("doc_id")


@query("s04_ingest_idempotent", "SELECT user_id, props, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE (user_id, props) NOT IN (SELECT user_id, props FROM events WHERE event_type='signup') GROUP BY user_id, props")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "props", "event_id", "ts", "event_type")
    old = e.filter("event_type = 'signup'")
    return S.ingest_idempotent(e, ["user_id", "props"], ["ts", "event_id"], old).select("user_id", "props", "event_id")


def source_files(spark, sf, path):
    """Texts as files of a source; a file is one row when it is read, so its rows are bounded."""
    docs(spark, sf).select("source", F.col("text").alias("value")).write.option("maxRecordsPerFile", 1000).partitionBy("source").text(path)


@query("s05_scan_files", f"{DOC_DET} SELECT source, pii_type, count(*) AS hits FROM det JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    path = workspace(spark, "files")
    source_files(spark, sf, path)
    hits = S.scan_files(spark, path, include="*.txt", exclude="_*", max_mb=None)
    return hits.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "pii_type").agg(F.count("*").alias("hits"))


@query("s05_file_report", f"""{DOC_DET}, c AS (SELECT source, count(*) AS hits FROM det JOIN documents USING (doc_id) GROUP BY source)
   SELECT source, true AS scanned, coalesce(hits,0) AS hits, 0 AS errors FROM (SELECT DISTINCT source FROM documents) LEFT JOIN c USING (source)""")
def _(spark, sf):
    path = workspace(spark, "files")
    source_files(spark, sf, path)
    report = S.file_report(spark, path, include="*.txt", max_mb=None)
    return report.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("source")).agg(F.bool_and("scanned").alias("scanned"), F.sum("hits").alias("hits"), F.count("error").cast("int").alias("errors"))


@query("s06_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' AND o_totalprice > 100000")
def _(spark, sf):
    path = workspace(spark, "export")
    S.export(table(spark, sf, "orders"), path, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F' AND o_totalprice > 100000", [F.desc("o_totalprice")], "json", "gzip")
    return S.read_dataset(spark, path, "jsonl", "o_orderkey bigint, o_totalprice double")


@query("s07_put_content", "SELECT sha256(text) AS hash, left(sha256(text),4) AS shard, length(any_value(text)) AS n FROM documents GROUP BY sha256(text)")
def _(spark, sf):
    d = docs(spark, sf)
    path = workspace(spark, "store")
    first = S.put_content(d.filter("lang <> 'en'"), "text", path)
    # what the second call adds is what the first has not stored
    return first.unionByName(S.put_content(d, "text", path)).select("hash", "shard", F.length("payload").alias("n"))


@query("s08_write_audit", "SELECT strftime(ts,'%Y-%m') AS month, event_type, count(*) AS n FROM events WHERE strftime(ts,'%Y-%m') BETWEEN '2024-01' AND '2024-01' GROUP BY ALL")
def _(spark, sf):
    path = workspace(spark, "audit")
    S.write_audit(table(spark, sf, "events"), path, "ts")
    return S.read_audit(spark, path, "2024-01", "2024-01").groupBy(F.col("month").cast("string").alias("month"), "event_type").agg(F.count("*").alias("n"))


_LINES = f"""{DOC_DET}, loc AS (SELECT det.*, left(text, start_pos) AS b FROM det JOIN documents USING (doc_id)),
  hit AS (SELECT doc_id, pii_type, length(b)-length(replace(b,chr(10),''))+1 AS line, length(list_last(string_split(b,chr(10))))+1 AS col, value, risk FROM loc)"""


@query("s09_scan_report", _LINES + " SELECT doc_id, pii_type, line, col AS \"column\", value, risk FROM hit")
def _(spark, sf):
    return S.locate_hits(docs(spark, sf), "text", ["doc_id"])


_SUMMARY = """ SELECT pii_type, count(*) AS hits, max(risk) AS max_risk, count(*) > 0 AS failed FROM hit GROUP BY pii_type
   UNION ALL SELECT '*', count(*), max(risk), count(*) > 0 FROM hit"""


@query("s09_scan_summary", _LINES + _SUMMARY)
def _(spark, sf):
    return S.scan_report(S.locate_hits(docs(spark, sf), "text", ["doc_id"]), "summary")


@query("s09_scan_summary_clean", _LINES + ", clean AS (SELECT * FROM hit WHERE doc_id < 0)" + _SUMMARY.replace("FROM hit", "FROM clean"))
def _(spark, sf):
    return S.scan_report(S.locate_hits(docs(spark, sf), "text", ["doc_id"]).filter("doc_id < 0"), "summary")


def _written(fmt):
    def run(spark, sf):
        folder = f"{workspace(spark, 'scan')}/{fmt}"
        S.scan_report(S.locate_hits(docs(spark, sf), "text", ["doc_id"]), fmt, folder)
        return S.read_report(spark, fmt, folder)

    return run


query("s09_scan_report_json", _LINES + " SELECT doc_id, pii_type, line, col AS \"column\", value, risk FROM hit")(_written("json"))
query("s09_scan_report_csv", _LINES + " SELECT doc_id, pii_type, line, col AS \"column\", value, risk FROM hit")(_written("csv"))


_EXPORT_K = 8


def _s10_sql():
    from ..operators.privacy import lattice

    h = {"c_nationkey": ["c_nationkey", "floor(c_nationkey/5)::INT", "0"], "c_mktsegment": ["c_mktsegment", "'*'"]}
    parts, i = [], 0
    for n in lattice({"c_nationkey": [1, 2, 3], "c_mktsegment": [1, 2]}):
        parts.append(f"SELECT {i} AS node, o_orderkey, {h['c_nationkey'][n[0]]} AS c_nationkey, {h['c_mktsegment'][n[1]]} AS c_mktsegment, c_name, o_orderdate FROM base")
        i += 1
    return (f"WITH base AS (SELECT * FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderpriority='1-URGENT'), g AS ({' UNION ALL '.join(parts)}), "
            f"s AS (SELECT *, count(*) OVER (PARTITION BY node, c_nationkey, c_mktsegment) AS class_size FROM g), "
            f"best AS (SELECT min(node) AS node FROM (SELECT node FROM s GROUP BY node HAVING count(*) FILTER (class_size<{_EXPORT_K}) <= 0.05*count(*))) "
            f"SELECT o_orderkey, c_nationkey, c_mktsegment, {hmac_sql('c_name')} AS c_name, strftime(date_trunc('month',o_orderdate),'%Y-%m-%d') AS o_orderdate, class_size FROM s WHERE node=(SELECT node FROM best) AND class_size>={_EXPORT_K}")


@query("s10_anonymized_export", _s10_sql())
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = S.anonymized_export(joined, ["o_orderkey", "c_name", "c_nationkey", "c_mktsegment", "o_orderdate"], F.col("o_orderpriority") == "1-URGENT",
                              "o_orderdate", "month", "c_name", "pseudonym-key", {k: HIER[k] for k in ("c_nationkey", "c_mktsegment")}, _EXPORT_K)
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


# ------------------------------------------------------------------------------ predicates
@query("p02_query_records", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag <> 'N'")
def _(spark, sf):
    from ..operators.records import query_records

    return query_records(table(spark, sf, "lineitem"), "l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag <> 'N'", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("p01_list_records", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='O' AND o_orderpriority='2-HIGH' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def _(spark, sf):
    from ..operators.records import list_records

    out = list_records(table(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "2-HIGH", "o_custkey": None},
                       [F.desc("o_totalprice"), "o_orderkey"], 50, 25)
    return out.select("o_orderkey", "o_totalprice")


@query("p03_audit_query", "SELECT event_id, user_id FROM events WHERE event_type='error' AND user_id=7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts, event_id LIMIT 100")
def _(spark, sf):
    from ..operators.records import audit_query

    return audit_query(table(spark, sf, "events"), {"event_type": "error", "user_id": 7, "props": None}, "ts", "2024-01-05", "2024-01-25",
                       ["ts", "event_id"], 100).select("event_id", "user_id")


@query("p06_find_by_tag", "SELECT event_id FROM events WHERE props->>'$.k' = '42'")
def _(spark, sf):
    from ..operators.records import find_by_tag

    tagged = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("tags"))
    return find_by_tag(tagged, "tags", "k", "42").select("event_id")


@query("p06_metadata_index", "SELECT 'k' AS tag, props->>'$.k' AS value, event_id AS key FROM events")
def _(spark, sf):
    from ..operators.records import metadata_index

    tagged = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("tags"))
    return metadata_index(tagged, "tags", "event_id").withColumnRenamed("event_id", "key")


@query("p06_metadata_index_sizes", "SELECT 'k' AS tag, props->>'$.k' AS value, count(*) AS keys FROM events GROUP BY 2")
def _(spark, sf):
    from ..operators.records import metadata_index

    tagged = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("tags"))
    return metadata_index(tagged, "tags", "event_id").groupBy("tag", "value").agg(F.count("*").alias("keys"))


_CONDS = [("eq_type", X.Condition("event_type", "eq", "click"), "event_type='click'"), ("ne_type", X.Condition("event_type", "ne", "click"), "event_type<>'click'"),
          ("lt", X.Condition("value", "lt", 5), "value<5"), ("le", X.Condition("user_id", "le", 10), "user_id<=10"), ("gt", X.Condition("value", "gt", 50), "value>50"),
          ("ge", X.Condition("user_id", "ge", 140), "user_id>=140"), ("between_", X.Condition("value", "between", (3, 9)), "value BETWEEN 3 AND 9"),
          ("contains_", X.Condition("event_type", "contains", "ic"), "contains(event_type,'ic')"), ("starts", X.Condition("event_type", "starts_with", "s"), "starts_with(event_type,'s')"),
          ("ends", X.Condition("event_type", "ends_with", "r"), "ends_with(event_type,'r')"), ("matches_", X.Condition("props", "matches", "[13579]}$"), "regexp_matches(props,'[13579]}$')"),
          ("in_", X.Condition("event_type", "in", ["view", "error"]), "event_type IN ('view','error')"), ("not_in_", X.Condition("event_type", "not_in", ["view", "error"]), "event_type NOT IN ('view','error')"),
          ("like_", X.Condition("event_type", "like", ["*i?w", "cl*"]), "regexp_matches(event_type,'^.*i.w$') OR regexp_matches(event_type,'^cl.*$')"),
          ("after_", X.Condition("ts", "after", "2024-01-15 00:00:00"), "ts > TIMESTAMP '2024-01-15 00:00:00'")]


@query("p07_compile_conditions", "SELECT event_id, " + ", ".join(f"({s}) AS {n}" for n, _, s in _CONDS) + " FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", *[X.compile_condition(c).alias(n) for n, c, _ in _CONDS])


@query("p08_rule_tree", "SELECT event_id FROM events WHERE (event_type IN ('click','view') OR (value > 20 AND user_id < 50)) AND NOT (user_id = 3 OR value > 90)")
def _(spark, sf):
    tree = X.Rules(any=(X.Condition("event_type", "in", ["click", "view"]), X.Rules(all=(X.Condition("value", "gt", 20), X.Condition("user_id", "lt", 50)))),
                   none_of=(X.Condition("user_id", "eq", 3), X.Condition("value", "gt", 90)))
    return table(spark, sf, "events").filter(X.compile_rules(tree)).select("event_id")


@query("p09_glob_match", "SELECT page_id, regexp_matches(url,'^http.*://.*example\\.com/.*$') AS escaped, regexp_matches(url,'^http.://.*example.net/.*$') AS unescaped FROM pages")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.glob_match(u, "http*://*example.com/*").alias("escaped"), X.glob_match(u, "http?://*example.net/*", escape_dots=False).alias("unescaped"))


@query("p10_minimise", "SELECT user_id, event_type, strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(spark, sf):
    from ..operators.records import minimise

    return minimise(table(spark, sf, "events"), ["user_id", "event_type", "ts"], "ts", "hour").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("p11_normalize_path", "SELECT page_id, regexp_replace(regexp_replace(url,'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}','{id}','g'),'/[0-9]+(/|$)','/{id}\\1','g') AS path FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path"))


@query("p12_sanitize_text", "SELECT page_id, trim(regexp_replace(regexp_replace(replace(html,chr(0),''),'<[^>]*>','','g'),'\\s+',' ','g')) AS clean, left(trim(regexp_replace(regexp_replace(replace(html,chr(0),''),'<[^>]*>','','g'),'\\s+',' ','g')),10000) AS limited, array_to_string(regexp_extract_all(lower(html),'[a-z ]+'),'') AS letters FROM pages")
def _(spark, sf):
    letters = T.SanitizeRules(lower=True, allowed="[a-z ]+")
    return spread(table(spark, sf, "pages")).select("page_id", T.sanitize(F.col("html")).alias("clean"), T.sanitize(F.col("html"), replace(T.STRICT, max_length=10_000)).alias("limited"), T.sanitize(F.col("html"), letters).alias("letters"))


def _any_sql(col, pats):
    return "(" + " OR ".join(f"regexp_matches({col},{q(p)})" for p in pats) + ")"


@query("p13_flag_injection", f"""SELECT page_id, r AS rule, l AS level FROM (
   SELECT page_id, 'sql_injection' AS r, 'critical' AS l FROM pages WHERE {_any_sql('html', T.SQL_INJECTION)} UNION ALL SELECT page_id, 'xss','high' FROM pages WHERE {_any_sql('html', T.XSS)}
   UNION ALL SELECT page_id, 'path_traversal','high' FROM pages WHERE {_any_sql('html', T.PATH_TRAVERSAL)} UNION ALL SELECT page_id, 'blocked_pattern','medium' FROM pages WHERE regexp_matches(html,'track[(]1')
   UNION ALL SELECT page_id, 'blocked_agent','medium' FROM pages WHERE contains(lower(html),'thther'))""")
def _(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select("page_id", F.explode(T.threats(F.col("html"), ["track[(]1"], ["ThTher"])).alias("t")).select("page_id", "t.rule", "t.level")


@query("p14_validate_strings", f"""SELECT page_id, CASE WHEN NOT regexp_matches(url,'^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'url_format' WHEN NOT regexp_matches(url,'^https?:') THEN 'url_scheme' WHEN {_any_sql('url', T.SQL_INJECTION + T.XSS + T.PATH_TRAVERSAL)} THEN 'content' END AS url_error,
   CASE WHEN {_any_sql('url', T.PATH_TRAVERSAL)} THEN 'path_traversal' WHEN regexp_matches(split_part(url,'/',5),'[/\\\\:*?"<>|]') THEN 'dangerous_char' WHEN length(split_part(url,'/',5))>255 THEN 'filename_length' WHEN starts_with(split_part(url,'/',5),'.') THEN 'hidden_file' END AS file_error,
   'email_format' AS email_error FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    name = F.coalesce(F.get(F.split("url", "/"), F.lit(4)), F.lit(""))
    return p.select("page_id", T.validate_url(F.col("url")).alias("url_error"), T.validate_filename(name).alias("file_error"), T.validate_email(F.col("url")).alias("email_error"))


_NETS = [("0.0.0.0/1", "block"), ("172.0.0.0/6", "allow"), ("224.0.0.0/4", "block"), ("227.0.0.0/8", "allow")]


@query("p15_ip_filter", f"""{DOC_DET}, ips AS (SELECT doc_id, start_pos, value, split_part(value,'.',1)::BIGINT AS a FROM det WHERE pii_type='ip_address')
   SELECT doc_id, start_pos, value, NOT ((a < 128 OR a BETWEEN 224 AND 239) AND NOT (a BETWEEN 172 AND 175 OR a = 227)) AS allowed FROM ips""")
def _(spark, sf):
    ips = found(spark, sf).filter("pii_type = 'ip_address'").select("doc_id", "start_pos", "value")
    return T.ip_filter(ips, "value", spark.createDataFrame(_NETS, "network string, list string"))


_TG = "list_distinct(list_transform(range(1, length(p)-1), lambda i: substr(p,i,3)))"


@query("p17_search_names", f"""WITH a AS (SELECT p_partkey, p_name, '  '||lower(p_name)||' ' AS p FROM part), b AS (SELECT p_partkey, p_name, {_TG} AS t FROM a),
   c AS (SELECT p_partkey, p_name, len(list_intersect(t, qt)) AS c, len(t)+len(qt)-len(list_intersect(t,qt)) AS u FROM b, (SELECT {_TG} AS qt FROM (SELECT '  red wigdet ' AS p)))
   SELECT p_partkey, p_name, round(c/u,6) AS score FROM c WHERE round(c/u,6) >= 0.3 OR p_name ILIKE '%red wigdet%'""")
def _(spark, sf):
    return T.search_names(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "red wigdet")


# ------------------------------------------------------------------------------ content
@query("c01_content_address", "SELECT doc_id, 'sha256:'||sha256(text) AS address, 'sha256/'||left(sha256(text),4)||'/'||substr(sha256(text),5) AS key, 'sha256:'||sha256(text) AS parsed FROM documents")
def _(spark, sf):
    a = docs(spark, sf).select("doc_id", C.content_address(F.col("text")).alias("address"))
    return a.withColumn("key", C.storage_key(F.col("address"))).withColumn("parsed", C.parse_key(F.col("key")))


@query("c02_dedup_content", "SELECT sha256(text) AS hash, octet_length(encode(any_value(text)))::BIGINT AS size, count(*) AS ref_count, octet_length(encode(any_value(text)))::BIGINT*(count(*)-1) AS bytes_saved FROM documents GROUP BY sha256(text)")
def _(spark, sf):
    return C.dedup_content(docs(spark, sf), "text")


_HEX = "hex(encode(text))"
_CHUNKS = f"""h AS (SELECT doc_id, {_HEX} AS hx FROM documents), f AS (SELECT doc_id, hx, unnest(range(0, greatest(length(hx)//2,1), 1024)) AS off FROM h),
   ch AS (SELECT doc_id, (off//1024)::INT AS idx, off::INT AS "offset", (length(substr(hx, 2*off+1, 2048))//2)::INT AS size, sha256(unhex(substr(hx, 2*off+1, 2048))) AS hash, (length(hx)//2)::INT AS total_size FROM f)"""


def chunks(spark, sf):
    return C.chunk_fixed(docs(spark, sf), "text", "doc_id", 1024)


@query("c03_chunk_fixed", f"WITH {_CHUNKS} SELECT * FROM ch")
def _(spark, sf):
    return chunks(spark, sf).drop("data")


_ENDS = "(('0x'||left(sha256(line),8))::UBIGINT % 4 = 0)"


@query("c04_chunk_by_content", f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line, unnest(range(1,len(string_split(text,chr(10)))+1)) AS n FROM documents),
   s AS (SELECT doc_id, n, length(line) AS size, 0 AS idx, length(line)>=200 AND {_ENDS} AS closed, line FROM l WHERE n=1
     UNION ALL SELECT l.doc_id, l.n, CASE WHEN s.closed OR s.size+1+length(l.line)>2000 THEN length(l.line) ELSE s.size+1+length(l.line) END,
       CASE WHEN s.closed OR s.size+1+length(l.line)>2000 THEN s.idx+1 ELSE s.idx END,
       (CASE WHEN s.closed OR s.size+1+length(l.line)>2000 THEN length(l.line) ELSE s.size+1+length(l.line) END)>=200 AND {_ENDS.replace('line', 'l.line')}, l.line
     FROM s JOIN l ON l.doc_id=s.doc_id AND l.n=s.n+1)
   SELECT doc_id, idx, max(size)::INT AS size, sha256(string_agg(line, chr(10) ORDER BY n)) AS hash FROM s GROUP BY doc_id, idx""")
def _(spark, sf):
    return C.chunk_by_content(docs(spark, sf), "text", "doc_id").drop("chunk")


@query("c05_validate_manifest", f"""WITH {_CHUNKS}, bad AS (SELECT * FROM ch WHERE NOT (doc_id%7=0 AND idx=1)), bad2 AS (SELECT doc_id, idx, CASE WHEN doc_id%11=0 AND idx=0 THEN "offset"+1 ELSE "offset" END AS "offset", size, total_size FROM bad),
   w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS p, sum(size) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM bad2),
   r AS (SELECT doc_id, bool_and(idx=p-1) AS contiguous, bool_and("offset"=upto-size) AS offsets_ok, sum(size)=max(total_size) AS total_ok FROM w GROUP BY doc_id)
   SELECT *, contiguous AND offsets_ok AND total_ok AS valid FROM r""")
def _(spark, sf):
    c = chunks(spark, sf).filter(~((F.col("doc_id") % 7 == 0) & (F.col("idx") == 1)))
    c = c.withColumn("offset", F.when((F.col("doc_id") % 11 == 0) & (F.col("idx") == 0), F.col("offset") + 1).otherwise(F.col("offset")))
    return C.validate_manifest(c, "doc_id")


@query("c06_reassemble", "SELECT doc_id, text, sha256(text) AS checksum FROM documents")
def _(spark, sf):
    r = C.reassemble(chunks(spark, sf), "doc_id")
    return r.select("doc_id", F.decode("payload", "UTF-8").alias("text"), "checksum")


@query("c07_orphans", f"WITH {_CHUNKS} SELECT DISTINCT hash FROM ch JOIN documents USING (doc_id) WHERE hash NOT IN (SELECT hash FROM ch JOIN documents USING (doc_id) WHERE lang='en')")
def _(spark, sf):
    c = C.chunk_fixed(docs(spark, sf).withColumn("ref", F.struct("doc_id", "lang")), "text", "ref", 1024)
    return C.orphans(c.select("hash").distinct(), c.filter("ref.lang = 'en'"))


@query("c08_storage_stats", """WITH a AS (SELECT split_part(url,'/',3) AS prefix, octet_length(encode(html)) AS b, row_number() OVER (PARTITION BY sha256(html) ORDER BY page_id) AS r FROM pages)
   SELECT prefix, count(*) AS objects, sum(b)::BIGINT AS bytes, sum(CASE WHEN r=1 THEN b ELSE 0 END)::BIGINT AS stored_bytes, round(sum(CASE WHEN r=1 THEN b ELSE 0 END)/sum(b),6)::DOUBLE AS ratio, sum(CASE WHEN r=1 THEN 0 ELSE b END)::BIGINT AS savings FROM a GROUP BY prefix""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", C.content_hash(F.col("html")).alias("hash"), F.octet_length("html").cast("bigint").alias("size"))
    first = p.groupBy("hash").agg(F.min("page_id").alias("keeper"))
    o = p.join(first, "hash").withColumn("stored", F.when(F.col("page_id") == F.col("keeper"), F.col("size")).otherwise(0))
    return C.storage_stats(o, F.get(F.split("url", "/"), F.lit(2)), "size", "stored")


@query("c09_checksum", "SELECT doc_id, sha256(text) AS checksum, true AS ok FROM documents")
def _(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", C.checksum(F.col("text")).alias("checksum"), (C.checksum(F.col("text")) == F.sha2(F.col("text").cast("binary"), 256)).alias("ok"))


# ------------------------------------------------------------------------------ quality
_PROP_SCHEMA = Q.Schema((Q.Field("k", "integer", nullable=False, min_value=5.0, max_value=90.0), Q.Field("tag", "string", nullable=False)), strict=True)


@query("q01_validate_schema", """WITH v AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, event_id%5 AS m FROM events), e AS (
   SELECT event_id, '' AS field, 'type' AS c FROM v WHERE m=4
   UNION ALL SELECT event_id, 'tag','required' FROM v WHERE m IN (0,1) UNION ALL SELECT event_id,'tag','nullable' FROM v WHERE m=2 UNION ALL SELECT event_id,'k','type' FROM v WHERE m=1
   UNION ALL SELECT event_id,'k','min_value' FROM v WHERE m IN (0,2,3) AND k<5 UNION ALL SELECT event_id,'k','max_value' FROM v WHERE m IN (0,2,3) AND k>90 UNION ALL SELECT event_id,'extra','unknown_field' FROM v WHERE m=3)
   SELECT event_id, field, c AS "constraint" FROM e""")
def _(spark, sf):
    m, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    j = (F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit('{"k":"'), k, F.lit('"}')))
         .when(m == 2, F.concat(F.lit('{"k":'), k, F.lit(',"tag":null}'))).when(m == 3, F.concat(F.lit('{"k":'), k, F.lit(',"tag":"x","extra":1}')))
         .otherwise(F.concat(F.lit("["), k, F.lit("]"))))
    return Q.error_rows(Q.validate_json(spread(table(spark, sf, "events").select("event_id", j.alias("json"))), "json", _PROP_SCHEMA), ["event_id"])


_ORDER_SCHEMA = Q.Schema((Q.Field("o_orderkey", "integer", nullable=False), Q.Field("o_totalprice", "float", min_value=1000.0, max_value=450000.0),
                          Q.Field("o_orderstatus", "enum", one_of=("O", "F")), Q.Field("o_orderpriority", "string", min_length=6, max_length=10, pattern="^[1-4]"), Q.Field("o_clerk", "string", nullable=False)))
_OQ = """e AS (SELECT 'o_clerk' AS field, 'required' AS c FROM orders UNION ALL SELECT 'o_totalprice','min_value' FROM orders WHERE o_totalprice<1000 UNION ALL SELECT 'o_totalprice','max_value' FROM orders WHERE o_totalprice>450000
  UNION ALL SELECT 'o_orderstatus','one_of' FROM orders WHERE o_orderstatus NOT IN ('O','F') UNION ALL SELECT 'o_orderpriority','min_length' FROM orders WHERE length(o_orderpriority)<6
  UNION ALL SELECT 'o_orderpriority','max_length' FROM orders WHERE length(o_orderpriority)>10 UNION ALL SELECT 'o_orderpriority','pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority,'^[1-4]'))"""


@query("q02_check_constraints", f"WITH {_OQ} SELECT field, c AS \"constraint\", count(*) AS violations FROM e GROUP BY ALL")
def _(spark, sf):
    return Q.constraint_counts(Q.validate_columns(table(spark, sf, "orders"), _ORDER_SCHEMA))


@query("q03_check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def _(spark, sf):
    return Q.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q04_check_foreign_key", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def _(spark, sf):
    parents = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return Q.check_foreign_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey").select("o_orderkey")


for _action, _sql in (("cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal<0)"),
                      ("set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal<0) THEN o_custkey END AS o_custkey FROM orders"),
                      ("restrict", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal<0)")):
    @query(f"q04_delete_{_action}", _sql)
    def _(spark, sf, action=_action):
        doomed = table(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey")
        return Q.delete_parents(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", doomed, action).select("o_orderkey", "o_custkey")


@query("q06_json_limits", "SELECT doc_id, 'tags' AS path, 1 AS depth, 'max_array_length' AS rule FROM documents WHERE len(string_split(text,chr(10)))>10 UNION ALL SELECT doc_id, 'text', 1, 'max_length' FROM documents WHERE octet_length(encode(text))>4000"
       " UNION ALL SELECT doc_id, 'a.b.c', 3, 'max_depth' FROM documents")
def _(spark, sf):
    j = docs(spark, sf).select("doc_id", F.to_json(F.struct(
        "text", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("tags"),
        F.struct(F.struct(F.col("n_chars").alias("c")).alias("b")).alias("a"))).alias("json"))
    return Q.json_limits(j, "json", ["doc_id"], max_depth=2, max_array=10, max_string=4000)


_EN = "cnt AS (SELECT doc_id, count(*) AS c FROM det GROUP BY doc_id)"


@query("q07_dataset_stats", f"{DOC_DET}, {_EN} SELECT source, count(*) AS records, sum(octet_length(encode(text)))::BIGINT AS bytes, round(avg(octet_length(encode(text))),6) AS mean_bytes, max(octet_length(encode(text)))::INT AS max_bytes, count(c) AS pii_records FROM documents LEFT JOIN cnt USING (doc_id) GROUP BY source")
def _(spark, sf):
    spans = D.with_spans(docs(spark, sf), "text").select("source", "text", F.size("spans").alias("entities"))
    return Q.dataset_stats(spans, "source", F.octet_length("text"), "entities")


@query("q07_access_stats", "SELECT event_type, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_access, count(*) AS queries, count(*) FILTER (ts > TIMESTAMP '2024-01-29 00:00:00') AS queries_24h FROM events GROUP BY event_type")
def _(spark, sf):
    out = Q.access_stats(table(spark, sf, "events"), "event_type", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("last_access", F.date_format("last_access", "yyyy-MM-dd HH:mm:ss"))


def _fs(c, num):
    x = f"min({c})::DOUBLE, max({c})::DOUBLE, round(avg({c}),4)::DOUBLE" if num else "NULL, NULL, NULL"
    return f"SELECT '{c}' AS field, count({c}) AS non_null, count(*)-count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, {x} FROM orders"


@query("q08_field_stats", "SELECT * FROM (" + " UNION ALL ".join(_fs(c, n) for c, n in (("o_custkey", 1), ("o_totalprice", 1), ("o_orderstatus", 0), ("o_orderpriority", 0))) + ") t(field, non_null, nulls, distinct_values, min_value, max_value, mean_value)")
def _(spark, sf):
    return Q.field_stats(table(spark, sf, "orders"), ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]).drop("min_text", "max_text")


@query("q09_quality_metrics", """WITH m AS (SELECT avg((o_orderstatus IS NOT NULL)::INT) AS c, avg((o_totalprice>=1000 AND o_totalprice<=450000 AND o_orderstatus IN ('O','F') AND length(o_orderpriority) BETWEEN 6 AND 10 AND regexp_matches(o_orderpriority,'^[1-4]'))::INT) AS v,
   avg((o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal>=0))::INT) AS k, avg((o_orderdate >= TIMESTAMP '1996-01-01')::INT) AS t FROM orders)
   SELECT round(c,6) AS completeness, round(v,6) AS validity, round(k,6) AS consistency, round(t,6) AS timeliness, round((c+v+k+t)/4,6) AS overall FROM m""")
def _(spark, sf):
    schema = Q.Schema(_ORDER_SCHEMA.fields[:-1])
    return Q.quality_metrics(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], schema, "o_custkey", table(spark, sf, "customer").filter("c_acctbal >= 0"),
                             "c_custkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"))


# ------------------------------------------------------------------------------ sampling, paging
def _hk(seed, key):
    return f"sha256('{seed}|'||{key})"


def _unit(seed, key):
    return f"({hexn(_hk(seed, key), 1, 13)}/4503599627370496.0::DOUBLE)"


@query("m01_sample_random_n", f"SELECT doc_id FROM documents ORDER BY {_hk('s', 'doc_id')}, doc_id LIMIT 100")
def _(spark, sf):
    return M.sample_random(table(spark, sf, "documents").select("doc_id"), "doc_id", "s", n=100)


@query("m01_sample_random_ratio", f"SELECT doc_id FROM documents WHERE {_unit('s', 'doc_id')} < 0.2")
def _(spark, sf):
    return M.sample_random(table(spark, sf, "documents").select("doc_id"), "doc_id", "s", ratio=0.2)


@query("m02_sample_stratified", f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_hk('s', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 20")
def _(spark, sf):
    return M.sample_stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", "s", n=20)


@query("m03_sample_systematic", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r-1)%7=0")
def _(spark, sf):
    return M.sample_systematic(table(spark, sf, "documents").select("doc_id"), "doc_id", None, 7)


@query("m04_sample_reservoir", f"SELECT event_id FROM events ORDER BY {_hk('r', 'event_id')}, event_id LIMIT 500")
def _(spark, sf):
    return M.sample_reservoir(table(spark, sf, "events").select("event_id"), "event_id", "r", 500)


@query("m05_split_corpus", f"SELECT doc_id, CASE WHEN {_unit('split', 'sha256(text)')} < 0.7 THEN 'training' WHEN {_unit('split', 'sha256(text)')} < 0.85 THEN 'validation' WHEN {_unit('split', 'sha256(text)')} < 0.95 THEN 'test' ELSE 'production' END AS split FROM documents")
def _(spark, sf):
    return M.split_corpus(docs(spark, sf), "text", {"training": 0.7, "validation": 0.15, "test": 0.1, "production": 0.05}).select("doc_id", "split")


@query("m06_corpus_entries", """WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
   , g AS (SELECT *, CASE WHEN conv_id%25=0 THEN NULL WHEN conv_id%15=0 THEN ' ' WHEN conv_id%5=0 THEN sha256(text) END AS gt FROM n WHERE role='user')
   SELECT conv_id, turn, text AS prompt, CASE WHEN nr='assistant' THEN nt END AS response, gt AS ground_truth, CASE WHEN gt IS NOT NULL THEN 'ground_truth' WHEN nr='assistant' THEN 'prompt_response' ELSE 'prompt_only' END AS entry_type,
   coalesce(trim(text)<>'',false) AND (CASE WHEN gt IS NOT NULL THEN trim(gt)<>'' WHEN nr='assistant' THEN coalesce(trim(nt)<>'',false) ELSE true END) AS complete FROM g""")
def _(spark, sf):
    turns, c = table(spark, sf, "conversations"), F.col("conv_id")
    # one answer in five is missing, one in three blank
    answer = F.when(c % 25 == 0, F.lit(None)).when(c % 15 == 0, " ").otherwise(F.sha2("text", 256))
    truth = turns.filter("role = 'user' AND conv_id % 5 = 0").select("conv_id", "turn", answer.alias("ground_truth"))
    return M.corpus_entries(turns, "conv_id", "turn", "role", "text", truth)


@query("m07_join_annotations", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def _(spark, sf):
    return M.join_annotations(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", 1).select("doc_id", "quality", "toxic")


@query("m08_score_exact_match", """WITH lines AS (SELECT DISTINCT doc_id, source, lang, trim(regexp_replace(lower(text),'\\s+',' ','g')) AS t FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(text),'\\s+',' ','g')) AS t FROM benchmark)
   SELECT source, count(*) AS pairs, round(avg((b.t IS NOT NULL)::INT),6) AS exact_match FROM lines LEFT JOIN b USING (t) GROUP BY source""")
def _(spark, sf):
    truth = table(spark, sf, "benchmark").select(M.normalised(F.col("text")).alias("t")).distinct().withColumn("expected", F.col("t"))
    d = docs(spark, sf).select("source", "text", M.normalised(F.col("text")).alias("t"))
    pairs = d.join(truth, "t", "left").withColumn("expected", F.coalesce("expected", F.lit("\0")))
    return M.score_exact_match(pairs, "source", "text", "expected")


@query("n01_page", "WITH t AS (SELECT count(*) AS total_items FROM orders) SELECT o_orderkey, 3 AS page, 25 AS page_size, total_items, ceil(total_items/25)::BIGINT AS total_pages, true AS has_previous, 3 < ceil(total_items/25) AS has_next FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50), t")
def _(spark, sf):
    return M.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 3, 25).drop("o_totalprice")


@query("n02_cursor_page", "SELECT o_totalprice, o_orderkey, true AS has_more FROM orders WHERE o_totalprice > 250000 OR (o_totalprice = 250000 AND o_orderkey > 100) ORDER BY o_totalprice, o_orderkey LIMIT 30")
def _(spark, sf):
    return M.cursor_page(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ("o_totalprice", "o_orderkey"), (250000.0, 100), 30)


@query("n02_cursor_page_back", "SELECT o_totalprice, o_orderkey, true AS has_more FROM orders WHERE o_totalprice < 250000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30")
def _(spark, sf):
    return M.cursor_page(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ("o_totalprice", "o_orderkey"), (250000.0, -1), 30, backward=True)


@query("n03_top_k", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def _(spark, sf):
    return M.top_k(table(spark, sf, "orders"), "o_custkey", 10)
