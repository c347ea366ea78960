"""Compliance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anonymize as A, compliance as G, detect as D
from ..session import table
from .anonymization import strat_sql
from .detection import docs, found
from .pii_sql import DOC_DET, q
from .registry import query

FRAMEWORKS = ["gdpr", "hipaa", "ccpa", "soc2", "pci_dss"]
CHOSEN = A.Config(default_strategy="mask", per_type=(("email", "truncate"), ("credit_card", "mask"), ("phone", "mask"), ("ip_address", "none")))


def applied(spark, sf):
    """Detections per source with the strategy used; 'none' counts as untouched."""
    hits = D.detect(docs(spark, sf), "text", ["doc_id", "source"])
    s = A.strategy_for(CHOSEN, F.col("pii_type"), F.col("confidence"))
    return hits.withColumn("strategy", F.nullif(s, F.lit("none")))


def _case(expr, mapping):
    return f"(CASE {expr} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in mapping.items()) + f" ELSE {expr} END)"


def _rules_sql():
    rows = []
    for f in ("gdpr", "hipaa", "ccpa"):
        for t in sorted(set(G.ALLOWED[f]) | set(G.MANDATORY[f])):
            al = G.ALLOWED[f].get(t)
            rows.append(f"({q(f)},{q(t)},{'[' + ','.join(map(q, al)) + ']' if al else 'NULL'},{t in G.MANDATORY[f]},{f == 'gdpr' and t in G.SPECIAL},{f == 'hipaa' and t in G.PROTECTED_HEALTH})")
    return "rules(framework, pii_type, allowed, mandatory, special, health) AS (VALUES " + ",".join(rows) + ")"


STRAT = strat_sql(CHOSEN.per_type, "mask")
_VIOL = f"""{DOC_DET}, {_rules_sql()}, seen AS (SELECT source, {_case('pii_type', G.TYPE_ALIAS)} AS pii_type, {_case(f"nullif({STRAT},'none')", G.STRATEGY_ALIAS)} AS strategy, count(*) AS n
    FROM det JOIN documents USING (doc_id) GROUP BY ALL),
  hit AS (SELECT *, strategy IS NOT NULL AND allowed IS NOT NULL AND NOT list_contains(allowed, strategy) AS wrong FROM seen JOIN rules USING (pii_type)),
  viol AS (
   SELECT source, framework, pii_type, strategy, 'GDPR_MANDATORY_ANON' AS code, 'critical' AS severity, 1::BIGINT AS violations FROM hit WHERE framework='gdpr' AND mandatory AND strategy IS NULL
   UNION ALL SELECT source, framework, pii_type, strategy, 'GDPR_SPECIAL_CATEGORY','high',1 FROM hit WHERE framework='gdpr' AND special AND wrong
   UNION ALL SELECT source, framework, pii_type, strategy, 'GDPR_STRATEGY_MISMATCH','medium',n FROM hit WHERE framework='gdpr' AND wrong
   UNION ALL SELECT source, framework, pii_type, strategy, 'HIPAA_SAFE_HARBOR_VIOLATION','critical',1 FROM hit WHERE framework='hipaa' AND mandatory AND strategy IS NULL
   UNION ALL SELECT source, framework, pii_type, strategy, 'HIPAA_STRATEGY_INSUFFICIENT','high',1 FROM hit WHERE framework='hipaa' AND mandatory AND wrong
   UNION ALL SELECT source, framework, pii_type, strategy, 'HIPAA_PHI_PROTECTION','critical',1 FROM hit WHERE framework='hipaa' AND health AND strategy NOT IN ('redact','hash')
   UNION ALL SELECT source, framework, pii_type, strategy, 'CCPA_PI_NOT_PROTECTED','high',1 FROM hit WHERE framework='ccpa' AND mandatory AND strategy IS NULL
   UNION ALL SELECT source, framework, pii_type, strategy, 'CCPA_STRATEGY_RECOMMENDATION','medium',n FROM hit WHERE framework='ccpa' AND wrong)"""
_VERD = _VIOL + f""", bad AS (SELECT source, framework, sum(violations)::BIGINT AS v, sum(CASE WHEN severity='critical' OR (framework='ccpa' AND severity='high') THEN violations ELSE 0 END) AS b FROM viol GROUP BY ALL),
  verd AS (SELECT s.source, f.framework, coalesce(v,0) AS violations, coalesce(b,0)=0 AS compliant FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest([{','.join(map(q, FRAMEWORKS))}]) AS framework) f LEFT JOIN bad ON bad.source=s.source AND bad.framework=f.framework)"""


@query("g01_check_compliance", _VIOL + " SELECT * FROM viol")
def _(spark, sf):
    return G.check_compliance(applied(spark, sf), ["source"], FRAMEWORKS)


def _verdicts(spark, sf):
    return G.verdicts(table(spark, sf, "documents"), G.check_compliance(applied(spark, sf), ["source"], FRAMEWORKS), ["source"], FRAMEWORKS)


@query("g01_verdicts", _VERD + " SELECT * FROM verd")
def _(spark, sf):
    return _verdicts(spark, sf)


@query("g02_recommend_strategy", f"""{DOC_DET}, {_rules_sql()}, fw(framework, f) AS (VALUES ('gdpr',0),('hipaa',1),('ccpa',2)),
   kinds AS (SELECT DISTINCT pii_type, {_case('pii_type', G.TYPE_ALIAS)} AS rt FROM det),
   cells AS (SELECT kinds.pii_type, f, coalesce(allowed,['redact']) AS allowed, coalesce(mandatory,false) AS mandatory FROM kinds CROSS JOIN fw LEFT JOIN rules ON rules.framework=fw.framework AND rules.pii_type=rt),
   votes AS (SELECT pii_type, f, unnest(allowed) AS strategy, unnest(range(len(allowed))) AS p FROM cells),
   tally AS (SELECT pii_type, strategy, count(*) AS n, min(f*100+p) AS first FROM votes GROUP BY ALL),
   best AS (SELECT pii_type, first(strategy ORDER BY n DESC, (strategy='redact') DESC, first) AS recommended FROM tally GROUP BY pii_type),
   must AS (SELECT pii_type, bool_or(mandatory) AS mandatory FROM cells GROUP BY pii_type)
   SELECT doc_id, start_pos, pii_type, recommended, mandatory FROM det JOIN best USING (pii_type) JOIN must USING (pii_type)""")
def _(spark, sf):
    return G.recommend_strategy(found(spark, sf).select("doc_id", "start_pos", "pii_type"), FRAMEWORKS)


@query("g04_compliance_score", f"""{DOC_DET}, r AS (SELECT documents.source, documents.doc_id, count(det.doc_id) AS d, coalesce(sum(confidence),0) AS c, count(det.doc_id) FILTER (confidence<0.9) AS low,
    (count(det.doc_id) FILTER ({STRAT} <> 'none') > 0)::INT AS rewritten FROM documents LEFT JOIN det USING (doc_id) GROUP BY ALL)
   SELECT source, round(CASE WHEN sum(d)=0 THEN 1.0 ELSE 0.6*sum(c)/sum(d)+0.4*sum(rewritten)/count(*) END,6)::DOUBLE AS score, sum(d)::BIGINT AS detections, sum(low)::BIGINT AS low_confidence_warnings FROM r GROUP BY source""")
def _(spark, sf):
    out = A.anonymize(docs(spark, sf).select("doc_id", "source", "text"), "text", CHOSEN)
    per = out.select(
        "source", F.size("annotations").alias("detections"),
        F.aggregate("annotations", F.lit(0.0), lambda a, x: a + x["confidence"]).alias("confidence_sum"),
        F.size(F.filter("annotations", lambda x: x["confidence"] < 0.9)).alias("low_confidence"),
        F.exists("annotations", lambda x: x["strategy"] != "none").cast("int").alias("rewritten"))
    return G.compliance_score(per, ["source"])


@query("g05_attestation", _VERD + " SELECT source, sha256(string_agg(framework||':'||compliant::VARCHAR||':'||violations::VARCHAR, chr(10) ORDER BY framework)) AS attestation, coalesce(string_agg(framework, ',' ORDER BY framework) FILTER (compliant),'') AS satisfied FROM verd GROUP BY source")
def _(spark, sf):
    return G.attestation(_verdicts(spark, sf), ["source"])


_POL = "('F', 700, 'delete', true, false, true), ('F', 2000, 'anonymise', false, false, true), ('O', 900, 'anonymise', false, false, true), ('P', 400, 'delete', false, true, true), ('O', 10, 'delete', false, false, false), ('*', 1200, 'archive', false, false, true)"


@query("g06_retention_plan", f"""WITH p(t, days, action, arch, hold, active) AS (VALUES {_POL}), a AS (SELECT * FROM p WHERE active),
   best AS (SELECT t, min(days) AS days, arg_min(action, days) AS action, arg_min(arch, days) AS arch, bool_or(hold) AS hold FROM a GROUP BY t),
   j AS (SELECT o_orderkey, o_orderstatus, o_orderdate, CASE WHEN e.t IS NULL OR d.days < e.days THEN d.days ELSE e.days END AS days, CASE WHEN e.t IS NULL OR d.days < e.days THEN d.action ELSE e.action END AS action,
     CASE WHEN e.t IS NULL OR d.days < e.days THEN d.arch ELSE e.arch END AS arch, coalesce(e.hold,false) OR d.hold AS hold
     FROM orders LEFT JOIN best e ON e.t = o_orderstatus CROSS JOIN (SELECT * FROM best WHERE t='*') d)
   SELECT o_orderkey, strftime(o_orderdate::DATE + days, '%Y-%m-%d') AS due, CASE WHEN o_orderdate::DATE + days >= DATE '2000-01-01' THEN 'keep' WHEN hold THEN 'hold' WHEN action='delete' AND arch THEN 'archive_then_delete' ELSE action END AS retention_action FROM j""")
def _(spark, sf):
    policies = spark.sql(f"SELECT * FROM VALUES {_POL} AS t(record_type, retain_days, action, archive_first, legal_hold, active)")
    out = G.retention_plan(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", policies, F.lit("2000-01-01").cast("timestamp"))
    return out.select("o_orderkey", F.date_format("due", "yyyy-MM-dd").alias("due"), "retention_action")


@query("g06_log_ageing", """SELECT event_type, count(*) AS expired FROM events WHERE ts < (CASE event_type WHEN 'error' THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-01-24 00:00:00' END) GROUP BY event_type""")
def _(spark, sf):
    e = table(spark, sf, "events")
    limits = {"error": "2024-01-30 00:00:00"}
    cut_at = F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    for kind, at in limits.items():
        cut_at = F.when(F.col("event_type") == kind, F.lit(at).cast("timestamp_ntz")).otherwise(cut_at)
    return e.filter(F.col("ts") < cut_at).groupBy("event_type").agg(F.count("*").alias("expired"))


def _subjects(hits):
    """One request per distinct address; its kind and dates follow from the address."""
    who = hits.filter("pii_type = 'email'").select(F.lower("value").alias("v")).distinct()
    return who.select(
        F.substring(F.sha2("v", 256), 1, 12).alias("request_id"), F.sha2("v", 256).alias("identity_hash"),
        F.when(F.length("v") % 2 == 0, "access").otherwise("erasure").alias("kind"),
        F.when(F.length("v") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-05-20")).cast("timestamp").alias("received_at"),
        F.when(F.length("v") % 5 == 0, F.lit("2024-05-25")).cast("timestamp").alias("completed_at"))


_SUBJ = f"""{DOC_DET}, sub AS (SELECT DISTINCT lower(value) AS v FROM det WHERE pii_type='email'),
   req AS (SELECT v, left(sha256(v),12) AS request_id, CASE WHEN length(v)%2=0 THEN 'access' ELSE 'erasure' END AS kind, CASE WHEN length(v)%3=0 THEN DATE '2024-01-01' ELSE DATE '2024-05-20' END AS rec, length(v)%5=0 AS done FROM sub),
   ext AS (SELECT request_id, kind, doc_id, count(*) AS hits, strftime(any_value(rec)+30,'%Y-%m-%d') AS due, CASE WHEN any_value(done) THEN 'completed' WHEN DATE '2024-06-01' > any_value(rec)+30 THEN 'overdue' ELSE 'open' END AS state
     FROM det JOIN req ON lower(value)=v GROUP BY request_id, kind, doc_id)"""


def _extract(spark, sf):
    hits = found(spark, sf)
    return G.subject_request(hits, "doc_id", _subjects(hits), F.lit("2024-06-01").cast("timestamp"))


@query("g07_subject_request", _SUBJ + " SELECT * FROM ext")
def _(spark, sf):
    return _extract(spark, sf).withColumn("due", F.date_format("due", "yyyy-MM-dd"))


@query("g07_erasure", _SUBJ + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ext WHERE kind='erasure')")
def _(spark, sf):
    return G.erase(table(spark, sf, "documents").select("doc_id"), "doc_id", _extract(spark, sf))


@query("g08_compliance_report", "SELECT coalesce(m,'*') AS month, coalesce(event_type,'*') AS event_type, count(*) AS n, round(sum(value),4) AS total FROM (SELECT strftime(ts,'%Y-%m') AS m, event_type, value FROM events) GROUP BY CUBE (m, event_type)")
def _(spark, sf):
    return G.usage_report(table(spark, sf, "events"), "ts", ["event_type"], "value")


@query("g08_usage_in_range", "SELECT coalesce(m,'*') AS month, coalesce(event_type,'*') AS event_type, count(*) AS n, round(sum(value),4) AS total FROM (SELECT strftime(ts,'%Y-%m') AS m, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00') GROUP BY CUBE (m, event_type)")
def _(spark, sf):
    return G.usage_report(table(spark, sf, "events"), "ts", ["event_type"], "value", "2024-01-05 00:00:00", "2024-01-20 12:00:00")


@query("g08_framework_report", f"""WITH v AS (SELECT ({FRAMEWORKS!r})[user_id%5+1] AS framework, (props->>'$.k')::BIGINT%4 AS violations FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00')
   SELECT framework, count(*) AS verdicts, count(*) FILTER (violations=0) AS compliant, round(count(*) FILTER (violations=0)/count(*)::DOUBLE,6) AS share, sum(violations)::BIGINT AS violations FROM v GROUP BY framework""")
def _(spark, sf):
    e = table(spark, sf, "events")
    framework = F.element_at(F.array(*[F.lit(f) for f in FRAMEWORKS]), (F.col("user_id") % 5 + 1).cast("int"))
    n = F.get_json_object("props", "$.k").cast("bigint") % 4
    return G.framework_report(e.select("ts", framework.alias("framework"), n.alias("violations"), (n == 0).alias("compliant")), "ts", "2024-01-05 00:00:00")


@query("g08_lineage_report", """WITH e AS (SELECT l_returnflag AS kind, 'p'||l_partkey AS parent, 'o'||l_orderkey AS child FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1996-01-01'),
   n AS (SELECT kind, node, sum(o) AS o, sum(i) AS i FROM (SELECT kind, parent AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT kind, child, 0, 1 FROM e) GROUP BY kind, node)
   SELECT kind, any_value(c) AS edges, count(*) AS nodes, count(*) FILTER (i=0) AS sources, count(*) FILTER (o=0) AS sinks, max(o)::BIGINT AS most_out, max(i)::BIGINT AS most_in FROM n JOIN (SELECT kind, count(*) AS c FROM e GROUP BY kind) USING (kind) GROUP BY kind""")
def _(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("kind"), "l_shipdate", F.concat(F.lit("p"), "l_partkey").alias("parent"), F.concat(F.lit("o"), "l_orderkey").alias("child"))
    return G.lineage_report(edges, "l_shipdate", "kind", "1994-01-01", "1996-01-01")


@query("g06_aged_log", "SELECT event_id FROM events WHERE NOT (event_type='error' AND ts < TIMESTAMP '2024-01-30 00:00:00') AND NOT (event_type='click' AND ts < TIMESTAMP '2024-01-24 00:00:00')")
def _(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return G.age_log(table(spark, sf, "events"), "ts", now, {"error": 2, "click": 8}, "event_type").select("event_id")
