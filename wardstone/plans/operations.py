"""Access, audit, event and streaming queries, with events as requests, attempts and logs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import conditions as C, text as T
from ..operators import access as X, audit as U, compliance as G, detect as D, events as E, throttle
from ..session import cut, spread, table, workspace
from ..streaming import jobs as ST
from .anonymization import DEFAULT_SQL_TEXT, hmac_sql
from .detection import docs
from .pii_sql import CANON, DOC_DET, q
from .registry import query
from .tables import _any_sql

Condition, Rules = C.Condition, C.Rules
ACTION = {"click": "read", "view": "list", "error": "delete", "signup": "create"}
TYPES = ["dataset", "record", "audit_log", "system"]
REQ = f"""req AS (SELECT event_id, ts, value, 'u'||user_id AS user_id, user_id AS uid, {'CASE event_type ' + ' '.join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ACTION.items()) + " ELSE 'update' END"} AS action,
   (['dataset','record','audit_log','system'])[user_id%4+1] AS resource_type, CASE WHEN k<10 THEN 'protected-'||k ELSE 'ds-'||k END AS resource_id, k, 't'||(user_id%5) AS tenant, k%9=0 AS public,
   CASE WHEN user_id%30=0 THEN 'role:admin' ELSE 'user:u'||user_id END AS principal FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
  rq AS (SELECT *, resource_type||':'||resource_id AS resource FROM req)"""


def events(spark, sf):
    return table(spark, sf, "events")


def requests(spark, sf):
    e = events(spark, sf)
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")
    action = F.lit("update")
    for a, b in ACTION.items():
        action = F.when(F.col("event_type") == a, b).otherwise(action)
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (u % 4 + 1).cast("int"))
    rid = F.concat(F.when(k < 10, "protected-").otherwise("ds-"), k.cast("string"))
    name = F.concat(F.lit("u"), u.cast("string"))
    return e.select(
        "event_id", "ts", "value", u.alias("uid"), name.alias("user_id"), action.alias("action"), kind.alias("resource_type"), rid.alias("resource_id"),
        k.alias("k"), F.concat(F.lit("t"), (u % 5).cast("string")).alias("tenant"), (k % 9 == 0).alias("public"),
        F.when(u % 30 == 0, "role:admin").otherwise(F.concat(F.lit("user:"), name)).alias("principal"), F.concat_ws(":", kind, rid).alias("resource"))


def user_roles(spark, sf):
    u = events(spark, sf).select("user_id").distinct()
    role = F.element_at(F.array(*[F.lit(r) for r in ("analyst-child", "data-admin", "auditor", "user-admin", None, "lead")]), (F.col("user_id") % 6 + 1).cast("int"))
    return u.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), role.alias("role")).filter("role IS NOT NULL")


def role_parents(spark):
    return spark.createDataFrame([("analyst-child", "data-analyst"), ("lead", "analyst-child"), ("lead", "auditor")], "role string, parent string")


_EFF = """er AS (SELECT DISTINCT 'u'||user_id AS user_id, r.role FROM events, (VALUES (0,'analyst-child'),(0,'data-analyst'),(1,'data-admin'),(2,'auditor'),(3,'user-admin'),(5,'lead'),(5,'analyst-child'),(5,'data-analyst'),(5,'auditor')) r(m, role) WHERE user_id%6=m)"""
_RBAC = """(CASE uid%6 WHEN 0 THEN (resource_type IN ('dataset','record') AND action IN ('read','list')) OR (resource_type='dataset' AND action='delete' AND starts_with(resource_id,'ds-1'))
   WHEN 1 THEN resource_type IN ('dataset','record') WHEN 2 THEN resource_type IN ('audit_log','dataset','record') AND action IN ('read','list') WHEN 3 THEN false WHEN 4 THEN false
   ELSE (resource_type IN ('audit_log','dataset','record') AND action IN ('read','list')) OR (resource_type='dataset' AND action='delete' AND starts_with(resource_id,'ds-1')) END)"""


@query("x01_effective_roles", f"WITH {_EFF} SELECT * FROM er")
def _(spark, sf):
    return X.effective_roles(user_roles(spark, sf), role_parents(spark))


def rbac(spark, sf):
    special = spark.createDataFrame([("special", "dataset", "delete", "ds-1*")], "permission string, resource_type string, action string, filter string")
    perms = X.builtin_permissions(spark).unionByName(special)
    grants = X.builtin_roles(spark).unionByName(spark.createDataFrame([("analyst-child", "special")], "role string, permission string"))
    return X.rbac_check(requests(spark, sf), X.effective_roles(user_roles(spark, sf), role_parents(spark)), grants, perms)


@query("x02_rbac_check", f"WITH {REQ} SELECT event_id, {_RBAC} AS rbac_allowed FROM rq")
def _(spark, sf):
    return rbac(spark, sf).select("event_id", "rbac_allowed")


POLICIES = [
    X.AccessPolicy("readers", (X.Statement("allow", ("user:*",), ("read", "list"), ("dataset:*",)),), 10),
    X.AccessPolicy("protect", (X.Statement("deny", (), ("delete", "update"), ("*:protected-?",)),), 5),
    X.AccessPolicy("tenants", (X.Statement("deny", (), ("create",), (), (Condition("tenant", "eq", "t3"),)),
                               X.Statement("allow", ("user:u1*",), (), ("record:*",), (Condition("value", "gt", 10), Condition("ts", "after", "2024-01-10 00:00:00")))), 20),
    X.AccessPolicy("off", (X.Statement("deny"),), 99, enabled=False),
]
_POL = """pol AS (SELECT *, CASE WHEN starts_with(principal,'user:') AND action IN ('read','list') AND starts_with(resource,'dataset:') THEN 'allow' END AS e1,
   CASE WHEN action IN ('delete','update') AND regexp_matches(resource,'^.*:protected-.$') THEN 'deny' END AS e2,
   CASE WHEN action='create' AND tenant='t3' THEN 'deny' WHEN starts_with(principal,'user:u1') AND starts_with(resource,'record:') AND value>10 AND ts > TIMESTAMP '2024-01-10' THEN 'allow' END AS e3 FROM rq),
  pd AS (SELECT *, CASE WHEN e3='deny' THEN 'tenants' WHEN e2='deny' THEN 'protect' END AS dp, CASE WHEN e3='allow' THEN 'tenants' WHEN e1='allow' THEN 'readers' END AS ap FROM pol)"""


@query("x03_policy_check", f"WITH {REQ}, {_POL} SELECT event_id, CASE WHEN dp IS NOT NULL THEN 'deny' WHEN ap IS NOT NULL THEN 'allow' END AS effect, coalesce(dp, ap) AS policy FROM pd")
def _(spark, sf):
    r = requests(spark, sf)
    return r.select("event_id", X.policy_check(F.col("principal"), F.col("action"), F.col("resource"), POLICIES).alias("d")).select("event_id", "d.effect", "d.policy")


ABAC = [
    X.AbacPolicy("burst", "deny", 100, environment=Condition("value", "gt", 60)),
    X.AbacPolicy("tenant_read", "allow", 50, "dataset", ("read",), subject=Condition("tenant", "in", ["t0", "t1"])),
    X.AbacPolicy("low_ids", "allow", 10, actions=("list",), resource=Rules(all=(Condition("resource_id", "matches", "^ds-[0-4]"),), none_of=(Condition("k", "eq", 42),))),
]
_AB = """CASE WHEN value>60 THEN 'deny' WHEN resource_type='dataset' AND action='read' AND tenant IN ('t0','t1') THEN 'allow' WHEN action='list' AND regexp_matches(resource_id,'^ds-[0-4]') AND k<>42 THEN 'allow' ELSE 'deny' END"""
_ABP = """CASE WHEN value>60 THEN 'burst' WHEN resource_type='dataset' AND action='read' AND tenant IN ('t0','t1') THEN 'tenant_read' WHEN action='list' AND regexp_matches(resource_id,'^ds-[0-4]') AND k<>42 THEN 'low_ids' END"""


@query("x04_abac_check", f"WITH {REQ} SELECT event_id, {_AB} AS effect, {_ABP} AS policy FROM rq")
def _(spark, sf):
    r = requests(spark, sf)
    return r.select("event_id", X.abac_check(F.col("resource_type"), F.col("action"), ABAC).alias("d")).select("event_id", "d.effect", "d.policy")


_AUTH = f"""WITH {REQ}, {_POL}, au AS (SELECT *, {_RBAC} AS rb, {_AB} AS ab, {_ABP} AS abp FROM pd), dec AS (SELECT *, CASE WHEN user_id='u1' THEN 'system' WHEN user_id='u2' THEN 'default' WHEN dp IS NOT NULL THEN 'policy' WHEN rb THEN 'rbac' WHEN ab='allow' THEN 'abac' WHEN ap IS NOT NULL THEN 'policy' ELSE 'default' END AS source,
   CASE WHEN user_id='u1' THEN true WHEN user_id='u2' THEN public AND action='read' WHEN dp IS NOT NULL THEN false WHEN rb OR ab='allow' OR ap IS NOT NULL THEN true ELSE false END AS allowed,
   CASE WHEN user_id='u1' THEN 'system' WHEN user_id='u2' THEN (CASE WHEN public AND action='read' THEN 'public read' ELSE 'anonymous access denied' END) WHEN dp IS NOT NULL THEN 'denied by '||dp WHEN rb THEN 'role permission' WHEN ab='allow' THEN abp WHEN ap IS NOT NULL THEN 'allowed by '||ap ELSE 'no matching permission' END AS reason FROM au)"""


def decisions(spark, sf):
    return X.authorize(rbac(spark, sf), POLICIES, ABAC, ["u1"], ["u2"])


@query("x05_authorize", _AUTH + " SELECT event_id, allowed, source, reason FROM dec")
def _(spark, sf):
    return decisions(spark, sf).select("event_id", "allowed", "source", "reason")


RULES = [
    X.WeightedRule("w1", "allow", ("read", "list"), 100, roles=("auditor", "data-admin"), resource_types=("dataset", "record"), conditions=(Condition("value", "lt", 50),)),
    X.WeightedRule("w2", "allow", ("admin",), 40, roles=("lead",), resource_ids=("ds-*",), conditions=(Condition("k", "gt", 5), Condition("tenant", "ne", "t4"))),
    X.WeightedRule("w3", "deny", ("delete",), 200, resource_ids=("protected-*",), conditions=(Condition("k", "lt", 3),)),
]


def weighted_requests(spark, sf):
    u, k = F.col("uid"), F.col("k")
    roles = F.array_compact(F.array(F.when(u % 3 == 0, "auditor"), F.when(u % 4 == 0, "data-admin"), F.when(u % 5 == 0, "lead"), F.lit("member")))
    return requests(spark, sf).select(
        "*", roles.alias("roles"), F.when(k % 11 != 0, "contract").alias("legal_basis"), F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("research"))).alias("allowed_purposes"),
        F.when(k % 5 == 0, "restricted").otherwise("internal").alias("classification"), F.when(k % 10 == 0, F.lit(True)).alias("hipaa_authorization"),
        (k % 13 == 0).alias("ccpa_opted_out"), (u % 2 == 0).alias("is_sale"), (k % 17 == 0).alias("pending_deletion"))


_W = f"""w AS (SELECT *, uid%3=0 AS aud, uid%4=0 AS dadm, uid%5=0 AS lead FROM rq),
  rg AS (SELECT *, (k%11=0)::INT + (k%7=0)::INT + (NOT aud)::INT + (k%5=0 AND k%10<>0)::INT + (k%13=0 AND uid%2=0)::INT + (k%17=0)::INT AS nv, ((k%11=0) OR (NOT aud) OR (k%5=0 AND k%10<>0) OR (k%13=0 AND uid%2=0) OR (k%17=0)) AS dn,
    action IN ('read','list') AND (aud OR dadm) AND resource_type IN ('dataset','record') AS r1, lead AND starts_with(resource_id,'ds-') AS r2, action='delete' AND starts_with(resource_id,'protected-') AS r3,
    action IN ('read','list') AND value<50 AS a1, k>5 AND tenant<>'t4' AS a2, action='delete' AND k<3 AS a3 FROM w),
  sc AS (SELECT *, NOT r3 AND (r1 OR r2) AS ra, NOT a3 AND (a1 OR a2) AS aa, r1 OR r2 OR r3 AS rm, a1 OR a2 OR a3 AS am,
    CASE WHEN r3 THEN 1.0 WHEN NOT (r1 OR r2) THEN 0.5 ELSE greatest(CASE WHEN r1 THEN 0.7+0.1+least(0.1,(aud::INT+dadm::INT)*0.05) ELSE 0 END, CASE WHEN r2 THEN 0.7+0.04+0.05 ELSE 0 END) END AS rc,
    CASE WHEN a3 THEN 1.0 WHEN NOT (a1 OR a2) THEN 0.5 ELSE greatest(CASE WHEN a1 THEN 0.7 ELSE 0 END, CASE WHEN a2 THEN 0.8 ELSE 0 END) END AS ac, greatest(0.5, 1-nv*0.1) AS gc FROM rg)"""


@query("x06_evaluate_weighted", f"""WITH {REQ}, {_W} SELECT event_id, CASE WHEN NOT dn AND ra AND aa THEN 'allow' ELSE 'deny' END AS decision, round(CASE WHEN dn THEN gc ELSE rc*0.4+ac*0.4+gc*0.2 END,6)::DOUBLE AS confidence,
   CASE WHEN dn THEN 'regulatory' WHEN NOT ra AND NOT aa THEN 'combined' WHEN NOT ra THEN 'rbac' WHEN NOT aa THEN 'abac' WHEN rm AND am THEN 'combined' WHEN rm THEN 'rbac' WHEN am THEN 'abac' ELSE 'default' END AS decision_source FROM sc""")
def _(spark, sf):
    return X.evaluate_weighted(weighted_requests(spark, sf), RULES).select("event_id", "decision", "confidence", "decision_source")


@query("x07_regulatory_check", f"""WITH {REQ}, v AS (SELECT event_id,'GDPR' AS framework,'gdpr-legal-basis' AS requirement,'deny' AS severity FROM rq WHERE k%11=0 UNION ALL SELECT event_id,'GDPR','gdpr-purpose-limitation','warn' FROM rq WHERE k%7=0
   UNION ALL SELECT event_id,'HIPAA','hipaa-minimum-necessary','deny' FROM rq WHERE uid%3<>0 UNION ALL SELECT event_id,'HIPAA','hipaa-authorization','deny' FROM rq WHERE k%5=0 AND k%10<>0
   UNION ALL SELECT event_id,'CCPA','ccpa-opt-out','deny' FROM rq WHERE k%13=0 AND uid%2=0 UNION ALL SELECT event_id,'CCPA','ccpa-consumer-rights','deny' FROM rq WHERE k%17=0) SELECT * FROM v""")
def _(spark, sf):
    return weighted_requests(spark, sf).select("event_id", F.explode(X.regulatory_check(F.col("roles"))).alias("v")).select("event_id", "v.*")


@query("x08_row_filter", "SELECT o_orderkey, o_totalprice, o_nation FROM (SELECT o_orderkey, o_totalprice, c_nationkey AS o_nation FROM orders JOIN customer ON c_custkey=o_custkey) WHERE o_nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey=2)")
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_totalprice", "c_name", F.col("c_nationkey").alias("o_nation"))
    grants = table(spark, sf, "nation").select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("user_id"), F.col("n_nationkey").alias("scope"))
    return X.row_filter(rows, "o_nation", grants, "region-2", ["c_name"])


_PLANS = [("free", 5, 3000, 10), ("starter", 25, 20000, 70), ("enterprise", None, None, None)]


@query("x09_quota_check", """WITH u AS (SELECT user_id AS tenant, (['free','starter','enterprise'])[user_id%3+1] AS plan, count(DISTINCT event_type) AS datasets, sum(length(props)*10)::BIGINT AS bytes, count(*) AS calls FROM events GROUP BY ALL),
   p(plan,d,b,c) AS (VALUES ('free',5,3000,10),('starter',25,20000,70),('enterprise',NULL,NULL,NULL)), o AS (SELECT u.*, coalesce(datasets>=d,false) AS over_datasets, coalesce(bytes>=b,false) AS over_bytes, coalesce(calls>=c,false) AS over_calls FROM u JOIN p USING (plan))
   SELECT *, over_datasets OR over_bytes OR over_calls AS over_quota FROM o""")
def _(spark, sf):
    e = events(spark, sf)
    plan = F.element_at(F.array(*[F.lit(p[0]) for p in _PLANS]), (F.col("user_id") % 3 + 1).cast("int"))
    usage = e.groupBy(F.col("user_id").alias("tenant"), plan.alias("plan")).agg(F.count_distinct("event_type").alias("datasets"), F.sum(F.length("props") * 10).alias("bytes"), F.count("*").alias("calls"))
    return X.quota_check(usage, spark.createDataFrame(_PLANS, "plan string, max_datasets bigint, max_bytes bigint, max_calls bigint"))


_GR = """g AS (SELECT DISTINCT user_id, CASE WHEN k%20=0 THEN '*' ELSE 'r'||(k%6) END AS resource, CASE WHEN k%15=0 THEN '*' ELSE event_type END AS action, CASE WHEN k%4=0 THEN NULL WHEN k%9=1 THEN '*' ELSE 's'||(k%3) END AS scope FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)), n AS (SELECT DISTINCT user_id, resource, action, coalesce(scope,'*') AS scope FROM g)"""


@query("x10_redundant_grants", f"WITH {_GR} SELECT DISTINCT a.user_id, a.resource, a.action, a.scope FROM n a JOIN n b ON a.user_id=b.user_id AND (b.resource='*' OR b.resource=a.resource) AND (b.action='*' OR b.action=a.action) AND (b.scope='*' OR b.scope=a.scope) AND NOT (a.resource=b.resource AND a.action=b.action AND a.scope=b.scope)")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    g = events(spark, sf).select(
        "user_id", F.when(k % 20 == 0, "*").otherwise(F.concat(F.lit("r"), (k % 6).cast("string"))).alias("resource"), F.when(k % 15 == 0, "*").otherwise(F.col("event_type")).alias("action"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 9 == 1, "*").otherwise(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("scope"))
    return X.redundant_grants(g)


# ------------------------------------------------------------------------------ audit
FIELDS = ["ts_us", "event_type", "category", "severity", "action", "outcome", "actor", "target"]
_LOG = """lg AS (SELECT event_id, user_id, ts, epoch_us(ts) AS ts_us, event_type, 'access' AS category, CASE WHEN event_type='error' THEN 'high' ELSE 'low' END AS severity, event_type AS action, CASE WHEN event_type='error' THEN 'denied' ELSE 'ok' END AS outcome, 'u'||user_id AS actor, props AS target,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"""
_BODY = "event_id::VARCHAR||sequence::VARCHAR||ts_us::VARCHAR||event_type||category||severity||action||outcome||actor||target"


def audit_log(spark, sf):
    err = F.col("event_type") == "error"
    return events(spark, sf).select(
        "event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", F.lit("access").alias("category"), F.when(err, "high").otherwise("low").alias("severity"),
        F.col("event_type").alias("action"), F.when(err, "denied").otherwise("ok").alias("outcome"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("props").alias("target"))


def chain(spark, sf):
    return U.build_chain(audit_log(spark, sf), "user_id", ["ts", "event_id"], None, "event_id", FIELDS, segment_rows=50)


def forged_chain(spark, sf):
    """The chains as someone would rebuild them around a changed first entry."""
    first = F.min(F.struct("ts", "event_id")).over(W.partitionBy("user_id"))
    log = audit_log(spark, sf).withColumn("target", F.when(F.struct("ts", "event_id") == first, "forged").otherwise(F.col("target")))
    return U.build_chain(log, "user_id", ["ts", "event_id"], None, "event_id", FIELDS, segment_rows=50)


_CHAIN = f"""WITH RECURSIVE {_LOG}, b AS (SELECT user_id, event_id, sequence, {_BODY} AS body FROM lg), c AS (SELECT user_id, event_id, sequence, NULL::VARCHAR AS previous_hash, sha256(body) AS entry_hash FROM b WHERE sequence%50=1
   UNION ALL SELECT b.user_id, b.event_id, b.sequence, c.entry_hash, sha256(b.body||c.entry_hash) FROM c JOIN b ON b.user_id=c.user_id AND b.sequence=c.sequence+1 WHERE c.sequence%50<>0)"""


@query("u01_build_chain", _CHAIN + " SELECT user_id, event_id, sequence, previous_hash, entry_hash FROM c")
def _(spark, sf):
    return chain(spark, sf).select("user_id", "event_id", "sequence", "previous_hash", "entry_hash")


@query("u01_seal_segments", _CHAIN + ", s AS (SELECT user_id, (sequence-1)//50 AS seg, arg_max(entry_hash, sequence) AS h, count(*) AS n FROM c GROUP BY ALL) SELECT user_id, sha256(string_agg(h,'' ORDER BY seg)) AS root, sum(n)::BIGINT AS entries FROM s GROUP BY user_id")
def _(spark, sf):
    return U.seal_segments(chain(spark, sf), "user_id")


@query("u02_verify_chain", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, bad IS NULL AS valid, coalesce(bad-1, n)::BIGINT AS verified, bad::BIGINT AS first_bad, why AS reason FROM (SELECT user_id, n,
   CASE WHEN user_id%7=1 AND n>=9 THEN 9 WHEN user_id%7=2 AND n>=5 THEN 5 WHEN user_id%7=3 AND n>=12 THEN 12 WHEN user_id%7=4 THEN 1 WHEN user_id%7=5 THEN (n-1)//50*50+1 WHEN user_id%7=6 THEN 1 END AS bad,
   CASE WHEN user_id%7=1 AND n>=9 THEN 'hash mismatch' WHEN user_id%7=2 AND n>=5 THEN 'sequence gap' WHEN user_id%7=3 AND n>=12 THEN 'hash mismatch' WHEN user_id%7=4 THEN 'segment forged'
     WHEN user_id%7=5 THEN CASE WHEN n%50=1 THEN 'segment missing' ELSE 'segment forged' END WHEN user_id%7=6 THEN 'seals forged' END AS why FROM n)""")
def _(spark, sf):
    m, s = F.col("user_id") % 7, F.col("sequence")
    c = cut(chain(spark, sf))  # the test data is made once
    changed = c.withColumn("target", F.when((m == 1) & (s == 9), "forged").otherwise(F.col("target")))
    # entry 4 removed: the chain stops at 5; entry 11's stored hash replaced: 12 no longer fits
    removed = changed.filter(~((m == 2) & (s == 4))).withColumn("sequence", s)
    linked = removed.withColumn("previous_hash", F.when((m == 3) & (s == 12), "0" * 64).otherwise(F.col("previous_hash")))
    # a whole chain rebuilt around a changed entry (4: its seals are not; 6: its seals too), and
    # the last entry cut off (5)
    built = cut(forged_chain(spark, sf).filter(m.isin(4, 6)))
    count = F.count("*").over(W.partitionBy("user_id"))  # of a test chain; their lengths are small
    short = linked.filter(~m.isin(4, 6)).withColumn("__n", count).filter(~((m == 5) & (s == F.col("__n")))).drop("__n")
    entries = short.unionByName(built.select(*short.columns))
    seals = U.segment_seals(c, "user_id")
    kept = seals.filter(m != 6).unionByName(U.segment_seals(built.filter(m == 6), "user_id"))
    return U.verify_chain(entries, "user_id", "event_id", FIELDS, kept, U.seal_root(seals, "user_id"), segment_rows=50)


@query("u03_redact_audit", "SELECT event_id, '[REDACTED]' AS k, left(repeat(event_type,30),100)||(CASE WHEN length(repeat(event_type,30))>100 THEN '...' ELSE '' END) AS agent FROM events")
def _(spark, sf):
    ctx = F.from_json("props", "map<string,string>")
    return events(spark, sf).select("event_id", U.redact_context(ctx, ["k", "token"])["k"].alias("k"), U.cut_agent(F.repeat("event_type", F.lit(30))).alias("agent"))


@query("u04_audit_summary", """SELECT coalesce(user_id::VARCHAR,'*') AS user_id, coalesce(operation,'*') AS operation, coalesce(hour,'*') AS hour, count(*) AS total, count(*) FILTER (op IN ('view','click')) AS reads, count(*) FILTER (op IN ('signup','purchase')) AS writes, count(*) FILTER (op='error') AS denied
   FROM (SELECT user_id, event_type AS operation, event_type AS op, strftime(date_trunc('hour',ts),'%Y-%m-%d %H') AS hour FROM events) GROUP BY GROUPING SETS ((user_id),(operation),(hour),())""")
def _(spark, sf):
    log = events(spark, sf).select("ts", "user_id", F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "denied").otherwise("ok").alias("outcome"))
    return U.audit_summary(log, "ts", ["user_id", "operation"], ["view", "click"], ["signup", "purchase"])


@query("u05_lookups", "SELECT event_id, 'denied' AS lookup FROM (SELECT * FROM events WHERE event_type='error' ORDER BY ts DESC, event_id DESC LIMIT 50) UNION ALL SELECT event_id, 'user' FROM events WHERE user_id=11 UNION ALL SELECT event_id, 'resource' FROM events WHERE props='{\"k\": 5}'")
def _(spark, sf):
    from ..operators.records import audit_query, where_set

    e = events(spark, sf)
    denied = audit_query(e, {"event_type": "error"}, "ts", None, None, [F.desc("ts"), F.desc("event_id")], 50)
    parts = [(denied, "denied"), (where_set(e, {"user_id": 11}), "user"), (where_set(e, {"props": '{"k": 5}'}), "resource")]
    out = None
    for df, name in parts:
        p = df.select("event_id", F.lit(name).alias("lookup"))
        out = p if out is None else out.unionByName(p)
    return out


GOV = ["dataset_created", "record_accessed", "permission_denied", "key_rotated", "pii_detected", "merge_completed", "webhook_created", "system_started", "something_else"]
_GOV = "gv AS (SELECT event_id, user_id, ts, ([" + ",".join(map(q, GOV)) + "])[event_id%9+1] AS event_type FROM events)"
_CAT = "CASE " + " ".join(f"WHEN event_type IN ({','.join(map(q, v))}) THEN {q(k)}" for k, v in U.CATEGORY_OF_EVENT.items()) + " ELSE 'custom' END"


def gov_events(spark, sf):
    return as_governance(events(spark, sf))


def as_governance(df):
    return df.select("event_id", "user_id", "ts", F.element_at(F.array(*[F.lit(g) for g in GOV]), (F.col("event_id") % 9 + 1).cast("int")).alias("event_type"),
                                    F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant"))


@query("u06_categorise_events", f"WITH {_GOV} SELECT event_id, {_CAT} AS category, event_type IN ({','.join(map(q, U.MUST_AUDIT))}) AS must_audit FROM gv")
def _(spark, sf):
    return gov_events(spark, sf).select("event_id", U.category_of(F.col("event_type")).alias("category"), U.must_audit(F.col("event_type")).alias("must_audit"))


@query("u07_access_rollup", "SELECT user_id, count(DISTINCT props) AS records, count(*) AS accesses, round(sum(value),4) AS bytes FROM events GROUP BY user_id")
def _(spark, sf):
    return U.access_rollup(events(spark, sf), "user_id", "props", "value")


@query("u08_audit_from_decisions", _AUTH + " SELECT event_id, user_id, action, resource, CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS decision, reason, source AS decision_source FROM dec")
def _(spark, sf):
    return U.audit_from_decisions(decisions(spark, sf)).drop("event_type", "resource_type")


# ------------------------------------------------------------------------------ events
_SUBS = [("all", None, None, None, None, True), ("security", None, ["security", "access"], None, None, True), ("merges_t1", ["merge_completed", "dataset_created"], None, "t1", None, True),
         ("user7", None, None, None, 7, True), ("mixed", ["pii_detected", "key_rotated"], ["security"], None, None, True), ("off", None, None, None, None, False)]


@query("e01_route_events", f"""WITH {_GOV}, c AS (SELECT *, {_CAT} AS cat, 't'||(user_id%5) AS tenant FROM gv) SELECT 'all' AS subscription, event_id FROM c UNION ALL SELECT 'security', event_id FROM c WHERE cat IN ('security','access')
   UNION ALL SELECT 'merges_t1', event_id FROM c WHERE event_type IN ('merge_completed','dataset_created') AND tenant='t1' UNION ALL SELECT 'user7', event_id FROM c WHERE user_id=7 UNION ALL SELECT 'mixed', event_id FROM c WHERE event_type IN ('pii_detected','key_rotated') AND cat='security'""")
def _(spark, sf):
    subs = spark.createDataFrame(_SUBS, "subscription string, event_types array<string>, categories array<string>, tenant string, user_id bigint, active boolean")
    return E.route_events(gov_events(spark, sf), subs)


_CHOSEN = {"even_day": "day(ts) % 2 = 0", "odd_event": Rules(all=(Condition("event_id", "ge", 10), Condition("odd", "eq", True)))}


@query("e01_route_filters", f"""WITH {_GOV}, c AS (SELECT *, {_CAT} AS cat, 't'||(user_id%5) AS tenant, 'd'||(event_id%7) AS dataset FROM gv)
   SELECT 'user'||user_id AS subscription, event_id FROM c WHERE user_id%3=0 OR (user_id%3=1 AND day(ts)%2=0) UNION ALL
   SELECT 'd'||(event_id%7)||'-merges', event_id FROM c WHERE event_type='merge_completed' AND event_id%7<6 UNION ALL
   SELECT 'odd', event_id FROM c WHERE cat='security' AND tenant='t2' AND event_id>=10 AND event_id%2=1""")
def _(spark, sf):
    e = gov_events(spark, sf).withColumn("dataset", F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string"))).withColumn("odd", F.col("event_id") % 2 == 1)
    schema = "subscription string, event_types array<string>, categories array<string>, tenant string, dataset string, user_id bigint, expression string, active boolean"
    fixed = [(f"d{k}-merges", ["merge_completed"], None, None, f"d{k}", None, None, k < 6) for k in range(7)]
    fixed += [("odd", None, ["security"], "t2", None, None, "odd_event", True), ("lost", None, None, None, None, None, "no such rule", True)]
    u = events(spark, sf).select("user_id").distinct()
    # a subscription of every user
    own = u.select(F.concat(F.lit("user"), "user_id").alias("subscription"), F.lit(None).cast("array<string>").alias("event_types"), F.lit(None).cast("array<string>").alias("categories"),
                   F.lit(None).cast("string").alias("tenant"), F.lit(None).cast("string").alias("dataset"), "user_id",
                   F.when(F.col("user_id") % 3 == 1, "even_day").alias("expression"), (F.col("user_id") % 3 < 2).alias("active"))
    return E.route_events(e, spark.createDataFrame(fixed, schema).unionByName(own), expressions=_CHOSEN)


@query("g08_access_report", f"""WITH {REQ}, a AS (SELECT *, principal='role:admin' OR action<>'delete' AS ok FROM rq WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00')
   SELECT user_id, resource_type, count(*) AS requests, count(*) FILTER (ok AND action IN ('read','list')) AS reads, count(*) FILTER (ok AND action NOT IN ('read','list')) AS writes, count(*) FILTER (NOT ok) AS denied,
     count(DISTINCT resource) AS resources, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_at FROM a GROUP BY user_id, resource_type""")
def _(spark, sf):
    ok = (F.col("principal") == "role:admin") | (F.col("action") != "delete")
    out = G.access_report(requests(spark, sf), "ts", "user_id", "resource_type", "resource", ok, ["read", "list"], "2024-01-03 00:00:00", "2024-01-25 00:00:00")
    return out.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("g08_security_report", f"""WITH {_GOV}, c AS (SELECT *, {_CAT} AS cat FROM gv WHERE ts < TIMESTAMP '2024-01-28 00:00:00'),
   p AS (SELECT ts::DATE AS day, user_id, count(*) AS n, count(*) FILTER (cat IN ('security','access')) AS w, count(*) FILTER (cat IN ('security','access') AND event_type='permission_denied') AS f FROM c GROUP BY ALL)
   SELECT strftime(day,'%Y-%m-%d') AS day, sum(n)::BIGINT AS events, sum(w)::BIGINT AS watched, sum(f)::BIGINT AS failures, count(*) FILTER (f>0) AS failing_actors, max(f) AS most_by_one FROM p GROUP BY day""")
def _(spark, sf):
    kind = F.col("event_type")
    out = G.security_report(gov_events(spark, sf), "ts", U.category_of(kind), "user_id", kind == "permission_denied", end="2024-01-28 00:00:00")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("e02_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return E.event_counts(events(spark, sf))


_HOURS = "SELECT strftime(date_trunc('hour',ts),'%Y-%m-%d %H') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def hour(c="window_start"):
    return F.date_format(c, "yyyy-MM-dd HH").alias(c)


@query("e02_event_counts_windowed", _HOURS)
def _(spark, sf):
    return E.event_counts(events(spark, sf), "ts").select(hour(), "event_type", "n")


@query("e03_recent_events", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 25")
def _(spark, sf):
    return E.recent_by_type(events(spark, sf), ["ts", "event_id"], None, 25).select("event_id", "event_type", "rank")


@query("e03_recent_overall", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, sf):
    return E.recent_events(events(spark, sf), ["ts", "event_id"], 100).select("event_id")


@query("e04_batch_events", "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)-1)//100 AS batch FROM events")
def _(spark, sf):
    return E.batch_events(events(spark, sf), ["ts", "event_id"], None, 100).select("event_id", "event_type", "batch")


def ok():
    """Delivered unless the event is an error."""
    return F.col("event_type") != "error"


@query("e05_delivery_stats", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type<>'error') AS delivered, count(*) FILTER (event_type='error') AS failed, round(count(*) FILTER (event_type<>'error')/count(*),6) AS success_rate,
   strftime(max(ts) FILTER (event_type<>'error'),'%Y-%m-%d %H:%M:%S') AS last_success, strftime(max(ts) FILTER (event_type='error'),'%Y-%m-%d %H:%M:%S') AS last_failure FROM events GROUP BY user_id""")
def _(spark, sf):
    out = E.delivery_stats(events(spark, sf), "user_id", ok(), "ts")
    for c in ("last_success", "last_failure"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query("e06_auto_disable", """WITH a AS (SELECT event_id, user_id, event_type, ts, sum((event_type<>'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
   b AS (SELECT event_id, user_id, event_type, CASE WHEN event_type<>'error' THEN 0 ELSE row_number() OVER (PARTITION BY user_id, g, event_type='error' ORDER BY ts, event_id) END AS c FROM a) SELECT event_id, user_id, c AS consecutive_failures, c>=3 AS disabled FROM b""")
def _(spark, sf):
    out = E.failure_streaks(events(spark, sf), "user_id", ["ts", "event_id"], None, ok(), 3)
    return out.select("event_id", "user_id", "consecutive_failures", "disabled")


_RETRY = "r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type='error'), s AS (SELECT *, CASE WHEN attempt>=8 THEN 'permanently_failed' ELSE 'failed' END AS status, CASE WHEN attempt<8 THEN least(floor(pow(2,attempt-1)),60)::BIGINT END AS delay FROM r)"


def retries(spark, sf):
    return E.retry_schedule(events(spark, sf).filter(~ok()), ["user_id"], ["ts", "event_id"], None, "ts", 8)


@query("e07_retry_schedule", f"WITH {_RETRY} SELECT event_id, attempt, status, delay, CAST(floor(epoch(ts)) AS BIGINT)+delay AS next_retry FROM s")
def _(spark, sf):
    return retries(spark, sf).select("event_id", "attempt", "status", "delay", "next_retry")


@query("e07_due_retries", f"WITH {_RETRY}, l AS (SELECT user_id, arg_max(status, attempt) AS status, max(attempt) AS attempt, arg_max(CAST(floor(epoch(ts)) AS BIGINT)+delay, attempt) AS next_retry FROM s GROUP BY user_id) SELECT user_id, attempt, next_retry FROM l WHERE status='failed' AND next_retry <= 1706500000")
def _(spark, sf):
    return E.due_retries(retries(spark, sf), ["user_id"], F.lit(1706500000))


@query("e09_dedup_deliveries", "SELECT user_id, props, arg_min(event_id,(ts,event_id)) AS event_id, count(*) AS copies FROM events GROUP BY ALL")
def _(spark, sf):
    return E.dedup_deliveries(events(spark, sf), ["user_id", "props"], ["ts", "event_id"], "event_id")


@query("e09_replay_check", """WITH r AS (SELECT event_id, ts, props||(user_id%10) AS nonce, value > 20 AS expired FROM events), f AS (SELECT nonce, arg_min(event_id,(ts,event_id)) AS first FROM r WHERE NOT expired GROUP BY nonce)
   SELECT event_id, CASE WHEN expired THEN 'expired' WHEN event_id=first THEN 'accepted' ELSE 'replay' END AS verdict FROM r LEFT JOIN f USING (nonce)""")
def _(spark, sf):
    e = events(spark, sf)
    signed = F.when(F.col("value") > 20, F.col("ts") - F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("ts"))
    r = e.select("event_id", "ts", F.concat("props", (F.col("user_id") % 10).cast("string")).alias("nonce"), signed.alias("signed_at"))
    return E.replay_check(r, "nonce", "signed_at", "ts", "event_id", 300).select("event_id", "verdict")


_KEYPAD = b"webhook-secret".ljust(64, b"\0")


@query("e10_sign_payload", f"SELECT event_id, {hmac_sql('props', bytes(b ^ 0x36 for b in _KEYPAD).hex(), bytes(b ^ 0x5C for b in _KEYPAD).hex())} AS signature, true AS ok FROM events")
def _(spark, sf):
    s = E.sign(F.col("props"), "webhook-secret")
    return events(spark, sf).select("event_id", s.alias("signature"), (E.sign(F.col("props"), "webhook-secret") == s).alias("ok"))


def _bucket_sql(key, us, rate, burst, pick="event_id, allowed, remaining"):
    cap = burst * 1000000
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, {us} AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
      s AS (SELECT k, rn, event_id, us, {cap - 1000000}::BIGINT AS lvl, true AS allowed FROM e WHERE rn=1 UNION ALL SELECT e.k, e.rn, e.event_id, e.us,
        CASE WHEN least({cap}, s.lvl+(e.us-s.us)*{rate}) >= 1000000 THEN least({cap}, s.lvl+(e.us-s.us)*{rate})-1000000 ELSE least({cap}, s.lvl+(e.us-s.us)*{rate}) END, least({cap}, s.lvl+(e.us-s.us)*{rate}) >= 1000000
        FROM s JOIN e ON e.k=s.k AND e.rn=s.rn+1), o AS (SELECT event_id, allowed, lvl//1000000 AS remaining FROM s) SELECT {pick} FROM o"""


def packed(spark, sf):
    """Events with time running 1000 times faster, keyed by three clients."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf).select("event_id", (F.col("user_id") % 3).alias("client"), F.timestamp_micros(F.lit(1704067200000000) + F.floor((us - 1704067200000000) / 1000)).alias("at"))


@query("e11_rate_limit_token_bucket", _bucket_sql("user_id%3", "(epoch_us(ts)-1704067200000000)//1000", 1, 5))
def _(spark, sf):
    out = throttle.token_bucket(packed(spark, sf), "client", "at", "event_id", None, 1, 5, chunk_rows=500, fanout=16)
    return out.select("event_id", "allowed", "remaining")


def _sliding_sql(key, us, limit, width):
    log = f"list_filter(s.log, lambda t: e.us-t <= {width})"
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, {us} AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
      s AS (SELECT k, rn, event_id, true AS allowed, [us] AS log FROM e WHERE rn=1 UNION ALL SELECT e.k, e.rn, e.event_id, len({log}) < {limit}, CASE WHEN len({log}) < {limit} THEN list_append({log}, e.us) ELSE {log} END FROM s JOIN e ON e.k=s.k AND e.rn=s.rn+1)
      SELECT event_id, allowed FROM s"""


@query("e12_rate_limit_sliding", _sliding_sql("user_id%3", "(epoch_us(ts)-1704067200000000)//1000", 3, 2000000))
def _(spark, sf):
    return throttle.sliding_limit(packed(spark, sf), "client", "at", "event_id", None, 3, 2, chunk_rows=2000).select("event_id", "allowed")


@query("e13_rate_buckets", "SELECT user_id, 'minute' AS unit, strftime(date_trunc('minute',ts),'%Y-%m-%d %H:%M') AS bucket_start, count(*) AS requests FROM events GROUP BY ALL UNION ALL SELECT user_id, 'hour', strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M'), count(*) FROM events GROUP BY ALL UNION ALL SELECT user_id, 'day', strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M'), count(*) FROM events GROUP BY ALL")
def _(spark, sf):
    return E.rate_buckets(events(spark, sf), "user_id", "ts").withColumn("bucket_start", F.date_format("bucket_start", "yyyy-MM-dd HH:mm"))


_BF = """i AS (SELECT *, epoch_us(ts) AS us, sum((event_type='signup')::INT) OVER (PARTITION BY user_id%3 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events WHERE event_type IN ('error','signup')),
  f AS (SELECT event_id, user_id%3 AS client, us, island FROM i WHERE event_type='error'),
  c AS (SELECT a.event_id, a.client, a.us, a.island, count(*) AS attempts FROM f a JOIN f b ON a.client=b.client AND a.island=b.island AND b.us > a.us-7200000000 AND (b.us < a.us OR (b.us=a.us AND b.event_id<=a.event_id)) GROUP BY ALL),
  h AS (SELECT *, max(CASE WHEN attempts>=3 THEN us+7200000000 END) OVER (PARTITION BY client, island ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c)"""


@query("e14_brute_force", f"WITH {_BF} SELECT event_id, attempts, attempts>=3 AS locks, coalesce(held>us,false) AS was_locked FROM h")
def _(spark, sf):
    e = events(spark, sf).withColumn("client", F.col("user_id") % 3)
    out = E.brute_force(e, "client", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup", None, 3, 7200)
    return out.select("event_id", "attempts", "locks", "was_locked")


@query("e15_threat_events", f"""WITH RECURSIVE {DOC_DET.replace('WITH RECURSIVE ', '', 1)}, {_BF} SELECT 'client:'||client AS key, 'brute_force' AS kind, 'high' AS level, count(*) AS n FROM h WHERE attempts>=3 GROUP BY ALL
   UNION ALL SELECT value, 'ip_blocked', 'high', count(*) FROM det WHERE pii_type='ip_address' AND TRY_CAST(split_part(value,'.',1) AS INT) < 64 GROUP BY ALL
   UNION ALL SELECT 'unknown', r, l, count(*) FROM (SELECT 'sql_injection' AS r, 'critical' AS l FROM pages WHERE {_any_sql('html', T.SQL_INJECTION)} UNION ALL SELECT 'xss','high' FROM pages WHERE {_any_sql('html', T.XSS)} UNION ALL SELECT 'path_traversal','high' FROM pages WHERE {_any_sql('html', T.PATH_TRAVERSAL)}) GROUP BY ALL""")
def _(spark, sf):
    e = events(spark, sf).withColumn("client", F.col("user_id") % 3)
    locks = E.brute_force(e, "client", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup", None, 3, 7200).filter("locks")
    a = locks.select(F.concat(F.lit("client:"), F.col("client").cast("string")).alias("key"), F.lit("brute_force").alias("kind"), F.lit("high").alias("level"))
    ips = D.detect(docs(spark, sf), "text", ["doc_id"]).filter("pii_type = 'ip_address'").select("value")
    blocked = T.ip_filter(ips, "value", spark.createDataFrame([("0.0.0.0/2", "block")], "network string, list string")).filter("NOT allowed")
    b = blocked.select(F.col("value").alias("key"), F.lit("ip_blocked").alias("kind"), F.lit("high").alias("level"))
    flags = spread(table(spark, sf, "pages")).select(F.explode(T.threats(F.col("html"))).alias("t"))
    c = flags.select(F.lit("unknown").alias("key"), F.col("t.rule").alias("kind"), "t.level")
    return E.threat_rows([a, b, c]).groupBy("key", "kind", "level").agg(F.count("*").alias("n"))


@query("e17_usage_rollup", "SELECT user_id, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_used, arg_max(props,(ts,event_id)) AS last_ip, count(*) AS requests FROM events GROUP BY user_id")
def _(spark, sf):
    return E.usage_rollup(events(spark, sf), "user_id", ["ts", "event_id"], "props").withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


_STATUS = "CASE WHEN event_type='error' THEN 500 + (user_id%2)*(-100) WHEN event_type='signup' THEN 201 ELSE 200 END"


@query("e18_request_metrics", f"WITH r AS (SELECT {_STATUS} AS s FROM events) SELECT count(*) AS total, count(*) FILTER (s BETWEEN 200 AND 299) AS ok, count(*) FILTER (s BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (s BETWEEN 500 AND 599) AS server_errors, round(count(*) FILTER (s BETWEEN 200 AND 299)/count(*),6) AS success_rate, round(count(*) FILTER (s>=400)/count(*),6) AS error_rate FROM r")
def _(spark, sf):
    s = F.when(F.col("event_type") == "error", 500 - (F.col("user_id") % 2) * 100).when(F.col("event_type") == "signup", 201).otherwise(200)
    return E.request_metrics(events(spark, sf).withColumn("status", s), "status")


@query("e19_latency_histogram", f"WITH t AS (SELECT event_type, value/10 AS v FROM events), n AS (SELECT event_type, count(*) AS total FROM t GROUP BY event_type), b AS (SELECT unnest([{','.join(map(str, E.LATENCY_BUCKETS))}])::DOUBLE AS le) SELECT n.event_type, any_value(total) AS total, le, count(v) FILTER (v<=le) AS n FROM n CROSS JOIN b JOIN t USING (event_type) GROUP BY n.event_type, le")
def _(spark, sf):
    return E.histogram(events(spark, sf), ["event_type"], F.col("value") / 10, E.LATENCY_BUCKETS)


@query("e19_size_histogram", f"WITH n AS (SELECT source, count(*) AS total FROM documents GROUP BY source), b AS (SELECT unnest([{','.join(repr(x) for x in E.SIZE_BUCKETS)}])::DOUBLE AS le) SELECT n.source, any_value(total) AS total, le, count(*) FILTER (octet_length(encode(text))<=le) AS n FROM n CROSS JOIN b JOIN documents USING (source) GROUP BY n.source, le")
def _(spark, sf):
    return E.histogram(docs(spark, sf), ["source"], F.octet_length("text").cast("double"), E.SIZE_BUCKETS)


@query("e19_latency_quantiles", "SELECT event_type, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99 FROM events GROUP BY event_type")
def _(spark, sf):
    return E.latency_quantiles(events(spark, sf), ["event_type"], "value")


def spans(spark, sf):
    i = F.col("event_id")
    return events(spark, sf).select(i.alias("span"), F.when(i % 4 != 0, i - i % 4).alias("parent_span"), F.col("event_type").alias("operation"), F.col("value").alias("duration"),
                                    F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))


@query("e20_trace_rollup", "SELECT event_type AS operation, count(*) AS spans, round(avg(value),6) AS mean_duration, round(avg((event_type='error')::INT),6) AS error_share FROM events GROUP BY event_type")
def _(spark, sf):
    return E.trace_rollup(spans(spark, sf))[0]


@query("e20_child_spans", "WITH c AS (SELECT event_id-event_id%4 AS span, count(*) AS children, round(sum(value),6) AS child_duration FROM events WHERE event_id%4<>0 GROUP BY 1) SELECT event_id AS span, event_type AS operation, coalesce(children,0) AS children, coalesce(child_duration,0.0) AS child_duration FROM events LEFT JOIN c ON span=event_id")
def _(spark, sf):
    return E.trace_rollup(spans(spark, sf))[1]


# ------------------------------------------------------------------------------ streams
@query("e16_anonymize_stream", DEFAULT_SQL_TEXT)
def _(spark, sf):
    s = ST.read_stream(spark, sf, "documents").select("doc_id", "text")
    return ST.run(ST.anonymize_stream(s, "text").select("doc_id", "text"))


@query("stream_e01_route_events", f"""WITH {_GOV}, c AS (SELECT *, {_CAT} AS cat, 't'||(user_id%5) AS tenant FROM gv) SELECT 'all' AS subscription, event_id FROM c UNION ALL SELECT 'security', event_id FROM c WHERE cat IN ('security','access')
   UNION ALL SELECT 'merges_t1', event_id FROM c WHERE event_type IN ('merge_completed','dataset_created') AND tenant='t1' UNION ALL SELECT 'user7', event_id FROM c WHERE user_id=7 UNION ALL SELECT 'mixed', event_id FROM c WHERE event_type IN ('pii_detected','key_rotated') AND cat='security'""")
def _(spark, sf):
    subs = spark.createDataFrame(_SUBS, "subscription string, event_types array<string>, categories array<string>, tenant string, user_id bigint, active boolean")
    return ST.run(E.route_events(as_governance(ST.read_stream(spark, sf, "events")), subs))


@query("stream_d16_route_by_pii", f"""{DOC_DET}, m AS (SELECT doc_id, max(CASE WHEN risk >= 3 AND pii_type NOT IN ('password','api_key') THEN 3 WHEN pii_type IN ('password','api_key') THEN 2 WHEN risk >= 1 THEN 1 ELSE 0 END) AS lvl FROM det GROUP BY doc_id)
   SELECT doc_id, CASE lvl WHEN 3 THEN 'rejected' WHEN 2 THEN 'quarantined' WHEN 1 THEN 'flagged' WHEN 0 THEN 'anonymised' ELSE 'passed' END AS route FROM documents LEFT JOIN m USING (doc_id)""")
def _(spark, sf):
    sinks = {r: workspace(spark, f"route-{r}") for r in ("passed", "flagged", "rejected", "anonymised")}
    other = workspace(spark, "route-other")  # quarantined records have no sink of their own

    def decide(batch):
        spans = D.with_spans(batch, "text")
        return spans.select("doc_id", D.route(spans, CANON).alias("route"))

    ST.route_stream(ST.read_stream(spark, sf, "documents").select("doc_id", "text"), decide, sinks, other)
    out = spark.read.schema("doc_id bigint, route string").parquet(other).select("doc_id", "route")
    for r, path in sinks.items():
        part = spark.read.schema("doc_id bigint").parquet(path).select("doc_id", F.lit(r).alias("route"))
        out = out.unionByName(part)
    return out


@query("stream_e09_first_delivery", "SELECT DISTINCT user_id, props, event_type FROM events")
def _(spark, sf):
    s = ST.read_stream(spark, sf, "events").select("user_id", "props", "event_type", "ts")
    return ST.run(ST.first_seen(s, ["user_id", "props", "event_type"])).select("user_id", "props", "event_type")


@query("stream_e02_event_counts", _HOURS)
def _(spark, sf):
    out = ST.run(ST.window_counts(ST.read_stream(spark, sf, "events")), "update")
    return ST.latest(out, ["window_start", "event_type"]).select(hour(), "event_type", "n")


@query("stream_e13_rate_buckets", "SELECT user_id, strftime(date_trunc('hour',ts),'%Y-%m-%d %H') AS bucket_start, count(*) AS requests FROM events GROUP BY ALL")
def _(spark, sf):
    out = ST.run(ST.rate_counters(ST.read_stream(spark, sf, "events"), "user_id"), "update")
    return ST.latest(out, ["user_id", "bucket_start"]).select("user_id", hour("bucket_start"), "requests")


@query("stream_e17_usage_rollup", "SELECT user_id, count(*) AS requests, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_used FROM events GROUP BY user_id")
def _(spark, sf):
    out = ST.run(ST.usage(ST.read_stream(spark, sf, "events"), "user_id"), "update")
    return ST.total_usage(out, "user_id").withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("stream_s04_ingest_idempotent", "SELECT DISTINCT user_id, props FROM events")
def _(spark, sf):
    s = ST.read_stream(spark, sf, "events").select("user_id", "props", "ts")
    return ST.run(ST.first_seen(s, ["user_id", "props"])).select("user_id", "props")


@query("stream_e11_token_bucket", _bucket_sql("user_id", "epoch_us(ts)", 1, 3))
def _(spark, sf):
    out = ST.run(ST.token_bucket_stream(ST.read_stream(spark, sf, "events"), "user_id", 1, 3))
    return out.select("event_id", "allowed", "remaining")


@query("stream_e12_sliding", _sliding_sql("user_id", "epoch_us(ts)", 2, 7200000000))
def _(spark, sf):
    return ST.run(ST.sliding_limit_stream(ST.read_stream(spark, sf, "events"), "user_id", 2, 7200)).select("event_id", "allowed")


@query("stream_e14_lockout", f"WITH {_BF.replace('user_id%3', 'user_id')} SELECT event_id, attempts, attempts>=3 AS locks, coalesce(held>us,false) AS was_locked FROM h")
def _(spark, sf):
    out = ST.run(ST.lockout_stream(ST.read_stream(spark, sf, "events"), "user_id", "error", "signup", 3, 7200))
    return out.select("event_id", "attempts", "locks", "was_locked")


@query("stream_m04_reservoir", "SELECT event_id FROM events ORDER BY sha256('r|'||event_id), event_id LIMIT 200")
def _(spark, sf):
    out = ST.run(ST.reservoir_stream(ST.read_stream(spark, sf, "events"), "event_id", "r", 200), "update")
    cells = ST.latest(out, ["cell"])
    rows = cells.select(F.explode(F.arrays_zip("hashes", "ids")).alias("x")).select(F.col("x.hashes").alias("h"), F.col("x.ids").alias("event_id"))
    return rows.orderBy("h", "event_id").limit(200).select("event_id")
