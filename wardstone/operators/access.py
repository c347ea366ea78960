"""Access decisions for whole request tables.

Policies are configuration, so they compile into Column expressions: a decision is a projection
of the request table. Role grants are data, so they are joined by equality on user and role."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.conditions import Condition, Rules, compile_condition, compile_rules, glob_regex
from ..session import cut

# ---- fixed values: built-in permissions (id, resource type, actions) and roles --------------
PERMISSIONS = [
    ("datasets:read", "dataset", ["read", "list"]), ("datasets:write", "dataset", ["create", "update", "delete"]), ("datasets:admin", "dataset", ["*"]),
    ("records:read", "record", ["read", "list"]), ("records:write", "record", ["create", "update", "delete"]), ("records:admin", "record", ["*"]),
    ("users:read", "user", ["read", "list"]), ("users:write", "user", ["create", "update"]), ("users:admin", "user", ["*"]),
    ("roles:read", "role", ["read", "list"]), ("roles:admin", "role", ["*"]), ("policies:read", "policy", ["read", "list"]),
    ("policies:admin", "policy", ["*"]), ("audit:read", "audit_log", ["read", "list"]), ("system:admin", "system", ["*"]),
]
ROLES = {
    "admin": ["system:admin"],
    "data-admin": ["datasets:admin", "records:admin"],
    "data-analyst": ["datasets:read", "records:read"],
    "auditor": ["audit:read", "datasets:read", "records:read"],
    "user-admin": ["users:admin", "roles:read"],
}
WEIGHTS = {"rbac": 0.4, "abac": 0.4, "regulatory": 0.2}


def builtin_permissions(spark: SparkSession) -> DataFrame:
    """(permission, resource_type, action, filter): a fixed table."""
    rows = [(p, t, a, None) for p, t, acts in PERMISSIONS for a in acts]
    return spark.createDataFrame(rows, "permission string, resource_type string, action string, filter string")


def builtin_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")


def effective_roles(user_roles: DataFrame, parents: DataFrame) -> DataFrame:
    """Users with their own and inherited roles. The closure runs on the role table; a role
    visited once is not followed again, so cycles end."""
    closed = cut(user_roles.select("role").distinct().select("role", F.col("role").alias("inherited")))
    front = closed
    up = parents.select(F.col("role").alias("__r"), F.col("parent").alias("__p"))
    while True:
        step = front.join(up, F.col("inherited") == F.col("__r")).select("role", F.col("__p").alias("inherited")).distinct()
        front = cut(step.join(closed, ["role", "inherited"], "left_anti"))
        if front.isEmpty():
            break
        closed = closed.unionByName(front)
    return user_roles.join(closed, "role").select("user_id", F.col("inherited").alias("role")).distinct()


def rbac_check(requests: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Add ``rbac_allowed``: some permission of some role fits type, action and resource id.

    Requests: user_id, action, resource_type, resource_id. Distinct request shapes are decided
    once; all joins are equalities (user, role, permission), globs are tested on the matches."""
    shape = ["user_id", "action", "resource_type", "resource_id"]
    grants = user_roles.join(role_permissions, "role").join(permissions, "permission").select(
        "user_id", F.col("resource_type").alias("p_type"), F.col("action").alias("p_action"),
        F.concat(F.lit("^"), F.replace(F.col("filter"), F.lit("*"), F.lit(".*")), F.lit("$")).alias("p_regex")).distinct()
    asked = requests.select(*shape).distinct()
    fits = (
        ((F.col("p_type") == "*") | (F.col("p_type") == F.col("resource_type")))
        & ((F.col("p_action") == "*") | (F.col("p_action") == F.col("action")))
        & (F.col("p_regex").isNull() | F.col("resource_id").isNull() | F.expr("resource_id RLIKE p_regex")))
    ok = asked.join(grants, "user_id").filter(fits).select(*shape).distinct().withColumn("__ok", F.lit(True))
    renamed = ok.select(*[F.col(c).alias(f"__{c}") for c in shape], "__ok")
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shape])
    return requests.join(renamed, test, "left").select(*requests.columns, F.coalesce("__ok", F.lit(False)).alias("rbac_allowed"))


# ------------------------------------------------------------------------------ policies
@dataclass(frozen=True)
class Statement:
    effect: str
    principals: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    resources: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class AccessPolicy:
    id: str
    statements: tuple[Statement, ...]
    priority: int = 0
    enabled: bool = True


def _glob_any(value: Column, patterns: tuple[str, ...]) -> Column:
    if not patterns or "*" in patterns:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [value.rlike(glob_regex(p)) if set(p) & set("*?") else value == p for p in patterns])


def policy_check(principal: Column, action: Column, resource: Column, policies: list[AccessPolicy], attribute=F.col) -> Column:
    """Struct (effect, policy): per policy its first matching statement; any deny wins, then an
    allow, both by priority; null effect when no policy matched."""
    denies, allows = [], []
    for p in sorted((p for p in policies if p.enabled), key=lambda p: -p.priority):
        effect = F.lit(None).cast("string")
        for s in reversed(p.statements):
            hit = _glob_any(principal, s.principals) & _glob_any(action, s.actions) & _glob_any(resource, s.resources)
            for c in s.conditions:
                hit = hit & compile_condition(c, attribute)
            effect = F.when(F.coalesce(hit, F.lit(False)), s.effect).otherwise(effect)
        denies.append(F.when(effect == "deny", F.lit(p.id)))
        allows.append(F.when(effect == "allow", F.lit(p.id)))
    none = F.lit(None).cast("string")
    deny, allow = F.coalesce(none, *denies), F.coalesce(none, *allows)
    return F.struct(F.when(deny.isNotNull(), "deny").when(allow.isNotNull(), "allow").alias("effect"), F.coalesce(deny, allow).alias("policy"))


@dataclass(frozen=True)
class AbacPolicy:
    id: str
    effect: str
    priority: int = 0
    resource_type: str | None = None
    actions: tuple[str, ...] = ()
    subject: Rules | Condition | None = None
    resource: Rules | Condition | None = None
    environment: Rules | Condition | None = None
    enabled: bool = True


def abac_check(resource_type: Column, action: Column, policies: list[AbacPolicy], attribute=F.col, default: str = "deny") -> Column:
    """Struct (effect, policy): the applicable policy of highest priority decides."""
    out = F.struct(F.lit(default).alias("effect"), F.lit(None).cast("string").alias("policy"))
    for p in sorted((p for p in policies if p.enabled), key=lambda p: p.priority):
        hit = compile_rules(p.subject, attribute) & compile_rules(p.resource, attribute) & compile_rules(p.environment, attribute)
        if p.resource_type not in (None, "*"):
            hit = hit & (resource_type.isNull() | (resource_type == p.resource_type))
        if p.actions and "*" not in p.actions:
            hit = hit & (action.isNull() | action.isin(*p.actions))
        out = F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(p.effect).alias("effect"), F.lit(p.id).alias("policy"))).otherwise(out)
    return out


def authorize(requests: DataFrame, policies: list[AccessPolicy], abac: list[AbacPolicy], system_users: list = (), anonymous_users: list = ()) -> DataFrame:
    """Add allowed, source and reason. Requests carry ``rbac_allowed`` (see rbac_check),
    principal, action, resource, resource_type, user_id and ``public``."""
    pol = policy_check(F.col("principal"), F.col("action"), F.col("resource"), policies)
    ab = abac_check(F.col("resource_type"), F.col("action"), abac)
    system = F.col("user_id").isin(list(system_users)) if system_users else F.lit(False)
    anonymous = F.col("user_id").isNull() | (F.col("user_id").isin(list(anonymous_users)) if anonymous_users else F.lit(False))
    public = F.coalesce(F.col("public"), F.lit(False)) & (F.col("action") == "read")

    def verdict(allowed: bool, source: str, reason: Column | str) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(source).alias("source"), why.alias("reason"))

    v = (
        F.when(system, verdict(True, "system", "system"))
        .when(anonymous & public, verdict(True, "default", "public read"))
        .when(anonymous, verdict(False, "default", "anonymous access denied"))
        .when(F.col("__pol.effect") == "deny", verdict(False, "policy", F.concat(F.lit("denied by "), F.col("__pol.policy"))))
        .when(F.col("rbac_allowed"), verdict(True, "rbac", "role permission"))
        .when(F.col("__ab.effect") == "allow", verdict(True, "abac", F.coalesce(F.col("__ab.policy"), F.lit("default"))))
        .when(F.col("__pol.effect") == "allow", verdict(True, "policy", F.concat(F.lit("allowed by "), F.col("__pol.policy"))))
        .otherwise(verdict(False, "default", "no matching permission")))
    return requests.withColumn("__pol", pol).withColumn("__ab", ab).withColumn("__v", v).select(*requests.columns, "__v.allowed", "__v.source", "__v.reason")


# ------------------------------------------------------------------------------ weighted evaluation
@dataclass(frozen=True)
class WeightedRule:
    id: str
    effect: str
    permissions: tuple[str, ...]
    priority: int = 0
    tenant: str | None = None
    roles: tuple[str, ...] = ()
    resource_types: tuple[str, ...] = ()
    resource_ids: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()


def _scan_rules(rules: list[WeightedRule], permission: Column, tests, confidences) -> Column:
    """First deny among the matching rules (by priority) beats all; otherwise any allow."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    granted = [F.coalesce(t, F.lit(False)) & (F.lit("admin" in r.permissions) | permission.isin(*r.permissions))
               & (F.lit(True) if r.tenant is None else F.col("tenant") == r.tenant) for r, t in zip(ordered, map(tests, ordered))]
    deny = reduce(lambda a, b: a | b, [g for r, g in zip(ordered, granted) if r.effect == "deny"], F.lit(False))
    allow = reduce(lambda a, b: a | b, [g for r, g in zip(ordered, granted) if r.effect == "allow"], F.lit(False))
    best = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(g, confidences(r)).otherwise(0.0) for r, g in zip(ordered, granted) if r.effect == "allow"])
    matched = deny | allow
    conf = F.when(deny, 1.0).when(~matched, 0.5).when(best > 0, best).otherwise(0.7)
    return F.struct((allow & ~deny).alias("allowed"), conf.alias("confidence"), matched.alias("matched"))


def weighted_rbac(rules: list[WeightedRule], permission: Column, roles: Column, resource_type: Column, resource_id: Column) -> Column:
    def overlap(r):
        if "*" in r.roles:
            return F.size(roles)
        return F.size(F.array_intersect(roles, F.array(*[F.lit(x) for x in r.roles])))

    def test(r):
        out = F.lit(True)
        if r.roles:
            out = out & (overlap(r) > 0)
        if r.resource_types:
            out = out & resource_type.isin(*r.resource_types)
        if r.resource_ids:
            out = out & reduce(lambda a, b: a | b, [resource_id.rlike(glob_regex(p, escape_dots=False, question_mark=False)) for p in r.resource_ids])
        return out

    def confidence(r):
        matched = overlap(r) if r.roles else F.lit(0)
        return F.least(F.lit(1.0), 0.7 + F.lit(min(0.1, r.priority / 1000)) + F.least(F.lit(0.1), matched * 0.05))

    return _scan_rules(rules, permission, test, confidence)


def weighted_abac(rules: list[WeightedRule], permission: Column) -> Column:
    def test(r):
        return reduce(lambda a, b: a & b, [compile_condition(c) for c in r.conditions], F.lit(True))

    return _scan_rules(rules, permission, test, lambda r: F.lit([0.6, 0.7, 0.8, 0.9][min(len(r.conditions), 3)]))


def regulatory_check(roles: Column) -> Column:
    """Violations as an array of (framework, requirement, severity), from the columns
    legal_basis, allowed_purposes, classification, hipaa_authorization, ccpa_opted_out,
    is_sale and pending_deletion."""
    def rule(test: Column, framework: str, requirement: str, severity: str) -> Column:
        bad = F.coalesce(test, F.lit(False))
        return F.when(bad, F.struct(F.lit(framework).alias("framework"), F.lit(requirement).alias("requirement"), F.lit(severity).alias("severity")))

    clinical = F.arrays_overlap(roles, F.array(*[F.lit(r) for r in ("healthcare_provider", "admin", "auditor")]))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.array_compact(F.array(
        rule(F.col("legal_basis").isNull(), "GDPR", "gdpr-legal-basis", "deny"),
        rule(F.col("allowed_purposes").isNotNull() & (F.size("allowed_purposes") == 0), "GDPR", "gdpr-purpose-limitation", "warn"),
        rule(~F.coalesce(clinical, F.lit(False)), "HIPAA", "hipaa-minimum-necessary", "deny"),
        rule((F.col("classification") == "restricted") & ~yes("hipaa_authorization"), "HIPAA", "hipaa-authorization", "deny"),
        rule(yes("ccpa_opted_out") & yes("is_sale"), "CCPA", "ccpa-opt-out", "deny"),
        rule(yes("pending_deletion"), "CCPA", "ccpa-consumer-rights", "deny")))


def evaluate_weighted(requests: DataFrame, rules: list[WeightedRule], roles: str = "roles", permission: str = "action") -> DataFrame:
    """Allow only when RBAC, ABAC and regulation all allow; a regulatory denial decides alone."""
    p = F.col(permission)
    d = requests.withColumn("__r", weighted_rbac(rules, p, F.col(roles), F.col("resource_type"), F.col("resource_id")))
    d = d.withColumn("__a", weighted_abac(rules, p)).withColumn("__v", regulatory_check(F.col(roles)))
    denied = F.exists("__v", lambda v: v["severity"] == "deny")
    reg_conf = F.greatest(F.lit(0.5), 1 - F.size("__v") * 0.1)
    total = sum(WEIGHTS.values())
    combined = (F.col("__r.confidence") * WEIGHTS["rbac"] + F.col("__a.confidence") * WEIGHTS["abac"] + reg_conf * WEIGHTS["regulatory"]) / total
    r, a = F.col("__r.allowed"), F.col("__a.allowed")
    source = (
        F.when(denied, "regulatory").when(~r & ~a, "combined").when(~r, "rbac").when(~a, "abac")
        .when(F.col("__r.matched") & F.col("__a.matched"), "combined").when(F.col("__r.matched"), "rbac").when(F.col("__a.matched"), "abac").otherwise("default"))
    return d.select(*requests.columns, F.when(~denied & r & a, "allow").otherwise("deny").alias("decision"),
                    F.round(F.when(denied, reg_conf).otherwise(combined), 6).alias("confidence"), source.alias("decision_source"))


# ------------------------------------------------------------------------------ rows, quotas, reviews
def row_filter(df: DataFrame, scope: str, grants: DataFrame, user, pii_columns: list[str] = (), may_see_pii: bool = False) -> DataFrame:
    mine = grants.filter(F.col("user_id") == user).select(F.col("scope").alias(scope)).distinct()
    out = df.join(mine, scope, "left_semi")
    return out if may_see_pii else out.drop(*pii_columns)


def quota_check(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """usage: tenant, plan, datasets, bytes, calls; plans: plan, max_datasets, max_bytes, max_calls (null = no limit)."""
    over = {n: F.coalesce(F.col(n) >= F.col(f"max_{n}"), F.lit(False)) for n in ("datasets", "bytes", "calls")}
    j = usage.join(F.broadcast(plans), "plan", "left")  # the plan list is fixed
    return j.select(*usage.columns, *[t.alias(f"over_{n}") for n, t in over.items()], reduce(lambda a, b: a | b, over.values()).alias("over_quota"))


def redundant_grants(grants: DataFrame) -> DataFrame:
    """Grants (user, resource, action, scope) implied by another grant of the same user.

    A grant can only be implied by one of eight patterns of itself (each part as is or a
    wildcard), so the test is eight equalities instead of comparing all pairs of a user."""
    g = grants.select("user_id", "resource", "action", F.coalesce("scope", F.lit("*")).alias("scope")).distinct()
    star = F.lit("*")
    shapes = [(r, a, s) for r in (F.col("resource"), star) for a in (F.col("action"), star) for s in (F.col("scope"), star)]
    wider = g.select("*", F.explode(F.array(*[F.struct(r.alias("r"), a.alias("a"), s.alias("s")) for r, a, s in shapes])).alias("w"))
    wider = wider.filter(~((F.col("w.r") == F.col("resource")) & (F.col("w.a") == F.col("action")) & (F.col("w.s") == F.col("scope"))))
    have = g.select(F.col("user_id").alias("u"), F.col("resource").alias("r"), F.col("action").alias("a"), F.col("scope").alias("s"))
    hit = (F.col("user_id") == F.col("u")) & (F.col("w.r") == F.col("r")) & (F.col("w.a") == F.col("a")) & (F.col("w.s") == F.col("s"))
    return wider.join(have, hit, "left_semi").select("user_id", "resource", "action", "scope").distinct()
