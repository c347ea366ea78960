"""Compliance rules, recommendations, retention, data-subject requests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordering import join_same

# ---- fixed values: rule tables per framework ---------------------------------------------
ALLOWED = {
    "gdpr": {
        "biometric_data": ["hash", "encrypt", "redact"],
        "medical_record_number": ["hash", "encrypt", "redact"],
        "health_insurance_number": ["hash", "encrypt", "redact"],
        "email": ["mask", "hash", "pseudonymize", "redact"],
        "phone_number": ["mask", "hash", "pseudonymize", "redact"],
        "person_name": ["mask", "hash", "pseudonymize", "redact"],
        "full_address": ["generalize", "mask", "redact"],
        "date_of_birth": ["generalize", "mask", "redact"],
        "ssn": ["hash", "redact"],
        "national_id": ["hash", "redact"],
        "passport_number": ["hash", "redact"],
    },
    "hipaa": {
        "medical_record_number": ["redact", "hash"],
        "health_insurance_number": ["redact", "hash"],
        "prescription_number": ["redact", "hash"],
        "biometric_data": ["redact"],
        "ssn": ["redact", "hash"],
        "person_name": ["redact", "pseudonymize"],
        "date_of_birth": ["generalize", "redact"],
        "phone_number": ["redact"],
        "email": ["redact", "hash"],
        "full_address": ["redact"],
        "zip_code": ["generalize"],
    },
    "ccpa": {
        "ssn": ["hash", "redact"],
        "drivers_license": ["hash", "redact"],
        "passport_number": ["hash", "redact"],
        "email": ["mask", "hash", "redact"],
        "phone_number": ["mask", "hash", "redact"],
        "full_address": ["mask", "generalize", "redact"],
        "bank_account": ["hash", "redact"],
        "credit_card": ["mask", "hash", "redact"],
        "biometric_data": ["redact"],
        "ip_address": ["generalize", "hash", "redact"],
    },
}
MANDATORY = {
    "gdpr": ["ssn", "national_id", "passport_number", "biometric_data", "medical_record_number", "health_insurance_number"],
    "hipaa": ["person_name", "full_address", "street_address", "city", "state", "zip_code", "date_of_birth", "phone_number",
              "email", "ssn", "medical_record_number", "health_insurance_number", "drivers_license", "ip_address", "url",
              "biometric_data"],
    "ccpa": ["ssn", "drivers_license", "bank_account", "biometric_data"],
}
SPECIAL = ["biometric_data", "medical_record_number", "health_insurance_number"]
PROTECTED_HEALTH = ["medical_record_number", "health_insurance_number", "prescription_number"]
ALWAYS_PASS = ["soc2", "pci_dss"]
# detector type -> rule type, applied strategy -> rule strategy
TYPE_ALIAS = {"phone": "phone_number", "name": "person_name", "address": "full_address", "biometric": "biometric_data"}
STRATEGY_ALIAS = {"substitute": "pseudonymize", "tokenize": "pseudonymize", "label": "mask", "partial": "mask", "remove": "redact"}


def _alias(col: Column, mapping: dict[str, str]) -> Column:
    out = col
    for a, b in mapping.items():
        out = F.when(col == a, b).otherwise(out)
    return out


def rules(spark: SparkSession, frameworks: list[str]) -> DataFrame:
    """Rule rows (framework, pii_type, allowed, mandatory, special, health): a fixed table."""
    rows = []
    for f in frameworks:
        for t in sorted(set(ALLOWED.get(f, {})) | set(MANDATORY.get(f, []))):
            rows.append((f, t, ALLOWED[f].get(t), t in MANDATORY[f], f == "gdpr" and t in SPECIAL,
                         f == "hipaa" and t in PROTECTED_HEALTH))
    return spark.createDataFrame(
        rows, "framework string, rule_type string, allowed array<string>, mandatory boolean, special boolean, health boolean")


def check_compliance(applied: DataFrame, scope: list[str], frameworks: list[str]) -> DataFrame:
    """Violations per scope. ``applied``: scope columns, pii_type, strategy (null = untouched),
    one row per detection; it is counted by type and strategy before it meets the rules."""
    seen = applied.select(
        *scope, _alias(F.col("pii_type"), TYPE_ALIAS).alias("rule_type"), _alias(F.col("strategy"), STRATEGY_ALIAS).alias("strategy")
    ).groupBy(*scope, "rule_type", "strategy").agg(F.count("*").alias("n"))
    hit = seen.join(F.broadcast(rules(applied.sparkSession, frameworks)), "rule_type")
    none = F.col("strategy").isNull()
    wrong = F.col("strategy").isNotNull() & F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("strategy"))
    fw = F.col("framework")

    def found(test: Column, code: str, severity: str, n: Column) -> Column:
        return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("violations")))

    one, each = F.lit(1), F.col("n")
    out = F.array(
        found((fw == "gdpr") & F.col("mandatory") & none, "GDPR_MANDATORY_ANON", "critical", one),
        found((fw == "gdpr") & F.col("special") & wrong, "GDPR_SPECIAL_CATEGORY", "high", one),
        found((fw == "gdpr") & wrong, "GDPR_STRATEGY_MISMATCH", "medium", each),
        found((fw == "hipaa") & F.col("mandatory") & none, "HIPAA_SAFE_HARBOR_VIOLATION", "critical", one),
        found((fw == "hipaa") & F.col("mandatory") & wrong, "HIPAA_STRATEGY_INSUFFICIENT", "high", one),
        found((fw == "hipaa") & F.col("health") & ~none & ~F.col("strategy").isin("redact", "hash"), "HIPAA_PHI_PROTECTION", "critical", one),
        found((fw == "ccpa") & F.col("mandatory") & none, "CCPA_PI_NOT_PROTECTED", "high", one),
        found((fw == "ccpa") & wrong, "CCPA_STRATEGY_RECOMMENDATION", "medium", each),
    )
    return hit.select(*scope, "framework", F.col("rule_type").alias("pii_type"), "strategy", F.explode(F.array_compact(out)).alias("v")).select(
        *scope, "framework", "pii_type", "strategy", "v.code", "v.severity", "v.violations")


def verdicts(records: DataFrame, violations: DataFrame, scope: list[str], frameworks: list[str]) -> DataFrame:
    """One verdict per scope and framework; a framework without rules always passes."""
    names = F.explode(F.array(*[F.lit(f) for f in frameworks])).alias("framework")
    cells = records.select(*scope).distinct().select(*scope, names)
    blocking = (F.col("severity") == "critical") | ((F.col("framework") == "ccpa") & (F.col("severity") == "high"))
    bad = violations.groupBy(*scope, "framework").agg(
        F.sum("violations").alias("violations"), F.coalesce(F.sum(F.when(blocking, F.col("violations"))), F.lit(0)).alias("blocking"))
    return join_same(cells, bad, [*scope, "framework"], "left").select(
        *scope, "framework", F.coalesce("violations", F.lit(0)).alias("violations"),
        (F.coalesce("blocking", F.lit(0)) == 0).alias("compliant"))


def recommend_strategy(detections: DataFrame, frameworks: list[str]) -> DataFrame:
    """The strategy most frameworks allow for a type (a tie goes to redact, else to the first
    seen), and whether any framework demands anonymisation. The vote runs on the distinct types."""
    spark = detections.sparkSession
    order = spark.createDataFrame([(f, i) for i, f in enumerate(frameworks) if f in ALLOWED], "framework string, f int")
    kinds = detections.select("pii_type").distinct().withColumn("rule_type", _alias(F.col("pii_type"), TYPE_ALIAS))
    cells = kinds.crossJoin(F.broadcast(order))  # distinct types x frameworks: both fixed lists
    seen = cells.join(F.broadcast(rules(spark, frameworks)), ["framework", "rule_type"], "left")
    votes = seen.select("pii_type", "f", F.posexplode(F.coalesce("allowed", F.array(F.lit("redact")))).alias("p", "strategy"))
    tally = votes.groupBy("pii_type", "strategy").agg(F.count("*").alias("n"), F.min(F.struct("f", "p")).alias("first"))
    best = tally.groupBy("pii_type").agg(
        F.max_by("strategy", F.struct(F.col("n"), (F.col("strategy") == "redact"), -F.col("first.f"), -F.col("first.p"))).alias("recommended"))
    must = seen.groupBy("pii_type").agg(F.coalesce(F.bool_or("mandatory"), F.lit(False)).alias("mandatory"))
    picked = best.join(must, "pii_type")
    return detections.join(F.broadcast(picked), "pii_type", "left").select(
        *detections.columns, F.coalesce("recommended", F.lit("redact")).alias("recommended"), F.coalesce("mandatory", F.lit(False)).alias("mandatory"))


def compliance_score(per_record: DataFrame, scope: list[str]) -> DataFrame:
    """0.6 x mean confidence + 0.4 x share of records rewritten; 1.0 when nothing was found.

    ``per_record``: scope, detections, confidence_sum, low_confidence, rewritten (0/1)."""
    d = F.sum("detections")
    score = F.when(d == 0, 1.0).otherwise(0.6 * F.sum("confidence_sum") / F.nullif(d, F.lit(0)) + 0.4 * F.sum("rewritten") / F.greatest(F.count("*"), F.lit(1)))
    return per_record.groupBy(*scope).agg(
        F.round(score, 6).alias("score"), d.alias("detections"), F.sum("low_confidence").alias("low_confidence_warnings"))


def attestation(verdict_rows: DataFrame, scope: list[str]) -> DataFrame:
    """Digest over a scope's verdicts; the group is the fixed list of frameworks."""
    line = F.concat_ws(":", "framework", F.col("compliant").cast("string"), F.col("violations").cast("string"))
    return verdict_rows.groupBy(*scope).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("attestation"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("compliant"), F.col("framework")))), ",").alias("satisfied"))


def retention_plan(records: DataFrame, type_col: str, time_col: str, policies: DataFrame, now: Column) -> DataFrame:
    """Action per expired record: the strictest (shortest) active policy of its type decides,
    a legal hold keeps the record, and an archiving policy archives before it deletes.

    ``policies``: (record_type or '*', retain_days, action, archive_first, legal_hold, active)."""
    live = policies.filter("active")
    typed = live.groupBy("record_type").agg(
        F.min_by(F.struct("retain_days", "action", "archive_first"), F.struct("retain_days", "action")).alias("p"),
        F.bool_or("legal_hold").alias("hold"))
    exact = typed.filter("record_type <> '*'").select(F.col("record_type").alias(type_col), F.col("p").alias("tp"), F.col("hold").alias("th"))
    anyone = typed.filter("record_type = '*'").select(F.col("p").alias("ap"), F.col("hold").alias("ah"))
    default = anyone.agg(F.max("ap").alias("ap"), F.coalesce(F.max("ah"), F.lit(False)).alias("ah"))
    joined = records.join(F.broadcast(exact), type_col, "left").crossJoin(F.broadcast(default))  # policy table; one row
    p = F.when(F.col("tp").isNull() | (F.col("ap.retain_days") < F.col("tp.retain_days")), F.col("ap")).otherwise(F.col("tp"))
    due = F.date_add(F.to_date(time_col), p["retain_days"])
    expired = due < F.to_date(now)
    action = (
        F.when(~expired | p.isNull(), "keep").when(F.coalesce("th", F.lit(False)) | F.col("ah"), "hold")
        .when((p["action"] == "delete") & p["archive_first"], "archive_then_delete").otherwise(p["action"]))
    return joined.select(*records.columns, due.alias("due"), action.alias("retention_action"))


def identity(value: Column) -> Column:
    return F.sha2(F.lower(F.trim(value)), 256)


def subject_request(detections: DataFrame, key: str, requests: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Records holding a subject's identifier, with the state of the request.

    ``requests``: (request_id, identity_hash, kind 'access'|'erasure', received_at, completed_at)."""
    by_record = detections.groupBy(identity(F.col("value")).alias("identity_hash"), key).agg(F.count("*").alias("hits"))
    due = F.date_add(F.to_date("received_at"), days)
    state = F.when(F.col("completed_at").isNotNull(), "completed").when(F.to_date(now) > due, "overdue").otherwise("open")
    return by_record.join(requests, "identity_hash").select("request_id", "kind", key, "hits", due.alias("due"), state.alias("state"))


def erase(records: DataFrame, key: str, extract: DataFrame) -> DataFrame:
    return records.join(extract.filter("kind = 'erasure'").select(key).distinct(), key, "left_anti")


def in_range(df: DataFrame, time_col: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` up to, but not at, ``end`` (timestamps or their text; null: open). Rows
    without a time are in no bounded range."""
    kind = dict(df.dtypes)[time_col]
    for bound, test in ((start, F.col(time_col).__ge__), (end, F.col(time_col).__lt__)):
        if bound is not None:
            df = df.filter(test(F.lit(bound).cast(kind)))
    return df


def usage_report(events: DataFrame, time_col: str, dims: list[str], measure: str, start=None, end=None) -> DataFrame:
    """Counts per month and dimension with subtotals ('*')."""
    view = in_range(events, time_col, start, end).withColumn("month", F.date_format(F.date_trunc("month", time_col), "yyyy-MM"))
    cols = ["month", *dims]
    out = view.cube(*cols).agg(F.count("*").alias("n"), F.round(F.sum(measure), 4).alias("total"), F.grouping_id().alias("g"))
    return out.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in cols], "n", "total")


def access_report(log: DataFrame, time_col: str, actor: str, kind: str, resource: str, allowed: Column, reads: list[str], start=None, end=None) -> DataFrame:
    """Who touched what: per actor and kind of resource the reads, other actions and denials
    among the actions of ``log`` (column action), distinct resources, first and last time."""
    ok, read = F.coalesce(allowed, F.lit(False)), F.coalesce(F.col("action").isin(reads), F.lit(False))
    return in_range(log, time_col, start, end).groupBy(actor, kind).agg(
        F.count("*").alias("requests"), F.count_if(ok & read).alias("reads"), F.count_if(ok & ~read).alias("writes"), F.count_if(~ok).alias("denied"),
        F.count_distinct(resource).alias("resources"), F.min(time_col).alias("first_at"), F.max(time_col).alias("last_at"))


def framework_report(verdict_rows: DataFrame, time_col: str, start=None, end=None) -> DataFrame:
    """Per framework: verdicts in the range, compliant ones, their share, violations.

    ``verdict_rows``: framework, compliant, violations and a time. A verdict of null counts as
    not compliant, an unknown number of violations as none."""
    good = F.count_if(F.coalesce("compliant", F.lit(False)))
    return in_range(verdict_rows, time_col, start, end).groupBy("framework").agg(
        F.count("*").alias("verdicts"), good.alias("compliant"), F.round(good / F.count("*"), 6).alias("share"),
        F.coalesce(F.sum("violations"), F.lit(0)).cast("bigint").alias("violations"))


def security_report(events: DataFrame, time_col: str, category: Column, actor: str, failed: Column, start=None, end=None) -> DataFrame:
    """Per day: all events, those of the security and access categories, failures among them,
    actors who failed, and the most failures of one actor.

    Counted per (day, actor) first, so a day's actors are never a buffer of one task."""
    watched = F.coalesce(category.isin("security", "access"), F.lit(False))
    bad = watched & F.coalesce(failed, F.lit(False))
    per = in_range(events, time_col, start, end).groupBy(F.to_date(time_col).alias("day"), actor).agg(
        F.count("*").alias("n"), F.count_if(watched).alias("w"), F.count_if(bad).alias("f"))
    return per.groupBy("day").agg(
        F.sum("n").alias("events"), F.sum("w").alias("watched"), F.sum("f").alias("failures"),
        F.count_if(F.col("f") > 0).alias("failing_actors"), F.max("f").alias("most_by_one"))


def lineage_report(edges: DataFrame, time_col: str, kind: str, start=None, end=None) -> DataFrame:
    """Per kind of edge (parent, child) laid in the range: edges, nodes, nodes that only feed
    (sources) or only receive (sinks), and the largest numbers of edges out of and into a node.
    An end that is null is no node."""
    laid = in_range(edges, time_col, start, end)
    ends = laid.select(kind, F.explode(F.array(
        F.struct(F.lit("").alias("side"), F.lit(None).cast("string").alias("node")),
        F.struct(F.lit("out").alias("side"), F.col("parent").cast("string").alias("node")),
        F.struct(F.lit("in").alias("side"), F.col("child").cast("string").alias("node")))).alias("e")).select(kind, "e.side", "e.node")
    # the empty side counts the edges themselves
    per = ends.filter("node IS NOT NULL OR side = ''").groupBy(kind, "node").agg(
        F.count_if(F.col("side") == "out").alias("o"), F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "").alias("e"))
    node = F.col("node").isNotNull()
    return per.groupBy(kind).agg(
        F.sum("e").alias("edges"), F.count_if(node).alias("nodes"), F.count_if(node & (F.col("i") == 0)).alias("sources"), F.count_if(node & (F.col("o") == 0)).alias("sinks"),
        F.max("o").alias("most_out"), F.max("i").alias("most_in"))


def age_log(log: DataFrame, time_col: str, now: Column, keep_days: dict[str, int], kind: str, default_days: int | None = None) -> DataFrame:
    """The rows of a log that are to stay: those younger than their kind's days. A kind without
    an entry takes ``default_days`` (null: kept for ever); rows without a time stay."""
    days = F.lit(default_days).cast("int")
    for name, n in keep_days.items():
        days = F.when(F.col(kind) == name, n).otherwise(days)
    old = F.col(time_col).cast("timestamp") < now.cast("timestamp") - F.make_dt_interval(days)
    return log.filter(~F.coalesce(old, F.lit(False)))
