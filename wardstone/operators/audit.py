"""Audit trails: hash chains, verification, redaction, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import along, join_same
from ..session import cut

# ---- fixed values ---------------------------------------------------------------------------
REDACTED_FIELDS = ["password", "token", "secret", "api_key", "authorization", "credit_card", "ssn"]
CATEGORY_OF_EVENT = {
    "dataset": ["dataset_created", "dataset_updated", "dataset_deleted", "dataset_archived", "dataset_restored"],
    "record": ["record_created", "record_updated", "record_deleted", "record_accessed"],
    "version": ["commit_created", "branch_created", "branch_deleted", "tag_created", "merge_completed"],
    "access": ["access_granted", "access_revoked", "role_assigned", "role_removed", "permission_denied"],
    "security": ["encryption_completed", "decryption_completed", "key_rotated", "anomaly_detected"],
    "compliance": ["pii_detected", "anonymization_applied", "data_export_requested", "data_deletion_requested"],
    "system": ["system_started", "system_stopped", "health_check_failed", "maintenance_started"],
    "webhook": ["webhook_created", "webhook_updated", "webhook_deleted", "webhook_delivery_failed"],
    "custom": ["custom"],
}
MUST_AUDIT = ["dataset_deleted", "record_deleted", "access_granted", "access_revoked", "permission_denied", "key_rotated",
              "anomaly_detected", "data_export_requested", "data_deletion_requested"]
ENTRY_FIELDS = ["id", "sequence", "timestamp", "event_type", "category", "severity", "action", "outcome", "actor", "target"]


def entry_body(id_: Column, sequence: Column, fields: list[Column]) -> Column:
    """Hash input of an entry without its link: fields in fixed order, missing ones empty."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in (id_, sequence, *fields)])


def build_chain(events: DataFrame, chain: str, order: list[str], bucket: Column | None, id_col: str, fields: list[str], segment_rows: int = 1000) -> DataFrame:
    """Add sequence, segment, previous_hash and entry_hash per chain.

    A hash chain is sequential by nature, so a chain is a series of segments of a fixed number
    of rows: inside a segment each entry links to the one before, the first has no previous
    hash, and ``seal_segments`` ties the segments together in a hash tree. A chain no longer
    than a segment is the plain chain; a dominant one still spreads over all its segments."""
    numbered = along(events, [chain], order, bucket, position="sequence")
    numbered = numbered.withColumn("segment", F.floor((F.col("sequence") - 1) / segment_rows))
    body = entry_body(F.col(id_col), F.col("sequence"), [F.col(c) for c in fields])
    rest = [c for c in events.columns if c != chain]
    entry = F.struct("sequence", body.alias("body"), F.struct(*rest).alias("e"))
    # at most ``segment_rows`` rows per group; whole entries travel, so nothing is joined back
    links = numbered.groupBy(chain, "segment").agg(F.collect_list(entry).alias("rows"))
    links = links.withColumn("rows", F.array_sort("rows", lambda a, b: (a["sequence"] - b["sequence"]).cast("int")))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("hashes"))

    def step(acc: Column, r: Column) -> Column:
        h = F.sha2(F.concat(r["body"], F.coalesce(acc["last"], F.lit(""))), 256)
        return F.element_at(F.transform(F.array(h), lambda x: F.struct(x.alias("last"), F.concat(acc["hashes"], F.array(x)).alias("hashes"))), 1)

    chained = links.select(chain, "segment", "rows", F.explode(F.array(F.aggregate("rows", start, step)["hashes"])).alias("hashes"))
    linked = F.transform("rows", lambda r, i: F.struct(
        r["sequence"].alias("sequence"), r["e"].alias("e"),
        F.when(i > 0, F.get(F.col("hashes"), i - 1)).alias("previous_hash"), F.get(F.col("hashes"), i).alias("entry_hash")))
    flat = chained.select(chain, "segment", F.explode(linked).alias("x"))
    out = flat.select(chain, "segment", "x.sequence", "x.previous_hash", "x.entry_hash", "x.e.*")
    return out.select(*events.columns, "sequence", "segment", "previous_hash", "entry_hash")


def segment_seals(chained: DataFrame, chain: str) -> DataFrame:
    """(chain, segment, seal, entries): the last hash of each segment and its length, to be kept
    apart from the entries."""
    return chained.groupBy(chain, "segment").agg(F.max_by("entry_hash", "sequence").alias("seal"), F.count("*").alias("entries"))


def seal_segments(chained: DataFrame, chain: str, fanout: int = 1000) -> DataFrame:
    """Root hash and length per chain: the last hashes of its segments, folded ``fanout`` at a
    time. The loop runs over tree levels (two levels cover a billion entries)."""
    return seal_root(segment_seals(chained, chain), chain, fanout)


def seal_root(seals: DataFrame, chain: str, fanout: int = 1000) -> DataFrame:
    level = seals.select(chain, F.col("segment").alias("node"), F.col("seal").alias("h"), "entries")
    while True:
        folded = level.withColumn("up", F.floor(F.col("node") / fanout)).groupBy(chain, F.col("up").alias("node")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.sum("entries").alias("entries"))
        level = cut(folded)
        if not level.agg(F.max("node")).first()[0]:
            return level.select(chain, F.col("h").alias("root"), "entries")


def verify_chain(chained: DataFrame, chain: str, id_col: str, fields: list[str], seals: DataFrame, roots: DataFrame | None = None, segment_rows: int = 1000) -> DataFrame:
    """valid, verified entries, first bad sequence and reason per chain.

    Every entry is checked against its stored predecessor, every segment against its seal
    (``segment_seals`` taken when the chain was built), and the seals against a trusted root and
    length (``roots``: chain, root, entries of ``seal_segments``). A segment that was rewritten as
    a whole, moved, added or cut off fits no seal; seals that were rewritten too fit no root."""
    links = _broken_links(chained, chain, id_col, fields, segment_rows)
    mine = segment_seals(chained, chain).select(chain, "segment", F.col("seal").alias("__seal"), F.col("entries").alias("__entries"))
    meet = F.col("s.segment").eqNullSafe(F.col("m.segment")) & F.col(f"s.{chain}").eqNullSafe(F.col(f"m.{chain}"))
    both = seals.alias("s").join(mine.alias("m"), meet, "full_outer")
    there, known = F.col("__seal").isNotNull(), F.col("seal").isNotNull()
    why = F.when(~there, "segment missing").when(~known, "segment added").when((F.col("seal") != F.col("__seal")) | (F.col("entries") != F.col("__entries")), "segment forged")
    marked = both.select(F.when(known, F.col(f"s.{chain}")).otherwise(F.col(f"m.{chain}")).alias(chain), F.coalesce("s.segment", "m.segment").alias("segment"), why.alias("why"))
    at = F.when(F.col("why").isNotNull(), F.col("segment"))
    sealed = marked.groupBy(chain).agg(F.min(at).alias("__segment"), F.min_by("why", at).alias("__seal_why"))
    out = join_same(sealed, links, [chain], "left")
    if roots is not None:
        now = seal_root(seals, chain).select(chain, F.col("root").alias("__root"), F.col("entries").alias("__length"))
        given = join_same(roots.select(chain, "root", F.col("entries").alias("__given")), now, [chain], "left")
        fits = F.coalesce((F.col("root") == F.col("__root")) & (F.col("__given") == F.col("__length")), F.lit(False))
        trusted = given.select(chain, fits.alias("__trusted"))
        missing = join_same(trusted, sealed.select(chain), [chain], "left_anti").select(chain)
        out = join_same(out, trusted, [chain], "left").unionByName(missing.withColumn("__trusted", F.lit(False)), allowMissingColumns=True)
    else:
        out = out.withColumn("__trusted", F.lit(True))
    # a broken link says more than the seal of its segment does
    in_segment = F.col("first_bad").isNotNull() & (F.col("__segment").isNull() | (F.floor((F.col("first_bad") - 1) / segment_rows) <= F.col("__segment")))
    untrusted = ~F.coalesce("__trusted", F.lit(False))
    bad = F.when(untrusted, F.lit(1)).when(in_segment, F.col("first_bad")).otherwise(F.col("__segment") * segment_rows + 1).cast("bigint")
    reason = F.when(untrusted, "seals forged").when(in_segment, F.col("reason")).otherwise(F.col("__seal_why"))
    result = out.select(chain, bad.alias("first_bad"), reason.alias("reason"), F.coalesce("entries", F.lit(0)).alias("entries"))
    valid = F.col("first_bad").isNull()
    return result.select(chain, valid.alias("valid"), F.when(valid, F.col("entries")).otherwise(F.col("first_bad") - 1).alias("verified"), "first_bad", "reason")


def _broken_links(chained: DataFrame, chain: str, id_col: str, fields: list[str], segment_rows: int) -> DataFrame:
    seen = along(chained, [chain], ["sequence"], lags={"__prev": F.col("entry_hash")}, position="__pos")
    h = F.sha2(F.concat(entry_body(F.col(id_col), F.col("sequence"), [F.col(c) for c in fields]), F.coalesce("previous_hash", F.lit(""))), 256)
    starts = (F.col("sequence") - 1) % segment_rows == 0
    expected = F.when(~starts, F.col("__prev"))
    reason = (F.when(F.col("sequence") != F.col("__pos"), "sequence gap").when(h != F.col("entry_hash"), "hash mismatch")
              .when(~F.col("previous_hash").eqNullSafe(expected), "chain broken"))
    marked = seen.withColumn("__why", reason)
    bad = F.col("__why").isNotNull()
    per = marked.groupBy(chain).agg(
        F.count("*").alias("entries"), F.min(F.when(bad, F.col("sequence"))).alias("first_bad"),
        F.min_by("__why", F.when(bad, F.col("sequence"))).alias("reason"))
    return per


def redact_context(context: Column, fields: list[str] = REDACTED_FIELDS) -> Column:
    return F.transform_values(context, lambda k, v: F.when(k.isin(fields), "[REDACTED]").otherwise(v))


def cut_agent(agent: Column, n: int = 100) -> Column:
    return F.when(F.length(agent) > n, F.concat(F.substring(agent, 1, n), F.lit("..."))).otherwise(agent)


def category_of(event_type: Column) -> Column:
    out = F.lit("custom")
    for name, types in CATEGORY_OF_EVENT.items():
        out = F.when(event_type.isin(types), name).otherwise(out)
    return out


def must_audit(event_type: Column) -> Column:
    return event_type.isin(MUST_AUDIT)


def audit_summary(log: DataFrame, time_col: str, dims: list[str], reads: list[str], writes: list[str]) -> DataFrame:
    """Totals, reads, writes and denials, over all and along each dimension, in one pass."""
    view = log.withColumn("hour", F.date_format(F.date_trunc("hour", time_col), "yyyy-MM-dd HH"))
    dims = [*dims, "hour"]
    sets = [[F.col(d)] for d in dims] + [[]]
    out = view.groupingSets(sets, *dims).agg(
        F.count("*").alias("total"), F.count_if(F.col("operation").isin(reads)).alias("reads"), F.count_if(F.col("operation").isin(writes)).alias("writes"),
        F.count_if(F.col("outcome") == "denied").alias("denied"))
    return out.select(*[F.coalesce(F.col(d).cast("string"), F.lit("*")).alias(d) for d in dims], "total", "reads", "writes", "denied")


def access_rollup(log: DataFrame, actor: str, record: str, size: str) -> DataFrame:
    """Who touched how many records, accesses and bytes. The touched ids stay rows
    (``touched``), an actor with billions of accesses is no single list."""
    per = log.groupBy(actor, record).agg(F.count("*").alias("accesses"), F.sum(size).alias("bytes"))
    return per.groupBy(actor).agg(F.count("*").alias("records"), F.sum("accesses").alias("accesses"), F.round(F.sum("bytes"), 4).alias("bytes"))


def touched(log: DataFrame, actor: str, record: str) -> DataFrame:
    return log.select(actor, record).distinct()


def audit_from_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "event_id", F.lit("authorization").alias("event_type"), "user_id", "action", "resource", "resource_type",
        F.when(F.col("allowed"), "allowed").otherwise("denied").alias("decision"), "reason", F.col("source").alias("decision_source"))
