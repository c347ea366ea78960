"""Rewriting of texts, JSON and table columns under per-type and per-field policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import spans as S, strategies as R
from ..functions.jsontext import json_strings
from ..functions.patterns import HIGH, Pattern
from ..functions.ordering import grouped_index, hash_bucket, hash_key, join_same
from . import detect as D


# ---------------------------------------------------------------------------- policies
@dataclass(frozen=True)
class Rule:
    pii_types: tuple[str, ...]
    strategy: str
    min_confidence: float = 0.0
    context_rules: tuple[tuple[str, str], ...] = ()  # (document type regex, strategy)
    exceptions: tuple[str, ...] = ()


@dataclass(frozen=True)
class FieldRule:
    path: str
    strategy: str
    is_regex: bool = False

    @property
    def regex(self) -> str:
        return self.path if self.is_regex else "^" + self.path.replace("*", ".*") + "$"


@dataclass(frozen=True)
class Policy:
    name: str
    default_strategy: str = "mask"
    rules: tuple[Rule, ...] = ()
    field_rules: tuple[FieldRule, ...] = ()
    enabled: bool = True
    priority: int = 0


@dataclass(frozen=True)
class Config:
    detect: D.DetectConfig = D.DetectConfig()
    default_strategy: str = "mask"
    per_type: tuple[tuple[str, str], ...] = ()
    policies: tuple[Policy, ...] = ()

    @property
    def active(self) -> list[Policy]:
        return sorted((p for p in self.policies if p.enabled), key=lambda p: -p.priority)

    @property
    def names(self) -> set[str]:
        out = {self.default_strategy} | {s for _, s in self.per_type}
        for p in self.active:
            out |= {r.strategy for r in p.rules} | {f.strategy for f in p.field_rules}
            out |= {s for r in p.rules for _, s in r.context_rules}
        return out


# fixed values: default strategies per type, and the presets
DEFAULT_STRATEGIES = (
    ("credit_card", "mask"), ("ssn", "mask"), ("email", "substitute"),
    ("phone", "mask"), ("password", "redact"), ("api_key", "redact"),
)


def _with(extra: dict[str, str]) -> tuple[tuple[str, str], ...]:
    return tuple({**dict(DEFAULT_STRATEGIES), **extra}.items())


DEFAULT = Config(per_type=DEFAULT_STRATEGIES)
GDPR = Config(per_type=DEFAULT_STRATEGIES)
HIPAA = Config(
    detect=D.PERMISSIVE,
    default_strategy="redact",
    per_type=_with({"name": "substitute", "date_of_birth": "generalize", "ssn": "redact",
                    "medical_record": "tokenize", "health_info": "redact"}),
)
PCI_DSS = Config(
    detect=D.DetectConfig(min_risk=HIGH),
    per_type=_with({"credit_card": "mask", "bank_account": "redact"}),
)
PRESETS = {"default": DEFAULT, "gdpr": GDPR, "hipaa": HIPAA, "pci_dss": PCI_DSS}


def _rules(*pairs: tuple[str, str]) -> tuple[Rule, ...]:
    return tuple(Rule((t,), s) for t, s in pairs)


POLICIES = {
    "gdpr": Policy("gdpr", "mask", _rules(
        ("name", "substitute"), ("email", "mask"), ("phone", "mask"), ("address", "generalize"),
        ("ip_address", "mask"), ("location", "generalize"), ("biometric", "redact"))),
    "hipaa": Policy("hipaa", "redact", _rules(
        ("name", "substitute"), ("date_of_birth", "generalize"), ("ssn", "redact"),
        ("medical_record", "tokenize"), ("health_info", "redact"), ("address", "generalize"))),
    "pci_dss": Policy("pci_dss", "mask", _rules(
        ("credit_card", "mask"), ("bank_account", "redact"), ("name", "mask"))),
}
ENGINE_POLICIES = {
    "gdpr": Policy("gdpr", "mask", (
        Rule(("email", "phone", "phone_number", "person_name"), "tokenize", 0.85),
        Rule(("ip_address", "mac_address"), "hash", 0.90))),
    "hipaa": Policy("hipaa", "mask", (
        Rule(("person_name", "medical_record_number", "health_insurance_number"), "mask", 0.95),
        Rule(("date_of_birth", "age"), "generalize", 0.80),
        Rule(("zip_code",), "generalize", 0.85, exceptions=(r"^\d{3}00$",)))),
    "pci_dss": Policy("pci_dss", "hash", (Rule(("credit_card",), "mask", 0.98),)),
}


def strategy_for(config: Config, pii_type: Column, confidence: Column, path: Column | None = None,
                 document_type: Column | None = None) -> Column:
    """Field rule, then context override, then type rule, then per-type choice, then default."""
    steps: list[tuple[Column, str]] = []
    if path is not None:
        steps += [(path.rlike(f.regex), f.strategy) for p in config.active for f in p.field_rules]
    rules = [r for p in config.active for r in p.rules]
    if document_type is not None:
        steps += [(pii_type.isin(*r.pii_types) & document_type.rlike(rx), s)
                  for r in rules for rx, s in r.context_rules]
    steps += [(pii_type.isin(*r.pii_types) & (confidence >= r.min_confidence), r.strategy) for r in rules]
    steps += [(pii_type == t, s) for t, s in config.per_type]
    default = config.active[0].default_strategy if config.active and not config.per_type else config.default_strategy
    out = F.lit(default)
    for test, strategy in reversed(steps):
        out = F.when(F.coalesce(test, F.lit(False)), strategy).otherwise(out)
    return out


def is_exception(config: Config, pii_type: Column, value: Column) -> Column:
    out = F.lit(False)
    for p in config.active:
        for r in p.rules:
            for rx in r.exceptions:
                out = out | (pii_type.isin(*r.pii_types) & value.rlike(rx))
    return out


# ---------------------------------------------------------------------------- rewriting
def rewrite(text: Column, spans: Column) -> Column:
    """Replace non-overlapping spans (start, end, replacement), sorted by start, in one pass."""
    last = F.size(spans) - 1

    def piece(s: Column, i: Column) -> Column:
        gap_from = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, gap_from + 1, s["start"] - gap_from), s["replacement"])

    tail_from = F.get(spans, last)["end"]
    tail = F.substring(text, tail_from + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), tail)).otherwise(text)


def annotate(df: DataFrame, config: Config, path: Column | None = None, document_type: Column | None = None,
             spans: str = "spans", keep_value: bool = False) -> DataFrame:
    """Span array -> annotation array with strategy and replacement; exceptions drop out."""
    def build() -> Column:
        return _annotations(config, path, document_type, spans, keep_value)

    plain = path is None and document_type is None
    key = ("annotate", config.default_strategy, config.per_type, config.policies, tuple(config.detect.patterns), spans, keep_value)
    return S.bind(df, "annotations", S.remembered(key, build) if plain else build()).drop(spans)


def _annotations(config: Config, path: Column | None, document_type: Column | None, spans: str, keep_value: bool) -> Column:
    patterns = config.detect.patterns

    def one(s: Column) -> Column:
        kind = S.lookup(patterns, "pii_type", s["ord"])
        conf = -s["neg_confidence"]
        strategy = strategy_for(config, kind, conf, path, document_type)

        def build(b: Column) -> Column:
            fields = [
                s["start"].alias("start"), s["end"].alias("end"), b["kind"].alias("pii_type"),
                conf.alias("confidence"), b["strategy"].alias("strategy"),
                R.apply_strategy(s["value"], b["kind"], b["strategy"], config.names).alias("replacement"),
            ]
            return F.struct(*fields, *([s["value"].alias("value")] if keep_value else []))

        bound = F.array(F.struct(kind.alias("kind"), strategy.alias("strategy")))
        return F.element_at(F.transform(bound, build), 1)

    source = F.col(spans)
    if any(r.exceptions for p in config.active for r in p.rules):
        source = F.filter(
            source, lambda s: ~is_exception(config, S.lookup(patterns, "pii_type", s["ord"]), s["value"]))
    none = F.array().cast(_annotation_type(keep_value))
    return F.when(F.size(spans) > 0, F.transform(source, one)).otherwise(none)


def _annotation_type(keep_value: bool) -> str:
    tail = ",value:string" if keep_value else ""
    return ("array<struct<start:int,end:int,pii_type:string,confidence:double,strategy:string,"
            f"replacement:string{tail}>>")


def anonymize(df: DataFrame, text: str, config: Config = DEFAULT, keep_original: bool = False,
              keep_value: bool = False, path: Column | None = None, document_type: Column | None = None) -> DataFrame:
    """The whole job in one narrow pass: ``text`` is rewritten, ``annotations`` describe the
    replaced spans (offsets refer to the original), ``original_text`` is optional."""
    spans = D.with_spans(df, text, config.detect)
    noted = annotate(spans, config, path, document_type, keep_value=keep_value)
    if keep_original:
        noted = noted.withColumn("original_text", F.col(text))
    noted = noted.withColumn("input_length", F.length(text))
    return noted.withColumn(text, rewrite(F.col(text), F.col("annotations")))


def annotations(anonymized: DataFrame, keys: list[str]) -> DataFrame:
    return anonymized.select(*keys, F.explode("annotations").alias("a")).select(
        *keys, F.col("a.start").alias("start_pos"), F.col("a.end").alias("end_pos"),
        *[F.col(f"a.{c}") for c in anonymized.schema["annotations"].dataType.elementType.names if c not in ("start", "end")])


def anonymization_stats(anonymized: DataFrame, text: str) -> DataFrame:
    """Found and replaced per type and strategy, with totals ('*'), and text lengths."""
    notes = annotations(anonymized, [])
    dims = ["pii_type", "strategy"]
    per = notes.groupingSets([[F.col("pii_type")], [F.col("strategy")], []], *dims).agg(
        F.count("*").alias("found"),
        F.count_if(F.col("strategy") != "none").alias("replaced"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    ).select(*[F.coalesce(c, F.lit("*")).alias(c) for c in dims], "found", "replaced", "avg_confidence")
    sizes = anonymized.agg(F.sum("input_length").alias("input_length"), F.sum(F.length(text)).alias("output_length"))
    # one row of sizes; where nothing was found, the totals of 0 stand alone
    nothing = sizes.select(F.lit("*").alias("pii_type"), F.lit("*").alias("strategy"), F.lit(0).cast("bigint").alias("found"),
                           F.lit(0).cast("bigint").alias("replaced"), F.lit(None).cast("double").alias("avg_confidence"))
    per = per.unionByName(nothing).groupBy(*dims).agg(*[F.max(c).alias(c) for c in ("found", "replaced", "avg_confidence")])
    return per.crossJoin(F.broadcast(sizes))


def residual_scan(anonymized: DataFrame, text: str, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """Per record: detections left after rewriting, originals still present verbatim, and
    whether a second pass would change the text. Needs ``keep_value=True`` annotations."""
    again = D.with_spans(anonymized, text, config.detect)
    second = annotate(again.withColumnRenamed("annotations", "first"), config)
    t = F.col(text)
    return second.select(
        *keys,
        F.size("first").alias("replaced"),
        F.size("annotations").alias("left_over"),
        F.size(F.filter("first", lambda a: (a["value"] != a["replacement"]) & t.contains(a["value"]))).alias("verbatim"),
        (~t.eqNullSafe(rewrite(t, F.col("annotations")))).alias("second_pass_changes"),
    )


# ---------------------------------------------------------------------------- JSON and structs
def anonymize_struct(df: DataFrame, column: str, config: Config = DEFAULT) -> DataFrame:
    """Strings inside a struct / array column, at any depth; other types stay untouched."""
    def walk(value: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StringType):
            return rewrite_value(value, config, F.lit(path))
        if isinstance(kind, T.StructType):
            fields = [walk(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name).alias(f.name)
                      for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType, path + ".[]"))
        return value

    return S.bind(df, "__s", walk(F.col(column), df.schema[column].dataType, "")).drop(column).withColumnRenamed("__s", column)


def rewrite_value(value: Column, config: Config, path: Column | None = None) -> Column:
    """Detect and rewrite one string expression, for strings nested in other columns."""
    patterns = config.detect.patterns

    def scan(v: Column) -> Column:
        good = D.wanted_spans(config.detect, S.all_spans(v, patterns))

        def one(s: Column) -> Column:
            kind = S.lookup(patterns, "pii_type", s["ord"])
            strategy = strategy_for(config, kind, -s["neg_confidence"], path)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"),
                            R.apply_strategy(s["value"], kind, strategy, config.names).alias("replacement"))

        return F.element_at(F.transform(F.array(F.transform(good, one)), lambda a: rewrite(v, a)), 1)

    return F.element_at(F.transform(F.array(value), scan), 1)


def anonymize_json(df: DataFrame, column: str, config: Config = DEFAULT, counts: bool = False) -> DataFrame:
    """A JSON text column of any shape and depth: strings are rewritten in place, everything else
    (keys, numbers, nulls, order, white space) stays as it stands in the text. Malformed texts
    cannot be walked; they are rewritten as plain text. ``counts`` adds strings_seen and
    strings_changed (null for malformed texts)."""
    scanned = S.bind(df, "__leaves", json_strings(F.col(column)))

    def literal(text: Column) -> Column:
        array = F.to_json(F.array(text))
        return F.substring(array, F.lit(2), F.length(array) - 2)

    def leaf(x: Column) -> Column:
        new = rewrite_value(x["value"], config, x["path"])
        # a leaf that stays keeps its spelling
        return F.transform(F.array(new), lambda n: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(n != x["value"], literal(n)).alias("replacement")))[0]

    changed = F.filter(F.transform("__leaves", leaf), lambda x: x["replacement"].isNotNull())
    done = S.bind(scanned, "__changed", changed)
    whole = F.when(F.col("__leaves").isNull(), rewrite_value(F.col(column), config)).otherwise(rewrite(F.col(column), F.col("__changed")))
    out = done.withColumn(column, whole)
    if counts:
        seen = F.when(F.col("__leaves").isNotNull(), F.size("__leaves")).alias("strings_seen")
        out = out.withColumns({"strings_seen": seen, "strings_changed": F.when(F.col("__leaves").isNotNull(), F.size("__changed"))})
    return out.drop("__leaves", "__changed")


# ---------------------------------------------------------------------------- table columns
def shuffle_column(df: DataFrame, column: str, key: str, group: list[str], seed: str = "0") -> DataFrame:
    """Permute a column among the rows of each group: the row at position i of one hashed
    order receives the value at position i of a second, independent hashed order."""
    first = df.drop(column).withColumn("__h", hash_key(seed, "to", F.col(key)))
    second = df.select(*group, F.col(key).alias("__key"), column, hash_key(seed, "from", F.col(key)).alias("__h"))
    to = grouped_index(first, group, ["__h", key], hash_bucket(F.col("__h")))
    source = grouped_index(second, group, ["__h", "__key"], hash_bucket(F.col("__h"))).drop("__h", "__key")
    return join_same(to, source, [*group, "position"]).select(*df.columns)


def encrypt_fields(df: DataFrame, paths: list[str], key: bytes, aad: str = "") -> DataFrame:
    return _each_path(df, paths, lambda c: R.encrypt(c.cast("string"), key, aad))


def decrypt_fields(df: DataFrame, paths: list[str], key: bytes, aad: str = "") -> DataFrame:
    return _each_path(df, paths, lambda c: R.decrypt(c, key, aad))


def rotate_key(df: DataFrame, paths: list[str], old: bytes, new: bytes, aad: str = "") -> DataFrame:
    return _each_path(df, paths, lambda c: R.encrypt(R.decrypt(c, old, aad), new, aad))


def _each_path(df: DataFrame, paths: list[str], change) -> DataFrame:
    for path in paths:
        root, _, rest = path.partition(".")
        new = F.col(root).withField(rest, change(F.col(path))) if rest else change(F.col(root))
        df = df.withColumn(root, new)
    return df


# ---------------------------------------------------------------------------- token vault
def build_token_vault(found: DataFrame, key: bytes, created, ttl_days: int = 365) -> DataFrame:
    """One row per distinct value: token, sealed original, type, lifetime, access count."""
    distinct = found.groupBy("value").agg(F.min("pii_type").alias("pii_type"))
    return distinct.select(
        R.tokenize(F.col("value")).alias("token"),
        R.encrypt(F.col("value"), key).alias("sealed"),
        "pii_type",
        created.alias("created_at"),
        F.date_add(created, ttl_days).alias("expires_at"),
        F.lit(0).cast("bigint").alias("access_count"),
    )


TOKEN_REGEX = "TOK_[0-9a-f]{16}"


def detokenize(df: DataFrame, text: str, keys: list[str], vault: DataFrame, key: bytes, now) -> DataFrame:
    """Put originals back; a missing or expired token stays in the text and counts as an error.

    Only distinct tokens cross the join with the vault; the texts move once, keyed by record."""
    tokens = S.bind(df.select(*keys, text), "spans", S.all_spans(F.col(text), [Pattern("token", "token", TOKEN_REGEX)]))
    hits = tokens.select(*keys, F.explode("spans").alias("s")).select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("token"))
    live = vault.filter(F.col("expires_at") > now).select("token", R.decrypt(F.col("sealed"), key).alias("original"))
    found = hits.join(live, "token", "left")
    per = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("original", "token").alias("replacement")))).alias("reps"),
        F.count("original").alias("restored"),
        F.count_if(F.col("original").isNull()).alias("errors"),
    )
    out = df.join(per, keys, "left")
    return out.withColumn(text, F.when(F.col("reps").isNotNull(), rewrite(F.col(text), F.col("reps"))).otherwise(F.col(text))).select(
        *df.columns, F.coalesce("restored", F.lit(0)).alias("restored"), F.coalesce("errors", F.lit(0)).alias("errors"))


def count_access(vault: DataFrame, used_tokens: DataFrame) -> DataFrame:
    uses = used_tokens.groupBy("token").agg(F.count("*").alias("__n"))
    return vault.join(uses, "token", "left").withColumn(
        "access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def vault_cleanup(vault: DataFrame, now, deleted: DataFrame | None = None) -> DataFrame:
    live = vault.filter(F.col("expires_at") > now)
    return live if deleted is None else live.join(deleted, "token", "left_anti")
