"""Detection of personal data and secrets in text columns and JSON.

Texts are scanned in place: the spans of a row are one array column, so detection,
overlap removal, validation and rewriting need no shuffle of the texts. ``explode_spans``
turns them into a narrow detections table when rows are wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spans as S
from ..functions.jsontext import json_strings
from ..functions.ordering import first_n, join_same
from ..functions.patterns import (
    CATEGORY_OF_TYPE,
    KEYWORDS,
    LOW,
    HIGH,
    MEDIUM,
    NAME_HINTS,
    PROFILES,
    RISK_LEVELS,
    RISK_OF_CATEGORY,
    Pattern,
)

from ..session import cut

Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DetectConfig:
    profile: str | list[Pattern] = "canonical"
    overlap: str = "earliest"
    validate_first: bool = False
    min_confidence: float = 0.5
    min_risk: int = LOW
    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    extra_patterns: tuple[Pattern, ...] = field(default_factory=tuple)

    @property
    def patterns(self) -> list[Pattern]:
        base = PROFILES[self.profile] if isinstance(self.profile, str) else self.profile
        return [*base, *self.extra_patterns]


STRICT = DetectConfig(min_confidence=0.9, min_risk=HIGH)
PERMISSIVE = DetectConfig(min_confidence=0.3)


#: Parts into which the values of one type are cut when they meet regex entries.
SALTS = 16


def label_risk(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RISK_LEVELS]), rank + 1)


def type_lookup(mapping: dict, key: Column, default=None) -> Column:
    table = F.map_from_arrays(S.constants(list(mapping)), S.constants(list(mapping.values())))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


# -------------------------------------------------------------------- span arrays
def with_candidates(df: DataFrame, text: str, patterns: list[Pattern], out="spans") -> DataFrame:
    """Every match of every pattern as a sorted array column."""
    spans = S.remembered(("spans", text, tuple(patterns)), lambda: S.all_spans(F.col(text), patterns))
    return S.bind(df, out, spans)


def resolve(df: DataFrame, config: DetectConfig, spans: str = "spans") -> DataFrame:
    """Overlap removal, validators and the confidence / risk / type filter on a span array."""
    wanted = S.remembered(
        ("resolve", spans, tuple(config.patterns), config.overlap, config.validate_first, config.min_confidence,
         config.min_risk, config.include_types, config.exclude_types), lambda: _wanted(config, spans))
    empty = F.array().cast(S.SPAN_TYPE)
    bound = S.bind(df, "__new", F.when(F.size(spans) > 0, wanted).otherwise(empty))
    return bound.drop(spans).withColumnRenamed("__new", spans)


def _wanted(config: DetectConfig, spans: str) -> Column:
    return wanted_spans(config, F.col(spans))


def wanted_spans(config: DetectConfig, col: Column) -> Column:
    """Overlap removal, validators and the filters of a configuration on an array of spans."""
    patterns = config.patterns
    keep = [
        i
        for i, p in enumerate(patterns)
        if p.confidence >= config.min_confidence
        and p.risk >= config.min_risk
        and (not config.include_types or p.pii_type in config.include_types)
        and p.pii_type not in config.exclude_types
    ]
    ok = lambda s: S.passes_validator(s, patterns)
    if config.validate_first:
        resolved = S.OVERLAP_MODES[config.overlap](F.filter(col, ok))
    else:
        resolved = F.filter(S.OVERLAP_MODES[config.overlap](col), ok)
    return F.filter(resolved, lambda s: s["ord"].isin(keep) if keep else F.lit(False))


def with_spans(df: DataFrame, text: str, config: DetectConfig = DetectConfig()) -> DataFrame:
    return resolve(with_candidates(df, text, config.patterns), config)


def explode_spans(df: DataFrame, keys: list[str], patterns: list[Pattern], spans="spans") -> DataFrame:
    """One row per span: keys, pii_type, pattern, start, end, value, confidence, risk."""
    s = F.col("__span")
    return df.select(*keys, F.explode(spans).alias("__span")).select(
        *keys,
        S.lookup(patterns, "pii_type", s["ord"]).alias("pii_type"),
        S.lookup(patterns, "name", s["ord"]).alias("pattern"),
        s["start"].alias("start_pos"),
        s["end"].alias("end_pos"),
        s["value"].alias("value"),
        S.lookup(patterns, "confidence", s["ord"]).alias("confidence"),
        S.lookup(patterns, "risk", s["ord"]).alias("risk"),
    )


def detect_candidates(df: DataFrame, text: str, keys: list[str], patterns: list[Pattern]) -> DataFrame:
    return explode_spans(with_candidates(df.select(*keys, text), text, patterns), keys, patterns)


def detect(df: DataFrame, text: str, keys: list[str], config: DetectConfig = DetectConfig(),
           detectors: tuple[Detector, ...] = ()) -> DataFrame:
    """Detections table; rows of custom detectors join before a final overlap pass."""
    found = explode_spans(with_spans(df.select(*keys, text), text, config), keys, config.patterns)
    if not detectors:
        return found
    return merge_detections([found, *[d(df) for d in detectors]], keys)


def merge_detections(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of several detectors' rows, then the most confident of each overlapping run.

    The group is one record: its detections are bounded by its own text."""
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    cols = [c for c in allrows.columns if c not in keys]
    row = F.struct(
        F.col("start_pos").alias("start"),
        (-F.col("confidence")).alias("neg_confidence"),
        F.col("end_pos").alias("end"),
        *[F.col(c) for c in cols],
    )
    grouped = allrows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    row_type = dict(grouped.dtypes)["rows"]
    empty = F.array().cast(row_type)

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        better = s["neg_confidence"] < F.get(acc, F.size(acc) - 1)["neg_confidence"]
        return (
            F.when(free, F.concat(acc, F.array(s)))
            .when(better, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(s)))
            .otherwise(acc)
        )

    kept = F.aggregate("rows", empty, step)
    out = grouped.select(*keys, F.explode(kept).alias("r"))
    return out.select(*keys, *[F.col("r")[c].alias(c) for c in cols])


# -------------------------------------------------------------------- context
def context_window(text: Column, start: Column, end: Column, window: int = 100) -> Column:
    lo = F.greatest(start - window, F.lit(0))
    hi = F.least(end + window, F.length(text))
    dots = F.lit("...")
    return F.concat(
        F.when(lo > 0, dots).otherwise(""),
        F.substring(text, lo + 1, hi - lo),
        F.when(hi < F.length(text), dots).otherwise(""),
    )


def with_context(df: DataFrame, text: str, keys: list[str], config=DetectConfig(), window: int = 100) -> DataFrame:
    """Detections with the surrounding text, cut to the window before they leave the row."""
    spans = with_spans(df.select(*keys, text), text, config)
    p = config.patterns
    exploded = spans.select(*keys, text, F.explode("spans").alias("s"))
    s = F.col("s")
    return exploded.select(
        *keys,
        S.lookup(p, "pii_type", s["ord"]).alias("pii_type"),
        s["start"].alias("start_pos"),
        s["end"].alias("end_pos"),
        context_window(F.col(text), s["start"], s["end"], window).alias("context"),
    )


def adjust_confidence(df: DataFrame, text: str, keys: list[str], config=DetectConfig(), keywords=KEYWORDS,
                      cap: float = 0.4) -> DataFrame:
    """Boost a detection for every keyword of its type nearby; suggest another type when a
    keyword of a different type is nearby (the first in keyword order)."""
    widest = max(k[4] for k in keywords)
    p = config.patterns
    spans = with_spans(df.select(*keys, text), text, config)
    s = F.col("s")
    near = spans.select(*keys, text, F.explode("spans").alias("s")).select(
        *keys,
        S.lookup(p, "pii_type", s["ord"]).alias("pii_type"),
        S.lookup(p, "name", s["ord"]).alias("pattern"),
        s["start"].alias("start_pos"),
        s["end"].alias("end_pos"),
        S.lookup(p, "confidence", s["ord"]).alias("base"),
        F.lower(F.substring(F.col(text), F.greatest(s["start"] - widest, F.lit(0)) + 1,
                            F.least(s["start"], F.lit(widest)))).alias("left"),
        F.lower(F.substring(F.col(text), s["end"] + 1, F.lit(widest))).alias("right"),
    )
    boost, suggestions, hits = F.lit(0.0), [], []
    for word, kind, gain, position, reach in keywords:
        before = F.expr(f"right(`left`, {reach})").contains(word)
        after = F.substring("right", 1, reach).contains(word)
        found = {"before": before, "after": after, "around": before | after}[position]
        same = F.col("pii_type") == kind
        boost = boost + F.when(found & same, gain).otherwise(0.0)
        suggestions.append(F.when(found & ~same, F.lit(kind)))
        hits.append(F.when(found, F.lit(word)))
    return near.select(
        *keys, "pii_type", "pattern", "start_pos", "end_pos",
        F.round(F.least(F.col("base") + F.least(boost, F.lit(cap)), F.lit(1.0)), 6).alias("confidence"),
        F.coalesce(*suggestions).alias("suggested_type"),
        F.array_join(F.array_compact(F.array(*hits)), ",").alias("keywords"),
    )


def detect_by_keyword(df: DataFrame, text: str, keys: list[str], keywords=KEYWORDS) -> DataFrame:
    """After each keyword, the next token within its reach: separators are skipped, the
    token ends at white space, a comma or a quote."""
    parts = []
    for i, (word, kind, gain, _, reach) in enumerate(keywords):
        quoted = "\\Q" + word + "\\E"
        # the window after every occurrence, taken by splitting the lower-cased text on the word
        hit = F.lower(F.col(text)).contains(word)
        pieces = F.split(F.lower(F.col(text)), quoted, -1)
        ends = F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 1),
            lambda n: F.aggregate(F.slice(pieces, 1, n), F.lit(0), lambda a, x: a + F.length(x))
            + n * len(word),
        )
        parts.append(
            F.when(hit, F.transform(ends, lambda e: F.struct(F.lit(i).alias("k"), e.alias("at"))))
            .otherwise(F.array().cast("array<struct<k:int,at:int>>"))
        )
    bound = S.bind(df.select(*keys, text), "hits", F.concat(*parts))
    exploded = bound.select(*keys, text, F.explode("hits").alias("h"))
    reaches = F.array(*[F.lit(k[4]) for k in keywords])
    k = F.col("h")["k"]
    win = exploded.select(
        *keys, k.alias("k"), F.col("h")["at"].alias("at"),
        F.substring(F.col(text), F.col("h")["at"] + 1, F.element_at(reaches, k + 1)).alias("win"),
    )
    skip = F.length(F.regexp_extract("win", "^[:= \\t\"']*", 0))
    value = F.regexp_extract("win", "^[:= \\t\"']*([^\\s,\"']*)", 1)
    kinds = F.array(*[F.lit(x[1]) for x in keywords])
    words = F.array(*[F.lit(x[0]) for x in keywords])
    confs = F.array(*[F.lit(round(0.5 + x[2], 6)) for x in keywords])
    return win.filter(F.length(value) > 0).select(
        *keys,
        F.element_at(words, F.col("k") + 1).alias("keyword"),
        F.element_at(kinds, F.col("k") + 1).alias("pii_type"),
        (F.col("at") + skip).alias("start_pos"),
        (F.col("at") + skip + F.length(value)).alias("end_pos"),
        value.alias("value"),
        F.element_at(confs, F.col("k") + 1).alias("confidence"),
        F.lit(MEDIUM).alias("risk"),
    )


# -------------------------------------------------------------------- columns and JSON
def classify_columns(df: DataFrame, config=DetectConfig(), columns: list[str] | None = None) -> DataFrame:
    """Per string column and detected type: share of rows with a hit, plus the name hint."""
    columns = columns or [n for n, t in df.dtypes if t == "string"]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns
    ])).alias("x")).select("x.column_name", "x.v")
    spans = with_spans(long, "v", config)
    p = config.patterns
    types = S.bind(spans, "types", F.array_distinct(
        F.transform("spans", lambda s: S.lookup(p, "pii_type", s["ord"]))))
    flat = types.select("column_name", F.explode(F.concat(F.array(F.lit("")), "types")).alias("pii_type"))
    counts = flat.groupBy("column_name", "pii_type").agg(F.count("*").alias("n"))
    total = counts.filter("pii_type = ''").select("column_name", F.col("n").alias("rows"))
    hint = type_lookup(NAME_HINTS, F.regexp_replace(F.lower("column_name"), "[- ]", "_"))
    hits = counts.filter("pii_type <> ''")
    return total.join(F.broadcast(hits), "column_name", "left").select(
        "column_name",
        F.coalesce("pii_type", F.lit("none")).alias("pii_type"),
        F.coalesce(hint, F.lit("none")).alias("name_hint"),
        F.round(F.coalesce("n", F.lit(0)) / F.col("rows"), 6).alias("hit_rate"),
    )


def json_leaves(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """String leaves of a JSON document at any depth with their path (``a.b.[0]``). Malformed
    documents and nulls have none."""
    leaves = df.select(*keys, F.explode(json_strings(F.col(json_col))).alias("s"))
    return leaves.select(*keys, "s.path", F.col("s.value").alias("leaf"))


def detect_json(df: DataFrame, json_col: str, keys: list[str], config=DetectConfig()) -> DataFrame:
    return detect(json_leaves(df, json_col, keys), "leaf", [*keys, "path"], config)


# -------------------------------------------------------------------- long texts
def detect_chunked(df: DataFrame, text: str, keys: list[str], config=DetectConfig(), size: int = 10000,
                   overlap: int = 1000) -> DataFrame:
    """Candidates of long texts found on overlapping chunks, so that one huge text becomes
    many rows. A match belongs to the chunk in whose own range it starts; the margins on
    both sides give every match its surroundings. Chunks with a match that touches an end of
    its piece inside the text are scanned again with twice the margins, until none does: no match
    is cut, however long."""
    t = F.col(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size))
    todo = df.select(*keys, text, F.explode(starts).alias("own"))
    p = config.patterns
    margin, done = overlap, None
    while True:
        base = F.greatest(F.col("own") - margin, F.lit(0))
        pieces = todo.select("*", base.alias("base"), F.substring(t, base + 1, F.col("own") - base + size + margin).alias("piece"))
        spans = with_candidates(pieces, "piece", p)
        near = F.filter("spans", lambda s: (s["start"] + F.col("base") < F.col("own") + size) & (s["end"] + F.col("base") > F.col("own")))
        cut_right = F.col("base") + F.length("piece") < F.length(t)
        touches = F.exists(near, lambda s: (cut_right & (s["end"] == F.length("piece"))) | ((s["start"] == 0) & (F.col("base") > 0)))
        scanned = cut(spans.withColumn("again", touches).withColumn(text, F.when(touches, t)).drop("piece"))
        found = explode_spans(scanned.filter(~F.col("again")), [*keys, "own", "base"], p)
        at = F.col("start_pos") + F.col("base")
        mine = found.filter((at >= F.col("own")) & (at < F.col("own") + size)).select(
            *keys, "pii_type", "pattern", at.alias("start_pos"), (F.col("end_pos") + F.col("base")).alias("end_pos"), "value", "confidence", "risk")
        done = mine if done is None else done.unionByName(mine)
        todo = scanned.filter("again").select(*keys, text, "own")
        if todo.isEmpty():
            return done
        margin *= 2


# -------------------------------------------------------------------- reports and routing
def categorise(detections: DataFrame) -> DataFrame:
    """Category and default risk of each detection. Types that no profile has, such as those of
    own patterns, are "other"."""
    cat = type_lookup(CATEGORY_OF_TYPE, F.col("pii_type"), "other")
    return detections.withColumn("category", cat).withColumn(
        "default_risk", type_lookup(RISK_OF_CATEGORY, F.col("category"), LOW))


def detection_stats(detections: DataFrame) -> DataFrame:
    """Counts and mean confidence by type, by risk, by category and over all, in one pass."""
    view = categorise(detections).withColumn("risk_label", label_risk(F.col("risk")))
    dims = ["pii_type", "risk_label", "category"]
    sets = [[c] for c in dims] + [[]]
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return grouped.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in dims], "n", "avg_confidence")


def suppress_allowlist(detections: DataFrame, allow: DataFrame, now: Column) -> DataFrame:
    """Drop detections that equal, or match the regex of, an active unexpired entry.

    ``allow``: (kind 'exact'|'regex', pattern, pii_type or null, active, expires_at)."""
    live = allow.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    d, a = detections.alias("d"), live.alias("a")
    typed = F.col("a.pii_type").isNull() | (F.col("a.pii_type") == F.col("d.pii_type"))
    exact = d.join(
        a.filter("kind = 'exact'"), (F.col("d.value") == F.col("a.pattern")) & typed, "left_anti")
    # regex entries meet the distinct values of their type; an entry for any type is unfolded
    # over the types that were found, so that the join stays an equality on the type; values are
    # salted, since most may be of one type
    values = exact.select("pii_type", "value").distinct().withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    regex = live.filter("kind = 'regex'").select("pattern", F.col("pii_type").alias("only"))
    found = exact.select("pii_type").distinct()
    rules = regex.join(found, F.coalesce(F.col("only") == F.col("pii_type"), F.lit(True)))  # entries x types found
    rules = rules.select("pattern", "pii_type", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = values.join(rules, ["pii_type", "salt"]).filter(F.expr("value RLIKE pattern")).select("pii_type", "value").distinct()
    return exact.join(hit, ["pii_type", "value"], "left_anti").select(*detections.columns)


def record_status(df: DataFrame, text: str, keys: list[str], config=DetectConfig()) -> DataFrame:
    """clean / detected / failed (no text) per record, with its number of entities."""
    spans = with_spans(df, text, config)
    n = F.size("spans")
    return spans.select(
        *keys,
        F.when(F.col(text).isNull(), "failed").when(n > 0, "detected").otherwise("clean").alias("pii_status"),
        n.alias("entities"),
    )


def dataset_counters(status: DataFrame, dataset: str) -> DataFrame:
    return status.groupBy(dataset).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("pii_status") == "detected").alias("with_pii"),
        F.sum("entities").alias("entities"),
    )


def route(spans: DataFrame, patterns: list[Pattern], reject_risk: int = 3, quarantine_types=("password", "api_key"),
          flag_risk: int = 1) -> Column:
    """Where a record goes: rejected > quarantined > flagged > anonymised > passed."""
    def any_span(test):
        return F.exists("spans", test)

    risky = [i for i, p in enumerate(patterns) if p.risk >= reject_risk and p.pii_type not in quarantine_types]
    secret = [i for i, p in enumerate(patterns) if p.pii_type in quarantine_types]
    medium = [i for i, p in enumerate(patterns) if p.risk >= flag_risk]
    return (
        F.when(any_span(lambda s: s["ord"].isin(risky)), "rejected")
        .when(any_span(lambda s: s["ord"].isin(secret)), "quarantined")
        .when(any_span(lambda s: s["ord"].isin(medium)), "flagged")
        .when(F.size("spans") > 0, "anonymised")
        .otherwise("passed")
    )


def pii_inventory(detections: DataFrame, dataset: str, field_name: str, key: str, samples: int = 3) -> DataFrame:
    """Per dataset, field and type: hits, records, highest risk, sample values, risk score."""
    values = detections.select(dataset, field_name, "pii_type", "value").distinct()
    few = first_n(values, [dataset, field_name, "pii_type"], ["value"], F.substring("value", 1, 3), samples)
    shown = few.groupBy(dataset, field_name, "pii_type").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    totals = detections.groupBy(dataset, field_name, "pii_type").agg(
        F.count("*").alias("hits"),
        F.count_distinct(key).alias("records"),
        F.max("risk").alias("max_risk"),
        F.sum((F.col("risk") + 1) * F.col("confidence")).alias("score"),
    )
    return join_same(totals, shown, [dataset, field_name, "pii_type"]).withColumn("score", F.round("score", 6))
