"""Match spans of a text as one array column, computed row by row without a shuffle.

Each regex runs once per text: it wraps its matches in a marker character, a split on the
marker then yields alternating gap and match pieces whose lengths give the offsets. Cheap
gates (a literal or one short regex) keep most texts away from most patterns. Long texts are cut
where no match can lie, so the gates judge stretches of some hundred characters, however long the
text is.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .patterns import Pattern
from .validators import VALIDATORS

MARK, SPARE = "\ufdd0", "\ufdd1"  # Unicode noncharacters

SPAN_TYPE = (
    "array<struct<start:int,neg_confidence:double,ord:int,end:int,value:string>>"
)

GATES = {
    "at": lambda t: t.contains("@"),
    "digit": lambda t: t.rlike("[0-9]"),
    "plus": lambda t: t.contains("+"),
    "colon": lambda t: t.contains(":"),
    "colon_dash": lambda t: t.contains(":") | t.contains("-"),
    "api": lambda t: t.contains("api"),
    "aws": lambda t: t.contains("AKIA") | t.contains("ABIA") | t.contains("ACCA") | t.contains("ASIA"),
    "assign": lambda t: t.contains("=") | t.contains(":"),
}


def _walk(text: Column, found: Column) -> Column:
    """Spans of one pattern from its pieces: zero-based start, exclusive end, text order."""
    start = F.struct(
        F.lit(0).alias("pos"),
        F.lit(False).alias("hit"),
        F.array().cast(SPAN_TYPE).alias("out"),
    )

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        original = F.when(
            text.contains(MARK), F.substring(text, acc["pos"] + 1, F.length(piece))
        ).otherwise(piece)
        span = F.struct(
            acc["pos"].alias("start"),
            found["neg_confidence"].alias("neg_confidence"),
            found["ord"].alias("ord"),
            end.alias("end"),
            original.alias("value"),
        )
        return F.struct(
            end.alias("pos"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"] & (F.length(piece) > 0), F.concat(acc["out"], F.array(span)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    return F.aggregate(found["pieces"], start, step)["out"]


_built: WeakKeyDictionary = WeakKeyDictionary()


def remembered(key: tuple, build: Callable[[], Column]) -> Column:
    """Large expressions take thousands of driver calls to put together; a Column does not
    depend on any DataFrame, so each is made once per application."""
    made = _built.setdefault(SparkSession.active().sparkContext, {})
    if key not in made:
        made[key] = build()
    return made[key]


def forget() -> None:
    """Drop remembered expressions, after a registry of rules has changed."""
    _built.clear()


#: Characters from which on a text is cut into blocks, and a block into stretches.
BLOCK, STRETCH = 1 << 16, 256


def stretches(text: Column, size: int) -> Column:
    """A text as pieces of more than `size` characters (the last may be shorter), each up to white space
    that no match of a cuttable pattern holds."""
    cut = rf"(?s).{{{size}}}.*?[^0-9),=:\s]\s|.+"
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def _in_pieces(text: Column, size: int, spans_of: Callable[[Column], Column]) -> Column:
    """The sorted spans of a text from those of its pieces."""
    found = F.transform(stretches(text, size), lambda t: F.struct(F.length(t).alias("size"), spans_of(t).alias("spans")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        moved = F.transform(piece["spans"], lambda s: F.struct(
            (s["start"] + acc["pos"]).alias("start"), s["neg_confidence"].alias("neg_confidence"), s["ord"].alias("ord"),
            (s["end"] + acc["pos"]).alias("end"), s["value"].alias("value")))
        return F.struct(
            (acc["pos"] + piece["size"]).alias("pos"),
            F.when(F.size(piece["spans"]) > 0, F.concat(acc["out"], moved)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(found, start, step)["out"]


def all_spans(text: Column, patterns: list[Pattern]) -> Column:
    """Every match of every pattern, sorted by start, confidence (descending), order."""
    numbered = list(enumerate(patterns))
    cuttable, others = [n for n in numbered if n[1].cuttable], [n for n in numbered if not n[1].cuttable]
    if not cuttable:
        return _scanned(text, others)
    spans = _in_pieces(text, BLOCK, lambda block: _in_pieces(block, STRETCH, lambda t: _scanned(t, cuttable)))
    spans = F.coalesce(spans, F.array().cast(SPAN_TYPE))
    return F.array_sort(F.concat(spans, _scanned(text, others))) if others else spans


def _scanned(text: Column, patterns: list[tuple[int, Pattern]]) -> Column:
    """The spans of a text scanned as one."""

    def scan(t: Column) -> Column:
        by_gate: dict[str | None, list[Column]] = {}
        for ordinal, p in patterns:
            marked = F.regexp_replace(t, p.java, MARK + "$0" + MARK)
            by_gate.setdefault(p.gate, []).append(
                F.struct(
                    F.lit(ordinal).alias("ord"),
                    F.lit(-p.confidence).alias("neg_confidence"),
                    F.split(marked, MARK, -1).alias("pieces"),
                )
            )
        none = F.array().cast("array<struct<ord:int,neg_confidence:double,pieces:array<string>>>")
        parts = [
            F.array(*found) if gate is None else F.when(GATES[gate](t), F.array(*found)).otherwise(none)
            for gate, found in by_gate.items()
        ]
        matched = F.filter(F.concat(*parts), lambda f: F.size(f["pieces"]) > 1)
        return F.array_sort(F.flatten(F.transform(matched, lambda f: _walk(text, f))))

    # a text that already holds the marker is scanned with the marker swapped for another
    # noncharacter of equal length; the one-element transform binds the scanned text once
    clean = F.when(text.contains(MARK), F.translate(text, MARK, SPARE)).otherwise(text)
    spans = F.element_at(F.transform(F.array(clean), scan), 1)
    return F.coalesce(spans, F.array().cast(SPAN_TYPE))


def bind(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that is computed exactly once: the generator keeps the optimizer from
    copying the expression into the filters and projections above it."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def constants(values: list) -> Column:
    """A constant array, in one expression text."""
    def text(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    return F.expr("array(" + ", ".join(text(v) for v in values) + ")")


def lookup(patterns: list[Pattern], field: str, ordinal: Column) -> Column:
    """A pattern attribute by ordinal, from a constant array."""
    return F.element_at(constants([getattr(p, field) for p in patterns]), ordinal + 1)


def keep_earliest(spans: Column, out_type: str = SPAN_TYPE) -> Column:
    """Greedy scan: a span is kept when it starts at or after the end of the last kept."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast(out_type).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["last"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(spans, start, step)["out"]


def keep_replace_last(spans: Column) -> Column:
    """Greedy scan in which a more confident overlapping span replaces the last kept. On
    sorted spans this also is the best-of-cluster rule: a cluster ends where its best does."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast(SPAN_TYPE).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["last"]
        better = s["neg_confidence"] < F.element_at(acc["out"], -1)["neg_confidence"]
        swapped = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(s))
        return F.struct(
            F.when(free | better, s["end"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], F.array(s)))
            .when(better, swapped)
            .otherwise(acc["out"])
            .alias("out"),
        )

    return F.aggregate(spans, start, step)["out"]


OVERLAP_MODES = {
    "earliest": keep_earliest,
    "replace_last": keep_replace_last,
    "cluster_best": keep_replace_last,
}


def passes_validator(span: Column, patterns: list[Pattern]) -> Column:
    ok = F.lit(True)
    for name in sorted({p.validator for p in patterns if p.validator}):
        ords = [i for i, p in enumerate(patterns) if p.validator == name]
        ok = F.when(span["ord"].isin(ords), VALIDATORS[name](span["value"])).otherwise(ok)
    return ok
