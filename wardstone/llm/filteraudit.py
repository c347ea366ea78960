"""Which filter removes what, in every order: decision diagrams of failure masks.

A document fails some of the filters; the set is its mask. Masks are counted in Spark, so a part
(a language, a source) is at most 2^filters rows, whatever its size. For each part a diagram with
one level per filter is built: an edge says pass or fail, a leaf holds the counts of one mask, and
equal nodes are one node. In the diagram of an order, the path of passes from the root is the run
of that order: what hangs on its fail edges is what each step removes. Orders are visited by plain
changes, so that the next one always comes from swapping two adjacent levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wardstone.llm.store import kept

#: Word boundaries of the text filters.
BLANKS = r"[\x20\x09-\x0D]+"
#: Tasks over which rows without an id spread where ids are joined.
SALTS = 64

Weights = tuple[int, ...]


class Diagram:
    """Counts of masks under an order of the filters 0 .. n-1 (bit f of a mask: filter f fails)."""

    def __init__(self, n: int, counts: dict[int, Weights]):
        self.order = list(range(n))
        self.zero: Weights = (0,) * len(next(iter(counts.values()), (0,)))
        self.edges: list[tuple[int, int]] = [(0, 0)]  # of node: (passes, fails); node 0 is empty at any level
        self.total: list[Weights] = [self.zero]
        self.known: dict[tuple, int] = {}
        self.root = self._build(counts, 0, 0)

    def _leaf(self, weights: Weights) -> int:
        return self._add(("leaf", weights), (0, 0), weights) if any(weights) else 0

    def _node(self, var: int, passes: int, fails: int) -> int:
        if not passes and not fails:
            return 0
        total = tuple(a + b for a, b in zip(self.total[passes], self.total[fails], strict=True))
        return self._add((var, passes, fails), (passes, fails), total)

    def _add(self, key: tuple, edges: tuple[int, int], total: Weights) -> int:
        if key not in self.known:
            self.known[key] = len(self.edges)
            self.edges.append(edges)
            self.total.append(total)
        return self.known[key]

    def _build(self, counts: dict[int, Weights], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.zero))
        var = self.order[level]
        return self._node(var, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << var))

    def swap(self, level: int) -> None:
        """Exchange the filters of two adjacent levels. Nodes below them stay as they are."""
        x, y = self.order[level : level + 2]
        done: dict[int, int] = {}

        def moved(node: int, at: int) -> int:
            if not node:
                return 0
            if node not in done:
                a, b = self.edges[node]
                if at < level:
                    done[node] = self._node(self.order[at], moved(a, at + 1), moved(b, at + 1))
                else:
                    (aa, ab), (ba, bb) = self.edges[a], self.edges[b]
                    done[node] = self._node(y, self._node(x, aa, ba), self._node(x, ab, bb))
            return done[node]

        self.root = moved(self.root, 0)
        self.order[level : level + 2] = [y, x]

    def run(self) -> Iterator[tuple[int, Weights, Weights]]:
        """(filter, weights kept, weights removed) of each step of the present order."""
        node = self.root
        for var in self.order:
            node, fails = self.edges[node]
            yield var, self.total[node], self.total[fails]

    def only(self, var: int) -> Weights:
        """Weights of what fails this filter and no other."""
        node = self.root
        for at in self.order:
            node = self.edges[node][at == var]
        return self.total[node]

    def failing(self, var: int) -> Weights:
        """Weights of what fails this filter."""
        level, nodes = self.order.index(var), [self.root]
        for _ in range(level):
            nodes = [edge for node in nodes for edge in self.edges[node]]
        return tuple(map(sum, zip(self.zero, *(self.total[self.edges[node][1]] for node in nodes), strict=True)))


def plain_changes(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all n! orders come up once: the last item
    walks through each order of the others, to and fro."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + down  # the walker stands in front of the others after walking down
        down = not down


def all_orders(names: Sequence[str], counts: dict[int, Weights]) -> pd.DataFrame:
    """One row per order and step from the counts of masks; the first weight counts rows."""
    diagram = Diagram(len(names), counts)
    failing = [diagram.failing(v)[0] for v in range(len(names))]
    unique = [diagram.only(v)[0] for v in range(len(names))]
    shapley = [0] * len(names)
    rows = []

    def take():
        label = "".join(names[v] for v in diagram.order)
        for step, (var, stay, gone) in enumerate(diagram.run(), 1):
            shapley[var] += gone[0]
            rows.append([label, step, var, stay[0], gone[0], failing[var] - gone[0], unique[var], *gone[1:]])

    take()
    for level in plain_changes(len(names)):
        diagram.swap(level)
        take()
    return pd.DataFrame([[label, step, names[var], *rest, shapley[var]] for label, step, var, *rest in rows])


def audit(rows: DataFrame, filters: Sequence[str], *, part: str = "part", lost: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order (names joined), step
    (from 1), filter, kept, removed, redundant, unique_fails, <name>_lost for each of `lost`, and
    shapley (the filter's removed rows summed over all orders).

    `filters` and `lost` name boolean columns; null counts as false. A null part is a part of its
    own, an empty table gives no row, repeated rows count each, other columns are not looked at.
    A part meets as at most 2^filters rows; there are filters! orders, so take a handful."""
    names, kinds = list(filters), rows.schema[part].dataType.simpleString()
    mask = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) * (1 << k) for k, f in enumerate(names)), F.lit(0))
    counted = rows.select(F.col(part).alias("part"), mask.alias("mask"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"w{k}") for k, c in enumerate(lost)])
    counted = counted.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(lost))])
    out = [("filter_order", "string"), ("step", "int"), ("filter", "string"), *((c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails")),
           *((f"{c}_lost", "bigint") for c in lost), ("shapley", "bigint")]
    columns = [c for c, _ in out]

    def of_part(masks: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, w)) for m, *w in masks.drop(columns="part").itertuples(index=False)}
        found = all_orders(names, counts)
        found.columns = columns
        found.insert(0, "part", masks["part"].iloc[0])
        return found

    return counted.groupBy("part").applyInPandas(of_part, ", ".join(f"{c} {t}" for c, t in [("part", kinds), *out]))


def text_failures(text: Column) -> dict[str, Column]:
    """What a text (not null) fails by itself: too short, repetitive, shouting, marked up."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: id, part, failures A to E, good and toxic.

    A null text is an empty one, a null part the empty string. E fails a text that equals one of a
    smaller id anywhere in the table; a row without an id is smaller than none and never fails,
    and rows of the same id don't fail each other. An id is good (quality 1) or toxic (toxic 1) if
    any of its labels says so; ids without labels are neither. Texts are read once and don't
    move: narrow rows with a digest are written to the shared folder and joined on both digest
    and id, so that a large group of copies is no hot key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = texts.select(
        "id", "part", *[c.alias(k) for k, c in text_failures(F.col("text")).items()], F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    rows = kept(rows, "failures")
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(0).alias("salt"), F.lit(True).alias("first"))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0))
    judged = rows.join(first, ["digest", "id", "salt"], "left").join(marked, ["id", "salt"], "left")
    return judged.select("id", "part", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"),
                         *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """`audit` of the five filters of `document_failures` with what good and toxic documents lose."""
    return audit(document_failures(docs, labels, **columns), "ABCDE", lost=["good", "toxic"])


def filter_audit_sql() -> str:
    """The same in DuckDB, mask by mask and order by order."""
    steps = []
    for order in permutations("ABCDE"):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << "ABCDE".index(name)
            steps.append(f"('{''.join(order)}', {step}, '{name}', {bit}, {before})")
            before |= bit
    blanks = r"[\x20\x09-\x0D]+"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '{blanks}'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
    s(filter_order, step, letter, bit, before) AS (VALUES {", ".join(steps)}),
    r AS (SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step::INT AS step, letter AS "filter", kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
