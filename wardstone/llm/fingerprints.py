"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

Terms are the words of the lower-cased text. The hash of a term votes on 64 signed bits with the
weight 1 + floor(log2(occurrences)); a bit is 1 if its votes are positive.

Search: the 64 bits are cut into blocks, more than the radius. Two fingerprints within the radius
agree on all but `radius` blocks, so for each choice of `blocks - radius` blocks a table holds the
fingerprints with the bits permuted to put those blocks first; equal leading bits are candidates
and the Hamming distance decides.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wardstone.llm.store import slices

#: An id before all others, for null ids.
NO_ID = -(2**63)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its code points, mixed."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max(initial=0)), 0x9E3779B97F4A7C15 | 1, np.uint64)])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    terms = (points + np.uint64(1)) * powers[place]
    h = np.add.reduceat(terms, starts) if len(words) else np.zeros(0, np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def simhash(texts: pa.Array) -> np.ndarray:
    """Fingerprints (uint64) of texts; 0 for those without words."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    coded = split.flatten().dictionary_encode()
    ends = np.asarray(split.offsets, np.int64)
    counts = np.diff(ends)
    words = coded.dictionary.to_pylist()
    out = np.zeros(len(texts), np.uint64)
    if not len(words):
        return out
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, times = np.unique(np.repeat(np.arange(len(texts)), counts) * np.int64(len(words)) + codes, return_counts=True)
    doc, code = pairs // len(words), pairs % len(words)
    blank = np.array([not w for w in words], bool)
    real = ~blank[code]
    doc, code, times = doc[real], code[real], times[real]
    if not len(doc):
        return out
    weight = (1 + np.floor(np.log2(times))).astype(np.int16)
    signs = np.unpackbits(word_hashes([w or " " for w in words]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    votes = np.empty((len(starts), 64), np.int64)
    edges = np.r_[starts, len(doc)]
    for k in range(len(starts)):
        own = slice(edges[k], edges[k + 1])
        votes[k] = weight[own].astype(np.float64) @ signs[code[own]]
    out[doc[starts]] = np.packbits((votes > 0).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint) per row. Null texts are empty; texts without words have fingerprint 0."""

    def work(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(simhash(rows.column("text")).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(work, "doc_id bigint, fp bigint")


def tables(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table the (shift, width) of the blocks that lead it."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    cuts = [(sum(widths[:k]), w) for k, w in enumerate(widths)]
    return [list(c) for c in combinations(cuts, blocks - radius)]


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query_fp, fp, distance): for each distinct value of queries.fp all distinct fps.fp within
    the radius, itself included if it is there. Null fingerprints match nothing. Tables of fewer
    leading bits hold more candidates per entry; `blocks` trades tables for them."""
    keys = []
    for t, chosen in enumerate(tables(blocks, radius)):
        lead = F.lit(0).cast("bigint")
        for shift, width in chosen:
            part = F.shiftrightunsigned("fp", shift)
            lead = F.shiftleft(lead, width).bitwiseOR(part.bitwiseAND((1 << width) - 1) if width < 64 else part)
        keys.append(F.struct(F.lit(t).alias("table"), lead.alias("lead")))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("fp").filter("fp IS NOT NULL").distinct()
        return rows.select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("k")).select(name, "k.table", "k.lead")

    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    pairs = dealt(queries, "query_fp").join(dealt(fps, "fp"), ["table", "lead"]).filter(distance <= radius)
    return pairs.select("query_fp", "fp", distance.alias("distance")).distinct()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


EDITS = "doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint"


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and of the next document (descending ids;
    the last is followed by the first): columns of EDITS.

    Documents are dealt to ranges of ids and sorted there, so texts move once; the first document
    of a range, a single text, is also sent to the range that it follows on. Range borders are
    quantiles, as many as there are tasks. Rows with equal ids are ordered by text; null ids come
    last; null texts are empty; a single row follows on itself."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # several ranges per task even out how they fall
    ranges = 4 * parts
    ids = rows.select("at")
    found = ids.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    borders = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, at.to_numpy(np.int64), "right").astype(np.int32))

    heads = {r["range"]: r["at"] for r in ids.select("at", range_of("at").alias("range")).groupBy("range").agg(F.max("at").alias("at")).collect()}
    order = sorted(heads)
    follows = {heads[r]: order[(k + 1) % len(order)] for k, r in enumerate(order)}

    @F.pandas_udf("array<int>")
    def ranges_of(at: pd.Series) -> pd.Series:
        own = np.searchsorted(borders, at.to_numpy(np.int64), "right").astype(np.int32)
        # -1 - range: a copy for the range that it follows on
        return pd.Series([[r, -1 - follows[a]] if a in follows else [r] for r, a in zip(own.tolist(), at.tolist(), strict=True)])

    dealt = rows.select("at", "text", F.explode(ranges_of("at")).alias("r"))
    dealt = dealt.select("at", "text", F.when(F.col("r") < 0, -1 - F.col("r")).otherwise(F.col("r")).alias("range"), (F.col("r") < 0).alias("copy"))
    ready = dealt.repartition(parts, "range").sortWithinPartitions("range", "copy", F.desc("at"), "text")

    def work(batches):
        held = None  # the row before the next one
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                whole = pa.Table.from_batches([held, rows]) if held is not None else pa.Table.from_batches([rows])
                whole = whole.combine_chunks()
                yield from pairs(whole)
                held = whole.slice(whole.num_rows - 1).combine_chunks().to_batches()[0]

    def pairs(whole):
        at, texts, of, copy = (whole.column(n) for n in ("at", "text", "range", "copy"))
        of, copy = of.to_numpy(), copy.to_numpy(zero_copy_only=False)
        # a row and the one after it, of the same range; copies have no row of their own
        rows = np.flatnonzero((of[:-1] == of[1:]) & ~copy[:-1])
        if not len(rows):
            return
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        spelled = texts.to_pylist()
        new = [edited(spelled[k], spelled[k + 1]) for k in rows.tolist()]
        own, changed = simhash(texts), simhash(pa.array(new, pa.large_string()))
        ids = at.to_numpy()[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NO_ID), pa.array([len(spelled[k]) for k in rows.tolist()], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
             pa.array(own[rows].view(np.int64)), pa.array(changed.view(np.int64)), pa.array(own[rows + 1].view(np.int64))],
            names=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    return ready.mapInArrow(work, EDITS)
