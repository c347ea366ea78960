"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into blocks. Two fingerprints within `bits` of each other differ in at most
`bits // blocks` places of some block. The words of a block are covered by anchors: its first 15
bits run over a Hamming code (every word of 15 bits is within one flip of exactly one code word),
the other bits are free. Each fingerprint is at home at its nearest anchor, at most one flip away,
and visits every anchor within the covering radius plus the block's threshold; a close partner is
therefore a visitor at its home. Fingerprints are compared per anchor, home against visitors, on
all 64 bits.

Only distinct fingerprints are compared, and an anchor passes on a forest (each fingerprint with
the smallest it is linked to there) and not all pairs; components of the forest are components of
all links.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardstone.llm.components import components, local_roots
from wardstone.llm.store import kept, slices

#: Bits of a block that run over the Hamming code: positions 1 to 15, a flip's syndrome is its position.
CODE = 15
#: Shingles hashed before their bits are counted.
CHUNK = 1 << 16
#: Pairs compared at a time.
PAIRS = 1 << 20
#: Visitors of an anchor that a task compares at once; more are split, and homes meet each part.
VISITORS = 20_000
#: One fingerprint in so many is counted to find crowded anchors.
SHARE = 64


def shingle_hashes(text: bytes, words: int, seed: int):
    """XXH64 of each run of `words` words (all, if fewer), in chunks."""
    found = text.lower().split()  # bytes: lowers A-Z only, splits at the six ASCII white spaces
    if not found:
        return
    plain, ends = b" ".join(found), [*accumulate(len(w) + 1 for w in found)]
    starts, width = [0, *ends], min(words, len(found))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(found) - width + 1, CHUNK):
        stop = min(at + CHUNK, len(found) - width + 1)
        yield np.array([digest(plain[a : b - 1], seed) for a, b in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1], strict=True)], np.uint64)


def simhash(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64): a bit is 1 if set in over half the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    held, of, rows, size = [], [], [], 0
    counts = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)

    def count():
        bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(rows) - rows
        np.add.at(counts, of, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))

    for k, text in enumerate(texts):
        for hashes in shingle_hashes((text or "").encode(), words, seed):
            held.append(hashes)
            of.append(k)
            rows.append(len(hashes))
            total[k] += len(hashes)
            size += len(hashes)
            if size >= CHUNK:
                count()
                held, of, rows, size = [], [], [], 0
    if held:
        count()
    ones = (2 * counts > total[:, None]).astype(np.uint8)
    out[:] = np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (tells rows with equal ids apart), fp: one row per input row. Null and
    blank texts have fingerprint 0."""

    def work(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                fps = simhash(rows.column("text").to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id bigint, text_hash bigint, fp bigint")


def block_cuts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def flips(width: int, radius: int) -> list[np.ndarray]:
    """By syndrome: the flips of at most `radius` bits of a block that end at an anchor; first the
    one that leads home."""
    code = min(width, CODE)
    found: list[list[int]] = [[] for _ in range(16)]
    for n in range(radius + 1):
        for places in combinations(range(width), n):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < code else 0
            found[syndrome].append(sum(1 << p for p in places))
    for s, own in enumerate(found):  # home: no flip, or the flip of position s
        own.sort(key=lambda f, s=s: (f != (1 << (s - 1) if s else 0), f))
    return [np.array(own, np.uint64) for own in found]


def at_anchors(fps: np.ndarray, bits: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) rows of every fingerprint."""
    if 64 // blocks < CODE:
        raise ValueError("a block must hold the code")
    anchors, members, homes = [], [], []
    for k, (shift, width) in enumerate(block_cuts(blocks)):
        word = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        syndrome = np.zeros(len(fps), np.uint64)
        for p in range(CODE):
            syndrome ^= ((word >> np.uint64(p)) & np.uint64(1)) * np.uint64(p + 1)
        for s, own in enumerate(flips(width, 1 + bits // blocks)):
            of = np.flatnonzero(syndrome == s)
            anchors.append(((word[of][:, None] ^ own[None, :]) | np.uint64(k << 58)).reshape(-1))
            members.append(np.repeat(fps[of], len(own)))
            homes.append(np.tile(np.arange(len(own)) == 0, len(of)))
    return np.concatenate(anchors), np.concatenate(members), np.concatenate(homes)


def links_at(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between homes and visitors of each anchor; rows are sorted by anchor."""
    firsts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[firsts, len(anchor)])
    group = np.repeat(np.arange(len(firsts)), sizes)
    hosts = np.flatnonzero(home)
    hosts = hosts[sizes[group[hosts]] > 1]
    loads = np.cumsum(sizes[group[hosts]])
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(hosts):
        stop = max(at + 1, int(np.searchsorted(loads, (loads[at - 1] if at else 0) + PAIRS, "right")))
        own = hosts[at:stop]
        n = sizes[group[own]]
        left = np.repeat(own, n)
        right = np.repeat(firsts[group[own]] - (np.cumsum(n) - n), n) + np.arange(len(left))
        apart = np.bitwise_count(fp[left] ^ fp[right])
        near = np.flatnonzero((apart <= bits) & (apart > 0))
        if len(near):
            a, b = local_roots(np.concatenate([a, fp[left[near]].view(np.int64)]), np.concatenate([b, fp[right[near]].view(np.int64)]))
        at = stop
    return a, b


def links(fps: DataFrame, bits: int = 4, blocks: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (column fp)
    that differ in at most `bits` bits."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                anchor, fp, home = at_anchors(own, bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches):
        held = []
        for batch in batches:
            own = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(own)
            if sum(len(h[0]) for h in held) < 200_000 or held[0][0][0] == own[0][-1] and held[0][1][0] == own[1][-1]:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1  # the last group may go on
            yield from found([c[:last] for c in rows])
            held = [tuple(c[last:] for c in rows)]
        if held:
            yield from found([np.concatenate(c) for c in zip(*held, strict=True)])

    def found(rows):
        anchor, part, fp, home = rows
        key = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        a, b = links_at(key, fp.view(np.uint64), home, bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # Crowded anchors, estimated from a share of the fingerprints: visitors are dealt to parts and
    # homes meet every part. This places work and decides nothing. The table holds an anchor at
    # most once, and anchors are a fixed number (2^19 with three blocks).
    schema = "anchor bigint, fp bigint, home boolean"
    some = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0).select("fp").mapInArrow(spread, schema)
    crowded = some.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > VISITORS // SHARE)
    crowded = crowded.select("anchor", F.ceil(F.col("n") * SHARE / VISITORS).cast("int").alias("parts"))
    at = fps.select("fp").mapInArrow(spread, schema).join(F.broadcast(crowded), "anchor", "left")
    split = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), split).cast("int")
    dealt = at.select("anchor", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), split - 1)).otherwise(F.array(own))).alias("part"), "fp", "home")
    return dealt.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(compare, "a bigint, b bigint")


def rooted_rows(docs: DataFrame, bits: int, words: int, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_groups with their component's root, a fingerprint: it names the component,
    which component_id does not if an id stands on unlike texts."""
    rows = kept(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tree = components(links(kept(distinct.select("fp"), "distinct-fingerprints"), bits, blocks))
    rooted = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_groups(docs: DataFrame, *, bits: int = 4, words: int = 4, blocks: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, fp (bigint), component_id (the smallest doc_id
    that links of at most `bits` differing bits reach, the own one included).

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows with equal
    ids stay apart (text_hash). Null ids are the smallest of a group only if all are null. An
    empty table gives an empty result; other columns are not looked at."""
    return rooted_rows(docs, bits, words, blocks, id_col, text_col).drop("root")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, *, bits: int = 4, words: int = 4, blocks: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one of each group stays: that with the smallest
    id (nulls last, then by text hash; of repeated rows one)."""
    groups = rooted_rows(docs, bits, words, blocks, id_col, text_col)
    smallest = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    stays = groups.groupBy("root").agg(F.min(smallest).alias("x"))
    none = F.lit(-(2**63)).cast("bigint")
    stays = stays.select(F.coalesce("x.doc_id", none).alias("__keep_id"), F.col("x.text_hash").alias("__keep_hash")).distinct()
    keyed = docs.withColumns({"__keep_id": F.coalesce(F.col(id_col).cast("bigint"), none), "__keep_hash": F.xxhash64(F.col(text_col))})
    found = keyed.join(stays, ["__keep_id", "__keep_hash"], "left_semi")
    one = F.row_number().over(W.partitionBy("__keep_id", "__keep_hash").orderBy("__keep_id"))
    return found.withColumn("__keep_row", one).filter("__keep_row = 1").select(*docs.columns)
