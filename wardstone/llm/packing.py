"""Packing by shortest-pack-first over the length histogram.

Texts become ids, documents longer than a sequence are cut into full pieces and a rest, and the
histogram of piece lengths (at most as many rows as a sequence has places) is packed on its own:
lengths go longest first, each into the shortest pack that is open, and a step moves all packs of
a pattern together. A pattern then says which ranks of a length go where; pieces find their place
by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from wardstone.llm.bpe import SLICE, with_end, worker_encoder
from wardstone.llm.store import give_back, kept, slices

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"
#: Ranks below 2^RANK_BITS, lengths above them: one sorted key for both.
RANK_BITS = 44


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset) rows that place every piece.

    Sequences number from 0 without gaps. Packs that got the same lengths are one entry with a
    count; a step splits an entry at most once, so entries grow by at most two per length."""
    packs: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # used -> (count, [(length, rank, offset)])
    used: list[int] = []

    def put(at: int, count: int, entries: list):
        if at not in packs:
            packs[at] = []
            heapq.heappush(used, at)
        packs[at].append((count, entries))

    closed: list[tuple[int, list]] = []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and used and used[0] + length <= size:
            at = used[0]
            count, entries = packs[at].pop()
            if not packs[at]:
                del packs[at]
                heapq.heappop(used)
            taken = min(left, count)
            if taken < count:
                put(at, count - taken, [(n, r + taken, o) for n, r, o in entries])
            put(at + length, taken, [*entries, (length, rank, at)])
            rank, left = rank + taken, left - taken
        # none fits: a new pack is then the shortest, so it is filled before the next is opened
        fit = size // length
        for copies, count in ((fit, left // fit), (left % fit, 1)):
            if copies and count:
                entries = [(length, rank + k * count, k * length) for k in range(copies)]
                (closed.append((count, entries)) if copies * length == size else put(copies * length, count, entries))
                rank += copies * count
    rows, first = [], 0
    for count, entries in [*closed, *(p for at in sorted(packs, reverse=True) for p in packs[at])]:
        rows += [(n, r, count, first, o) for n, r, o in entries]
        first += count
    return rows


def cut(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text", end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), ids_crc32,
    doc_tokens, and its place (part, nth) among the pieces of its length. Texts do not move
    between tasks. A null text is an empty one: the end id alone."""

    def work(batches):
        part, encoder, seen = TaskContext.get().partitionId(), None, np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                encoder = encoder or worker_encoder(tokenizer)
                ids, counts = with_end(*encoder.encode(rows.column("text")), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = -(-counts // size)
                of = np.repeat(np.arange(len(counts)), cuts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
                length = np.minimum(counts[of] - start, size)
                ends = np.cumsum(length)
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
                # the nth piece of its length in this task
                order = np.argsort(length, kind="stable")
                runs = length[order]
                firsts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
                inside = np.arange(len(runs)) - np.repeat(firsts, np.diff(np.r_[firsts, len(runs)]))
                nth = np.empty(len(runs), np.int64)
                nth[order] = inside + seen[runs]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(of)).cast(pa.int64()), pa.array(start), pa.array(length), pa.array([bytes(p) for p in parts], pa.binary()),
                     pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(counts[of]), pa.array(np.full(len(of), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "nth"])
        if encoder is not None:
            encoder.forget()
            give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, PIECES)


def pack(docs: DataFrame, size: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """The pieces of `cut` with sequence_id (gapless from 0) and offset (gapless from 0 inside the
    sequence). Every id lies in exactly one piece.

    Null texts give the end id alone, null ids stay null, repeated rows are packed each, an empty
    table gives no piece, and other columns are not looked at. The pieces are written once to the
    shared folder: their ranks must not change when a task is repeated."""
    pieces = kept(cut(docs, size, id_col=id_col, text_col=text_col, end=end, tokenizer=tokenizer), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most `size` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(plan(histogram, size))
    keys = np.array([(n << RANK_BITS) + r for n, r, *_ in rows], np.int64)
    firsts, offsets = np.array([s for *_, s, _ in rows], np.int64), np.array([o for *_, o in rows], np.int64)

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length, rank):
        key = (length.to_numpy(np.int64) << RANK_BITS) + rank.to_numpy(np.int64)
        at = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + key - keys[at], "offset": offsets[at]})

    along = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("at", place("length", F.col("nth") + F.col("before")))
    return ranked.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def sequences(packed: DataFrame, size: int = 2048, pad: int = 0) -> DataFrame:
    """One row per sequence: sequence_id, used, ids (little-endian uint32). Sequences are padded
    to `size`; one that is exactly a power of two long is left as it is. At most `size` ids meet
    in a group. `packed` is a result of `pack`, whose pieces of null and empty texts and of repeated
    rows each have their own place; an empty one gives an empty result."""
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["h"]), "")
    pads = F.when(F.bit_count("used") == 1, F.lit(0)).otherwise(size - F.col("used")).cast("int")
    unit = int(pad).to_bytes(4, "little").hex().upper()
    return whole.select("sequence_id", "used", F.unhex(F.concat(joined, F.repeat(F.lit(unit), pads))).alias("ids"))
