"""Token ids as binary files, compressed by an adaptive context-mixing range coder.

File: blocks, then the table of documents, then a fixed-size tail.

    block    magic "WTB1", ids, lanes, vocabulary, payload bytes, crc32(ids), crc32(payload)
             as little-endian uint32, then the payload
    table    int64 document ids, uint8 flags (1: the id is null), uint64 token counts, zlib
    tail     uint64 offset of the table, uint64 documents, uint64 ids, crc32(table), magic "WTF1"

Every block starts from nothing: no model, range or context crosses its border, so blocks decode
alone and a damaged one harms no other. Inside a block the ids are cut into equal lanes, each with
a range of its own; one step codes the next id of every lane, so numpy does the arithmetic. The
models are shared by the lanes and adapt after every step:

    order 2  the id that last followed this pair of ids (hashed), with a confidence
    order 1  the id that last followed this id, with a confidence
    order 0  counts of all ids of the block so far

How often predictions of a confidence came true sets their shares of the range; order 0 fills the
rest, which is never less than 1/16. Both directions run the same integer arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from wardstone.llm.bpe import SLICE, with_end, worker_encoder
from wardstone.llm.store import kept_rows, new_file, open_new, open_old, slices

BLOCK_MAGIC, FILE_MAGIC = b"WTB1", b"WTF1"
HEAD, TAIL = "<4sIIIIII", "<QQQI4s"
HEAD_SIZE, TAIL_SIZE = struct.calcsize(HEAD), struct.calcsize(TAIL)
#: Ids of a full block, and steps of its lanes.
BLOCK_IDS, STEPS = 1 << 20, 256
TOTAL_BITS, BASE_BITS = 24, 20
#: Order-0 shares are computed anew before these steps.
REFRESH = frozenset((1, 2, 4, 8, 16, 32, 64, 128, 192))
WORD = np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)


class Models:
    """What coder and decoder both know; `zones` before a step, `learn` after it."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        self.bits = max(8, min(19, (lanes * STEPS).bit_length() - 1))
        # the id seen last, times 8, plus a confidence of 0 to 7
        self.next1, self.next2 = np.zeros(vocabulary, np.int64), np.zeros(1 << self.bits, np.int64)
        self.seen = np.zeros((128, 3), np.int64)
        self.counts = np.zeros(vocabulary, np.int64)
        self.uncounted: list[np.ndarray] = []
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.step = 0
        self._base()

    def _base(self):
        """Order-0 shares: at least 1 each, 2^BASE_BITS together."""
        if self.uncounted:
            self.counts += np.bincount(np.concatenate(self.uncounted), minlength=self.vocabulary)
            self.uncounted = []
        spare = (1 << BASE_BITS) - self.vocabulary
        total = int(self.counts.sum())
        shares = np.ones(self.vocabulary, np.int64)
        if total:
            shares += self.counts * spare // total
        else:
            shares += spare // self.vocabulary
        shares[int(shares.argmax())] += (1 << BASE_BITS) - int(shares.sum())
        self.ends = np.concatenate([[0], np.cumsum(shares)])
        self.inverse = None

    def symbol(self, share: np.ndarray) -> np.ndarray:
        if self.inverse is None:
            self.inverse = np.repeat(np.arange(self.vocabulary, dtype=np.int32), np.diff(self.ends))
        return self.inverse[share].astype(np.int64)

    def zones(self):
        """Predictions of order 2 and 1, and the sizes of their parts of the range."""
        if self.step in REFRESH:
            self._base()
        hashed = ((self.last * 0x2545F491 + self.before * 0x9E3779B1) & 0xFFFFFFFF) * 0x85EBCA6B
        self.slot = ((hashed >> 11) ^ hashed) & ((1 << self.bits) - 1)
        self.entry2, self.entry1 = self.next2[self.slot], self.next1[self.last]
        self.guess2, self.guess1 = self.entry2 >> 3, self.entry1 >> 3
        self.cell = ((self.entry2 & 7) * 8 + (self.entry1 & 7)) * 2 + (self.guess2 == self.guess1)
        free = (1 << TOTAL_BITS) - (1 << BASE_BITS)
        n = self.seen
        total = n.sum(1) * 2 + 4
        part2, part1 = free * (n[:, 0] * 2 + 1) // total, free * (n[:, 1] * 2 + 1) // total
        part1[1::2] = 0
        return self.guess2, self.guess1, part2[self.cell], part1[self.cell]

    def learn(self, ids: np.ndarray, rest: int | None = None):
        live = slice(None) if rest is None else slice(0, rest)
        ids = ids[live]
        slot, last = self.slot[live], self.last[live]
        hit2, hit1 = self.guess2[live] == ids, self.guess1[live] == ids
        outcome = np.where(hit2, 0, np.where(hit1, 1, 2))
        self.seen += np.bincount(self.cell[live] * 3 + outcome, minlength=384).reshape(128, 3)
        fresh = ids * 8 + 1
        for nexts, at, entry, hit in ((self.next2, slot, self.entry2[live], hit2), (self.next1, last, self.entry1[live], hit1)):
            sure = entry & 7
            nexts[at] = np.where(hit, entry + (sure < 7), np.where(sure > 1, entry - sure + (sure >> 1), fresh))
        self.uncounted.append(ids)
        self.before, self.last = self.last, self.last.copy()
        self.last[live] = ids
        self.step += 1


def lanes_of(n: int) -> int:
    return max(1, -(-n // STEPS))


def grid(ids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Ids by step and lane. Lane i holds ids i*steps .. ; the last lanes may be shorter: the lanes
    that still run at a step are always the first ones."""
    n = len(ids)
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    full = n - lanes * (steps - 1)  # lanes that run all steps; the others run one less
    return np.concatenate([[0], np.cumsum(np.where(np.arange(lanes) < full, steps, steps - 1))]), steps, full


def encode_block(ids: np.ndarray) -> bytes:
    """One block from uint32 ids (at least one)."""
    ids64 = ids.astype(np.int64)
    vocabulary = int(ids64.max()) + 1
    if vocabulary > 1 << (BASE_BITS - 1):
        raise ValueError(f"ids must be below {1 << (BASE_BITS - 1)}")
    starts, steps, full = grid(ids)
    lanes = len(starts) - 1
    models = Models(lanes, vocabulary)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, used = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    for t in range(steps):
        live = full if t == steps - 1 else lanes
        guess2, guess1, part2, part1 = (x[:live] for x in models.zones())
        x = ids64[starts[:live] + t]
        hit2 = guess2 == x
        hit1 = (guess1 == x) & ~hit2
        rest = (1 << TOTAL_BITS) - part1 - part2
        from0, to0 = (rest * models.ends[x]) >> BASE_BITS, (rest * models.ends[x + 1]) >> BASE_BITS
        start = np.where(hit2, 0, np.where(hit1, part2, part1 + part2 + from0))
        share = np.where(hit2, part2, np.where(hit1, part1, to0 - from0))
        unit = size[:live] >> np.uint64(TOTAL_BITS)
        low[:live] += unit * start.astype(np.uint64)
        size[:live] = unit * share.astype(np.uint64)
        short = np.flatnonzero(size[:live] <= LOW32)
        if len(short):
            lo, sz = low[short], size[short]
            torn = (lo >> WORD) != ((lo + sz - np.uint64(1)) >> WORD)
            sz = np.where(torn, (LOW32 + np.uint64(1)) - (lo & LOW32), sz)
            words[short, used[short]] = (lo >> WORD).astype(np.uint32)
            used[short] += 1
            low[short], size[short] = lo << WORD, sz << WORD
        models.learn(np.pad(x, (0, lanes - live)) if live < lanes else x, live if live < lanes else None)
    # one word inside the last range; the decoder reads zeros after it
    top = (low >> WORD) + ((low & LOW32) != 0).astype(np.uint64)
    words[np.arange(lanes), used] = top.astype(np.uint32)
    used += 1
    packed = words[np.arange(steps + 2) < used[:, None]]
    payload = used.astype("<u2").tobytes() + packed.astype("<u4").tobytes()
    plain = ids.astype("<u4").tobytes()
    return struct.pack(HEAD, BLOCK_MAGIC, len(ids), lanes, vocabulary, len(payload), zlib.crc32(plain), zlib.crc32(payload)) + payload


def decode_block(head: bytes, payload: bytes) -> np.ndarray:
    magic, n, lanes, vocabulary, length, crc_ids, crc_payload = struct.unpack(HEAD, head)
    if magic != BLOCK_MAGIC or len(payload) != length or zlib.crc32(payload) != crc_payload:
        raise ValueError("damaged block")
    ids = np.zeros(n, np.int64)
    starts, steps, full = grid(ids)
    used = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u4", offset=2 * lanes), np.zeros(2, np.uint32)]).astype(np.uint64)
    ends = np.cumsum(used)
    at = ends - used
    code = words[at] << WORD
    at += 1
    more = at < ends
    code |= np.where(more, words[at], np.uint64(0))
    at += 1
    models = Models(lanes, vocabulary)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    one, most = np.uint64(1), (1 << TOTAL_BITS) - 1
    for t in range(steps):
        live = full if t == steps - 1 else lanes
        guess2, guess1, part2, part1 = (x[:live] for x in models.zones())
        unit = size[:live] >> np.uint64(TOTAL_BITS)
        value = np.minimum(((code[:live] - low[:live]) // unit).astype(np.int64), most)
        zone1 = part2 + part1
        rest = (1 << TOTAL_BITS) - zone1
        under = np.maximum(value - zone1, 0)
        miss = value >= zone1
        x = np.where(value < part2, guess2, guess1)
        where = np.flatnonzero(miss)
        x[where] = models.symbol((((under[where] + 1) << BASE_BITS) - 1) // rest[where])
        from0, to0 = (rest * models.ends[x]) >> BASE_BITS, (rest * models.ends[x + 1]) >> BASE_BITS
        start = np.where(miss, zone1 + from0, np.where(value < part2, 0, part2))
        share = np.where(miss, to0 - from0, np.where(value < part2, part2, part1))
        low[:live] += unit * start.astype(np.uint64)
        size[:live] = unit * share.astype(np.uint64)
        short = np.flatnonzero(size[:live] <= LOW32)
        if len(short):
            lo, sz = low[short], size[short]
            torn = (lo >> WORD) != ((lo + sz - one) >> WORD)
            sz = np.where(torn, (LOW32 + one) - (lo & LOW32), sz)
            low[short], size[short] = lo << WORD, sz << WORD
            source = at[short]
            code[short] = (code[short] << WORD) | np.where(source < ends[short], words[np.minimum(source, len(words) - 1)], np.uint64(0))
            at[short] += 1
        ids[starts[:live] + t] = x
        models.learn(np.pad(x, (0, lanes - live)) if live < lanes else x, live if live < lanes else None)
    out = ids.astype("<u4")
    if zlib.crc32(out.tobytes()) != crc_ids:
        raise ValueError("ids do not match their checksum")
    return out


class Writer:
    """Appends documents to an open file; full blocks leave memory at once."""

    def __init__(self, stream):
        self.stream, self.waiting, self.held, self.written, self.ids = stream, [], 0, 0, 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray):
        self.docs += doc_ids
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK_IDS:
            self._blocks(BLOCK_IDS)

    def _blocks(self, least: int):
        flat, at = np.concatenate(self.waiting), 0
        while len(flat) - at >= least and at < len(flat):
            self._put(encode_block(flat[at : at + BLOCK_IDS]))
            at += BLOCK_IDS
        self.waiting = [flat[at:]]
        self.held = max(0, len(flat) - at)

    def _put(self, raw: bytes):
        self.stream.write(raw)
        self.written += len(raw)

    def close(self):
        if self.held:
            self._blocks(1)
        table = zlib.compress(
            np.array([d or 0 for d in self.docs], "<i8").tobytes()
            + np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(self.counts, "<u8").tobytes(), 1)
        at = self.written
        self._put(table)
        self._put(struct.pack(TAIL, at, len(self.docs), self.ids, zlib.crc32(table), FILE_MAGIC))
        self.stream.close()


class Reader:
    def __init__(self, stream):
        self.stream = stream
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        stream.seek(size - TAIL_SIZE)
        self.table_at, docs, self.ids, crc, magic = struct.unpack(TAIL, stream.read(TAIL_SIZE))
        if magic != FILE_MAGIC:
            raise ValueError("not a token file")
        stream.seek(self.table_at)
        table = stream.read(size - TAIL_SIZE - self.table_at)
        if zlib.crc32(table) != crc:
            raise ValueError("damaged table of documents")
        raw = zlib.decompress(table)
        known, null = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs)
        self.docs = [None if z else int(d) for d, z in zip(known, null, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)

    def blocks(self) -> Iterator[np.ndarray]:
        at = 0
        while at < self.table_at:
            self.stream.seek(at)
            head = self.stream.read(HEAD_SIZE)
            length = struct.unpack(HEAD, head)[4]
            yield decode_block(head, self.stream.read(length))
            at += HEAD_SIZE + length

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray, bool]]:
        """(doc_id, ids before it in this file, a run of its ids, whether the run ends it)."""
        blocks = self.blocks()
        held, at, before = np.zeros(0, np.uint32), 0, 0
        for doc, count in zip(self.docs, self.counts.tolist(), strict=True):
            left = count
            while True:
                run = held[at : at + left]
                at += len(run)
                left -= len(run)
                yield doc, before, run, left == 0
                if not left:
                    break
                held, at = next(blocks), 0
            before += count


WRITTEN = "part int, path string, docs bigint, ids bigint, bytes bigint"
DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_tokens(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, tokenizer: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode every text, append the end id, and write token files in ascending id order: file k
    holds the k-th range of ids. Returns one row per file (part, path, docs, ids, bytes).

    Null texts are empty (the end id only); null ids come first; rows with equal ids are ordered
    by text. An empty table writes no file. Other columns are not looked at. A task streams: it
    holds a slice of texts and at most one block of ids."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches):
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                if writer is None:
                    encoder, path = worker_encoder(tokenizer), new_file(folder, part, ".wtb")
                    writer = Writer(open_new(path))
                ids, counts = with_end(*encoder.encode(piece.column("text")), end)
                writer.add(piece.column("doc_id").to_pylist(), ids, counts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "docs": [len(writer.docs)], "ids": [writer.ids], "bytes": [writer.written]})

    return kept_rows(ordered.mapInArrow(work, WRITTEN))


def read_tokens(files: DataFrame, work, schema: str) -> DataFrame:
    """Run `work(reader, ids before the file)` on every file of `write_tokens`; it yields record
    batches. What lies before a file comes from one row per file, whose number is that of the
    writing tasks, so the sum over all files is small whatever the input."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(starts), "part").select("path", "before")

    def each(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with open_old(path) as stream:
                    yield from work(Reader(stream), first)

    return placed.mapInArrow(each, schema)


def document_digests(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def work(reader, first):
        rows, crc = [], 0
        counts = iter(reader.counts.tolist())
        for doc, before, run, last in reader.documents():
            crc = zlib.crc32(run.astype("<u4").tobytes(), crc)
            if last:
                rows.append((doc, first + before, next(counts), crc))
                crc = 0
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return read_tokens(files, work, DIGESTS)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
