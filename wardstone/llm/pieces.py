"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three parts are compiled from a model file: the normaliser (dummy prefix, spaces written as U+2581,
extra spaces), the pieces (an automaton whose final states emit an id), and byte fallback (a character no
piece spells emits its UTF-8 bytes). They are composed with an input, and the cheapest path in the
tropical semiring is taken: an arc costs the negative score of its piece, costs add along a path,
the least is kept.

The models here are merge models (BPE), for which the sum of scores alone does not choose the
pieces. What does is which piece may follow which: a sequence of pieces is what merging gives
exactly if every two neighbours are what merging gives for their own concatenation. So the state of
the piece transducer is the last piece, arcs that no merge would leave side by side are not there,
and the path that stays is the encoding. The test of a pair runs the merges on its few characters
and is remembered.

No piece has a space mark behind another character (checked when compiling), so a text is composed
stretch by stretch, and paths of stretches are remembered.
"""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from wardstone.llm.bpe import Stretches, gather
from wardstone.llm.store import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and the model type, as numbered in the file format.
NORMAL, UNKNOWN, BYTE, USER, BPE = 1, 2, 6, 4, 2
DIGESTS = "doc_id bigint, n_ids bigint, n_fallback bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean"


class Transducer(Stretches):
    lead, space, odd_first = MARK, MARK, True

    def __init__(self, path: str | None = None):
        super().__init__()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(Path(path or public_tokenizers.path(MODEL)).read_bytes())
        self.rules = model.normalizer_spec
        if self.rules.precompiled_charsmap or not self.rules.escape_whitespaces or not self.rules.add_dummy_prefix:
            raise ValueError("this normaliser is not compiled here")
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge model with byte fallback is needed")
        self.spelled = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(p.type == USER for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces must not hold a space mark behind another character")
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            self.automaton.add_word(piece, (k, len(piece), -self.scores[k]))
        self.automaton.make_automaton()
        self.unspelled = re.compile("([^" + re.escape("".join(p for p in self.ids if len(p) == 1)) + "]+)")
        self.side_by_side: dict[int, bool] = {}
        content = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.content = np.frombuffer(b"".join(content), np.uint8)
        self.content_lengths = np.array(list(map(len, content)), np.int64)
        self.content_starts = np.cumsum(self.content_lengths) - self.content_lengths

    # encoding

    def normal(self, text: str) -> str:
        """The normaliser's output."""
        if self.rules.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK + text.replace(" ", MARK)) if text else ""

    def may_follow(self, left: int, right: int) -> bool:
        """Do merges on the characters of two pieces end with these two pieces?"""
        if len(self.side_by_side) > 1_000_000:
            self.side_by_side.clear()
        found = self.side_by_side[left << 32 | right] = self._apart(self.spelled[left], self.spelled[right])
        return found

    def _apart(self, left: str, right: str) -> bool:
        parts, at = [*left, *right], len(left)
        while True:
            best = None
            for k in range(len(parts) - 1):
                merged = self.ids.get(parts[k] + parts[k + 1])
                if merged is not None and (best is None or self.scores[merged] > best[0]):
                    best = (self.scores[merged], k)
            if best is None:
                return at == 1 and len(parts) == 2
            k = best[1]
            if k == at - 1:  # this merge crosses the border
                return False
            at -= k < at
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def path(self, stretch: str) -> tuple[int, ...]:
        """Ids on the cheapest path through the composition with a normalised stretch."""
        if not self.unspelled.search(stretch):
            return tuple(self._spelled_path(stretch))
        out: list[int] = []  # no merge touches the bytes of a character that no piece spells
        for part in self.unspelled.split(stretch):
            out += self._spelled_path(part) if part and part[0] in self.ids else [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _spelled_path(self, stretch: str) -> list[int]:
        # A state is a position and the last piece (-1: none). What is before a position has one
        # encoding, so one state of each position is alive.
        n, known = len(stretch), self.side_by_side.get
        last, cost, back = [-1] * (n + 1), [float("inf")] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for end, (k, width, weight) in self.automaton.iter(stretch):  # by end, all that end there
            end += 1
            at = end - width
            here = cost[at] + weight
            if here >= cost[end]:
                continue
            left = last[at]
            if left >= 0:
                allowed = known(left << 32 | k)
                if not (self.may_follow(left, k) if allowed is None else allowed):
                    continue
            last[end], cost[end], back[end] = k, here, at
        out: list[int] = []
        at = n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def alone(self, text: str) -> bytes:
        return self.remember(text, self.path)

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self.remember(part, self.path) for part in re.findall(f"{MARK}+[^{MARK}]*", self.normal(text))]), np.uint32)

    def odd(self, word: str) -> bool:
        return not word or MARK in word

    # decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The transducer read backwards: UTF-8 of each run of ids, without the dummy prefix."""
        lengths = self.content_lengths[ids]
        raw = gather(self.content, self.content_starts[ids], lengths).tobytes()
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)].tolist()
        return [raw[a:b].removeprefix(b" ") for a, b in zip([0, *ends], ends, strict=False)]


def worker_transducer(path: str | None = None) -> Transducer:
    """The worker process's transducer of a model file (compare `bpe.worker_encoder`)."""
    kept = vars(sentencepiece).setdefault("_wardstone_transducers", {})
    if path not in kept:
        kept[path] = Transducer(path)
    return kept[path]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian uint32): the pieces of every whole text. Null and empty texts
    have none; other columns are not looked at."""

    def work(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, counts = worker_transducer(model).encode(rows.column("text"))
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Bytes that are no UTF-8 become U+FFFD; null ids a null."""

    def work(batches):
        for batch in batches:
            for rows in slices(batch, "ids"):
                raw = [x or b"" for x in rows.column("ids").to_pylist()]
                counts = np.array([len(x) // 4 for x in raw], np.int64)
                texts = worker_transducer(model).decode(np.frombuffer(b"".join(raw), "<u4"), counts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([None if z is None else t.decode("utf-8", "replace") for t, z in zip(texts, rows.column("ids").to_pylist(), strict=True)], pa.string())],
                    names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def digests(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """Columns of DIGESTS: pieces, byte pieces and checksum of every text's ids, the checksum of
    the text decoded from them, and whether that is the text itself."""

    def work(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                transducer = worker_transducer(model)
                ids, counts = transducer.encode(rows.column("text"))
                texts = transducer.decode(ids, counts)
                fallback = np.isin(ids, list(transducer.bytes.values()))
                before = np.r_[0, np.cumsum(fallback)]
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                same = [t == (x or "").encode("utf-8", "surrogatepass") for t, x in zip(texts, rows.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts), pa.array(before[ends] - before[ends - counts]), pa.array(crcs, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(same)],
                    names=[f.split()[0] for f in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, DIGESTS)
