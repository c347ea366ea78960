"""Token files, packing and the transducer against the public libraries."""

import io
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import crc, token_ids, tokenizer
from hypothesis import given, settings, strategies as st

from wardstone.llm import packing, pieces, tokenfiles
from wardstone.llm.bpe import Encoder
from wardstone.llm.queries import QUERIES
from wardstone.llm.store import shared_folder

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b", " lead", "trail ", "a\n b", "x \n\n  y", "it's we'll 'S <|endoftext|> # ##", "日本語 テスト é è  ß", "a  b", "tab\t\tx \tq", "1 22  333,4 ;;; --", "\n", "ab\x00c \x1c d", "▁x ▁▁y",
       "a<|endoftext|>", "<|endoftext|>", "<|endoftext|> b c", "x <|endoftext|>y", "one <|endoftext|><|endoftext|> two", "<|endoftext", "endoftext|>"]


def test_encoder_equals_library():
    encoder, plain, rng = Encoder(), tokenizer(), random.Random(1)
    parts = ["tion", "the", " ", "  ", "\n", "'s", "ß", "ö", "12", "...", ",", "😀", " ", "ǅ", "Ж"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(500)]
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("ids", [[5], [0], [7] * 1000, range(600), [2, 9] * 5000])
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    raw = tokenfiles.encode_block(ids)
    head, payload = raw[: tokenfiles.HEAD_SIZE], raw[tokenfiles.HEAD_SIZE :]
    assert (tokenfiles.decode_block(head, payload) == ids).all()
    damaged = bytearray(payload)
    damaged[len(damaged) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.decode_block(head, bytes(damaged))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=900))
def test_any_ids(ids):
    raw = tokenfiles.encode_block(np.array(ids, np.uint32))
    assert tokenfiles.decode_block(raw[: tokenfiles.HEAD_SIZE], raw[tokenfiles.HEAD_SIZE :]).tolist() == ids


def test_blocks_compress_and_stand_alone():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 200_000), 50_000).astype(np.uint32)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(tokenfiles.encode_block(ids)) * 8 / len(ids) < entropy * 1.15
    kept = tokenfiles.BLOCK_IDS
    tokenfiles.BLOCK_IDS = 700
    try:
        out = io.BytesIO()
        out.close, close = lambda: None, out.close
        writer = tokenfiles.Writer(out)
        for k in range(5):
            writer.add([k, None], ids[k * 900 : k * 900 + 900], np.array([0, 900]))
        writer.close()
        reader = tokenfiles.Reader(io.BytesIO(out.getvalue()))
        assert len(list(reader.blocks())) == 7 and reader.docs == [0, None, 1, None, 2, None, 3, None, 4, None]
        assert (np.concatenate([run for *_, run, _ in reader.documents()]) == ids[:4500]).all()
        close()
    finally:
        tokenfiles.BLOCK_IDS = kept


def test_token_files(spark, docs_001):
    got = sorted(map(tuple, QUERIES["op4_token_files"](spark, SF).collect()))
    want, start = [], 0
    for (doc, _), ids in zip(docs_001, token_ids([t for _, t in docs_001], 2), strict=True):
        want.append((doc, start, len(ids), crc(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_of_odd_rows(spark, odd_docs):
    files = tokenfiles.write_tokens(odd_docs, shared_folder(spark, "t"), parts=3)
    rows = sorted(tokenfiles.document_digests(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8] and rows[1].n_tokens == rows[2].n_tokens == 1
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    empty = tokenfiles.write_tokens(odd_docs.limit(0), shared_folder(spark, "t"))
    assert empty.count() == 0 and tokenfiles.document_digests(empty).count() == 0


def check_pieces(rows, ids_of, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= size
    covered = {}
    for r in rows:
        ids = ids_of[r.doc_id]
        assert len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, spans in covered.items():
        assert sum(n for _, n in spans) == len(ids_of[doc]) * len({*spans} and [s for s, _ in spans if s == 0])
    return len(by)


def test_packing(spark, docs_001):
    ids_of = dict(zip((d for d, _ in docs_001), token_ids([t for _, t in docs_001], 1), strict=True))
    rows = QUERIES["op10_packing"](spark, SF).collect()
    n = check_pieces(rows, ids_of, 2048)
    assert n * 2048 < 1.03 * sum(map(len, ids_of.values())) and {r.doc_id for r in rows} == set(ids_of)


def test_packing_of_odd_rows(spark, odd_docs):
    packed = packing.pack(odd_docs, 64)
    rows = packed.collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    check_pieces(rows, dict(zip(texts, token_ids(texts.values(), 1), strict=True)), 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed, 64, pad=9).collect()}
    assert {len(r.ids) for r in whole.values() if r.used.bit_count() != 1} <= {256}
    for r in rows:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack(odd_docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_plan_places_each_rank_once(histogram):
    used, placed = {}, []
    for length, first, count, sequence, offset in packing.plan(histogram, 40):
        for k in range(count):
            placed.append((length, first + k))
            used.setdefault(sequence + k, []).append((offset, length))
    assert sorted(placed) == [(n, r) for n in sorted(histogram) for r in range(histogram[n])]
    assert sorted(used) == list(range(len(used)))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 40


def test_transducer_equals_library():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.Transducer(), random.Random(2)
    parts = ["tion", "the", "ing", "eu", "ß", "ö", "x", "▁", "  ", "😀", "ab", "--", "...", "0", "\n", "ll", "re"]
    texts = ODD[:14] + [" " * k + "w" for k in range(40)] + ["q" + " " * k for k in range(20)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    ids, counts = own.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n, back in zip(texts, ends, counts, own.decode(ids, counts), strict=True):
        want = library.encode(text or "")
        assert ids[end - n : end].tolist() == want, repr(text)
        assert back.decode("utf-8", "replace") == library.decode(want)


def test_sentencepiece_query(spark, docs_001):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op3_sentencepiece"](spark, SF).collect()}
    for doc, text in docs_001:
        ids = library.encode(text)
        assert (got[doc].n_ids, got[doc].ids_crc32, got[doc].round_trip) == (len(ids), crc(np.array(ids, "<u4").tobytes()), True)


def test_sentencepiece_round_trip(spark, odd_docs):
    encoded = pieces.encode(odd_docs)
    back = pieces.decode(encoded).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd_docs.collect())
    assert pieces.encode(odd_docs.limit(0)).count() == 0


def test_an_added_token_is_one_id():
    ids, counts = Encoder().encode(pa.array(["a<|endoftext|>", "plain text", "<|endoftext|>b"]))
    assert ids.tolist()[:2] == [64, 50256] and counts[0] == 2 and counts[2] == 2 and ids[-2] == 50256


def test_whole_sequences(spark, docs_001):
    """Every sequence of a whole scale, id by id: nothing lost, gapless, padded."""
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = packed.drop("ids").collect()
    whole = {d: x for (d, _), x in zip(docs_001, token_ids([t for _, t in docs_001], 1), strict=True)}
    want = {}
    for r in rows:
        want.setdefault(r.sequence_id, {})[r.offset] = whole[r.doc_id][r.start : r.start + r.length]
    got = packing.sequences(packed, pad=7).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(want)))
    for r in got:
        ids, at = np.frombuffer(bytes(r.ids), "<u4"), 0
        for offset in sorted(want[r.sequence_id]):
            own = want[r.sequence_id][offset]
            assert offset == at and (ids[at : at + len(own)] == own).all()
            at += len(own)
        assert at == r.used and (ids[at:] == 7).all() and len(ids) == (at if at & (at - 1) == 0 else 2048)
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))


def test_sequences_of_odd_rows(spark, odd_docs):
    packed = packing.pack(odd_docs, 64)
    got = packing.sequences(packed, 64).collect()
    assert sum(r.used for r in got) == sum(len(x) for x in token_ids([r.text for r in odd_docs.collect()], 1))
    assert packing.sequences(packed.limit(0), 64).count() == 0
