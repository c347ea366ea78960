"""Sharding, toxicity, top-k, archives, the pipeline and the registration."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import near_components, token_ids, without_repeated_lines
from compare import compare, duck

import corpus_pipeline
from wardstone.llm import sharding, topk, toxicity, warc
from wardstone.llm.queries import ORACLES, QUERIES
from wardstone.llm.store import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    problem, n = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert problem is None and n, problem


def test_names():
    assert [next(q for q in QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)] and len(QUERIES) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "packing"]


def test_shards_hold_the_mixture(spark):
    rows = [(k, "x" * (k % 7), "hot" if k % 3 else f"s{k % 5}") for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 7).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    total = collections.Counter(r.stratum for r in got)
    each = collections.Counter((r.shard, r.stratum) for r in got)
    # sources of one size tie at every rank, which shifts a cut by half as many rows
    assert all(abs(each[s, k] - n / 7) <= 4 for s in range(7) for k, n in total.items())
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_of_odd_rows(spark, odd_docs):
    rows = sharding.shard(odd_docs, 40).collect()
    assert len(rows) == 10 and len({r.shard for r in rows}) == 10 and {r.slot for r in rows} == {0}
    null = next(r for r in rows if r.doc_id == 1)
    assert (null.size, null.text_crc32, null.law, null.grown_shard) == (16, 0, "rows", None)
    assert sharding.shard(odd_docs.limit(0), 40).count() == 0


def test_toxicity_on_held_out_rows():
    import zlib

    labels = dict(zip(*(pq.read_table("/root/testdata/sf0.1/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True))
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    rows = [(d, t, labels[d]) for d, t in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True) if d in labels]
    held = [zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows]
    fit = [r for r, h in zip(rows, held, strict=True) if not h and len(r[1]) <= 8000]
    model = toxicity.Trainer([t for _, t, _ in fit], np.array([y for *_, y in fit])).train()
    test = [r for r, h in zip(rows, held, strict=True) if h]
    found = toxicity.score_texts(pa.array([t for _, t, _ in test]), model) >= 0.5
    toxic = np.array([y for *_, y in test]) == 1
    assert found[toxic].mean() > 0.85 and found[~toxic].mean() < 0.025  # some labels are noise


def test_unseen_misspellings():
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ta", "ri", "on", "el", "mu", "sha", "ble"]) for _ in range(rng.randrange(2, 5))) for _ in range(800)]
    bad = [w[:k] + c + w[k:] for w in ("scoundrel", "blockhead") for k in range(2, 9) for c in "aeizkm"]
    rng.shuffle(bad)
    seen, unseen = bad[:60], bad[60:]

    def text(word=None):
        words = [rng.choice(plain) for _ in range(80)]
        if word:
            words[rng.randrange(80)] = word
        return " ".join(words)

    texts = [text(rng.choice(seen)) for _ in range(200)] + [text() for _ in range(200)]
    model = toxicity.Trainer(texts, np.array([1] * 200 + [0] * 200)).train()
    hits = toxicity.score_texts(pa.array([text(w) for w in unseen] * 5), model) >= 0.5
    misses = toxicity.score_texts(pa.array([text() for _ in range(60)]), model) >= 0.5
    assert hits.mean() > 0.8 and misses.mean() < 0.05


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 0), (6, 1), (6, 0), (8, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model, name="tox").collect()
    assert len(rows) == 10 and all(0 <= r.tox <= 1 for r in rows)
    none = toxicity.train(odd_docs, labels.limit(0))
    assert {round(r.tox, 3) for r in toxicity.score(odd_docs.filter("doc_id = 4"), none, name="tox").collect()} == {0.5}
    assert toxicity.score(odd_docs.limit(0), model, name="tox").count() == 0


def plain_score(text, model):
    """The score of one text, word by word and window by window."""
    mask, at = (1 << 64) - 1, []
    for word in (text or "").lower().split():
        word = word.strip(".,;:!?\"'()[]{}<>*#&$%-_`~/\\|+=@^")
        if not word:
            continue
        marked, ids = f"<{word}>", []
        for n in (3, 4, 5, 6):
            for k in range(len(marked) - n + 1):
                h = 0
                for c in marked[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) & mask
                ids.append(((h + n) * 0x9E3779B97F4A7C15 & mask) >> 46)
        ids.append(toxicity.hash_word(marked))
        at.append((sum(model.weights[k] for k in ids), len(ids)))
    if not at:
        return 1 / (1 + math.exp(30))
    windows = [at[k : k + 5] for k in range(max(1, len(at) - 4))]
    best = max(sum(s for s, _ in w) / sum(n for _, n in w) for w in windows)
    return 1 / (1 + math.exp(-max(-30, min(30, (best + model.bias) * model.scale + model.offset))))


def test_scores_like_plain_windows(docs_001):
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.1, 2.0, -1.0)
    texts = [t for _, t in docs_001[:25]] + [None, "", " \n ", "*** --", "one", "a b c d e", "a b c d e f"]
    got = toxicity.score_texts(pa.array(texts, pa.large_string()), model)
    assert np.allclose(got, [plain_score(t, model) for t in texts], rtol=1e-9)


def test_equal_texts_get_equal_scores(docs_001):
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.0, 1.0, 0.0)
    texts = [t for _, t in docs_001[:40]] + ["", None, "--", "the end of the text"]
    whole = toxicity.score_texts(pa.array(texts, pa.large_string()), model).tolist()
    alone = [toxicity.score_texts(pa.array([t], pa.large_string()), model)[0] for t in texts]
    assert whole == alone and toxicity.score_texts(pa.array(texts[::-1], pa.large_string()), model).tolist() == alone[::-1]
    assert whole[40] == whole[41] == whole[42]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(3000)]
    rows += [(50, [1.0] * 3), (51, [2.0] * 3), (52, None), (53, [None] * 16), (54, [float("nan")] * 16), (None, [1.0] * 16), (100, [float("inf")] * 16), (10000, []), (10001, [])]
    rows += [(20000 + i, [0.5] * 16) for i in range(1500)]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for i, v in good:
        if i % 50 == 0:
            want[i] += [(int(v @ w), j) for j, w in good if j != i and len(w) == len(v)]
    for i, found in want.items():
        assert sorted(got[i]) == [(k + 1, j, s) for k, (s, j) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:5])]
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_top_k_of_many_queries(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-300, 300, (2600, 8))
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(vectors)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1), 2, every=1).collect()
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -(10**9))
    assert len(got) == 5200 and all(r.score == scores[r.query_id, r.vec_id] for r in got)
    best = np.sort(scores, axis=1)[:, ::-1]
    assert all(r.score == best[r.query_id, r.rank - 1] for r in got)


def test_archives(spark):
    big = "x" * 500
    rows = [(1, "http://a/b%20c\r\nX: y", "<p>" + big), (2, None, "<p>" + big), (3, "u", None), (4, "é", "<p>" + big), (None, "n", "<p>" + big), (5, "", "short"), (6, "s", "short"), (1, "r", "<p>" + big), (7, "long", "é\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    files = warc.write_warc(pages, shared_folder(spark, "w"))
    got = warc.read_warc(files).collect()
    assert {(r.page_id, r.url, r.record_type, r.refers_to) for r in got} == {
        (p, u, "revisit" if h == "<p>" + big and p != 1 else "response", 1 if h == "<p>" + big and p != 1 else None) for p, u, h in rows}
    for r in got:
        html = next(h or "" for p, u, h in rows if (p, u) == (r.page_id, r.url))
        assert r.payload_bytes == len(html.encode()) and (r.record_type == "revisit" or r.payload == html.encode())
    assert warc.read_warc(warc.write_warc(pages.limit(0), shared_folder(spark, "w"))).count() == 0


def test_damaged_archives():
    import hashlib
    import io
    import zlib

    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(good * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(good + good[:40])))
    plain = zlib.decompress(good, 31)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(plain.replace(b"\r\n\r\npayload", b"\r\n\r\npaylord"))
    with pytest.raises(ValueError, match="long"):
        warc.parse(plain[:-1])


def test_pipeline(spark, docs_001):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    assert len(rows) > 0.8 * len(docs_001)
    kept = without_repeated_lines(rows)
    component, _ = near_components(sorted(kept.items()))
    left = [(d, kept[d]) for d, _ in rows if component[d] == d]
    ids = token_ids([t for _, t in left], 1)
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(x) for (d, _), x in zip(left, ids, strict=True)}


def test_pipeline_of_odd_rows(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage."""
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("n_chars", F.lit(-1).cast("bigint")).withColumn("lang", F.lit(None).cast("string"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, SF)
            if k < 3:
                assert now.columns == docs.columns and now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            if empty:
                assert now.count() == 0
            elif k == 0:
                assert now.count() == 10
            elif k == 1:
                texts = sorted(((r.doc_id, r.text, r.n_chars) for r in now.collect()), key=str)
                want = [(r.doc_id, "" if r.doc_id == 7 else r.text) for r in docs.collect()]
                assert texts == sorted(((d, t, None if t is None else len(t)) for d, t in want), key=str)
            elif k == 2:
                assert sorted((r.doc_id for r in now.collect()), key=str) == [1, 4, 5, 6, 8, None]
            else:
                left = [r.text for r in before.collect()]
                assert sum(r.length for r in now.collect()) == sum(len(x) for x in token_ids(left, 1))
