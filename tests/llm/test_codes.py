"""Vector codes, the filter audit and language identification."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardstone.llm import filteraudit, languages, vectorcodes
from wardstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def coded(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, label, vector) rows -> sorted (vec_id, codes, error) and codebooks, part by part."""
    vectors = [(d, label, [math.floor(scale * x) for x in v]) for d, label, v in rows]
    width = len(vectors[0][2]) // parts
    cut = [(d, label, [v[p * width : (p + 1) * width] for p in range(parts)]) for d, label, v in vectors]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for *_, ps in cut:
                members[nearest(ps[p], books[p])[1]].append(ps[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(books[p])]
    out = []
    for d, label, ps in cut:
        found = [nearest(ps[p], books[p]) for p in range(parts)]
        out.append((d, label, [k for _, k in found], sum(e for e, _ in found)))
    return out, books


def test_codes_like_plain_rounds(spark):
    random = np.random.default_rng(3)
    centers = random.normal(size=(5, 8))
    rows = [(int(k * 3 % 400), int(k % 4), (centers[k % 5] + random.normal(size=8) * 0.1).tolist()) for k in range(300)]
    rows += [(900 + k, None, centers[0].tolist()) for k in range(150)]  # one crowded entry, ties everywhere
    rows += [(900, None, centers[0].tolist()), (None, 7, centers[1].tolist()), (None, 7, centers[1].tolist())]
    kind = "vec_id bigint, label int, embedding array<double>"
    got, books = vectorcodes.compress(spark.createDataFrame(rows, kind), entries=16)
    want, plain = coded(rows, entries=16)
    assert books.tolist() == plain
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    found = [(r.vec_id, r.label, list(r.codes), r.error) for r in got.collect()]
    assert sorted(found, key=key) == sorted(want, key=key)
    back = vectorcodes.decompress(got, books).filter("vec_id = 0").first()
    assert back.vector == [x / 1024 for p, k in enumerate(back.codes) for x in plain[p][k]]
    errors = collections.Counter()
    for r in found:
        errors[r[1]] += r[3]
    summed = vectorcodes.with_label_error(got).select("label", "label_error").distinct().collect()
    assert {r.label: r.label_error for r in summed} == dict(errors) and len(summed) == len(errors)
    for rounds in (0, 1):
        again, books = vectorcodes.compress(spark.createDataFrame(rows, kind), entries=16, rounds=rounds)
        want, plain = coded(rows, entries=16, rounds=rounds)
        assert books.tolist() == plain and sorted(r.error for r in again.collect()) == sorted(r[3] for r in want)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0, 2.0], 1, "x"), (2, None, 1, "x"), (3, [0.5, None, 1.0, 2.0], 1, "x"), (4, [nan, 0.0, 0.0, 0.0], 1, "x"), (5, [0.0, inf, 0.0, 0.0], 1, None),
            (6, [], 1, "x"), (7, [1.0], None, "x"), (8, [1.0] * 8, 2, "x"), (9, [3e38, -3e38, 0.0, -1e-9], None, "x"), (1, [0.5, -0.25, 1.0, 2.0], 1, "y")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, codes string").withColumn("error", df_none()).withColumn("at", df_none())
    got, books = vectorcodes.compress(df)
    assert sorted((r.vec_id, r.label, list(r.codes), r.error) for r in got.collect() if r.label) == [(1, 1, [0, 0, 0, 0], 0)] * 2
    assert [r.error for r in got.filter("vec_id = 9").collect()] == [0] and books.shape == (4, 3, 1)
    assert books[:, 2, 0].tolist() == [1 << 24, -(1 << 24), 0, -1]
    empty, books = vectorcodes.compress(df.limit(0))
    assert empty.count() == 0 and books.size == 0 and vectorcodes.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()
    assert vectorcodes.with_label_error(empty).count() == 0


def df_none():
    from pyspark.sql import functions as F

    return F.lit(None).cast("int")


def test_large_components_are_exact():
    random = np.random.default_rng(5)
    x, book = random.integers(-vectorcodes.CLIP, vectorcodes.CLIP, (50, 64)), random.integers(-vectorcodes.CLIP, vectorcodes.CLIP, (9, 64))
    entry, error = vectorcodes.nearest(x, book)
    for row, k, e in zip(x.tolist(), entry.tolist(), error.tolist(), strict=True):
        assert (e, k) == min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), i) for i, c in enumerate(book.tolist()))


def test_only_movers_are_shuffled(spark):
    from pyspark.sql import functions as F

    members = spark.range(100).selectExpr("0 as pos", "cast(id % 7 as int) as entry", "0 as salt", "id as rid", "id as vec_id", "0 as label", "array(1) as part").checkpoint()
    plan = vectorcodes.moved(members.withColumn("at", F.struct(F.lit(3).alias("entry"))))._jdf.queryExecution().executedPlan().toString()
    stay, go = plan.split("\n   +-")[0], plan.split("\n   +-")[-1]
    assert "Exchange" not in stay and plan.count("Exchange") == 1 and "Exchange" in go


def plain_audit(docs, labels):
    """Every order and step, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = collections.defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows[lang or ""].append((fails, d in good, d in toxic))
    out = []
    for part, members in rows.items():
        shapley = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                shapley[f] += len(gone)
                redundant = sum(m[0][f] and any(m[0][e] for e in order[: step - 1]) for m in members)
                unique = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                steps.append((part, "".join(order), step, f, len(left), len(gone), redundant, unique, sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*s, shapley[s[3]]) for s in steps]
    return sorted(out)


def test_filter_audit_of_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", odd_docs.source.alias("lang"), "size", "fp", "line", odd_docs.score.alias("toxic"))
    copies = [(k, "A copy of this text " * 50 + ("#" if k % 3 else ""), ("a", None, "")[k % 3], 1, 2, "x", 3.0) for k in range(20, 60)]
    docs = docs.union(spark.createDataFrame(copies, docs.schema))
    docs = docs.union(docs.filter("doc_id = 4"))
    labels = [(5, 1, 0), (5, 0, 1), (6, 1, 1), (21, 1, None), (22, None, 1), (None, 1, 1), (99, 1, 1)]
    got = filteraudit.filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert got.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == want
    assert filteraudit.filter_audit(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_audit_of_any_flags(spark):
    rows = [(k % 3 == 0, k % 2 == 0, None if k % 5 else True, k % 4 == 1, "p" if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "x boolean, y boolean, z boolean, w boolean, part string")
    got = filteraudit.audit(df, ["x", "y", "z"], lost=["w"]).collect()
    assert len(got) == 2 * 6 * 3 and list(got[0].asDict()) == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "w_lost", "shapley"]
    for r in got:
        left = [m for m in rows if m[4] == r.part and not any(m["xyz".index(f)] for f in r.filter_order[: r.step - 1])]
        gone = [m for m in left if m["xyz".index(r.filter)]]
        assert (r.removed, r.kept, r.w_lost) == (len(gone), len(left) - len(gone), sum(bool(m[3]) for m in gone))
    assert filteraudit.audit(df, ["x"], lost=[]).count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_orders_and_diagrams(n):
    counts = {m: (m * 7 % 5 + 1, m % 3) for m in range(1 << n) if m % 4 != 2}
    diagram, seen = filteraudit.Diagram(n, counts), []
    for level in [None, *filteraudit.plain_changes(n)]:
        if level is not None:
            diagram.swap(level)
        seen.append(tuple(diagram.order))
        for step, (var, stay, gone) in enumerate(diagram.run()):
            before = diagram.order[:step]
            alive = {m: w for m, w in counts.items() if not any(m >> b & 1 for b in before)}
            assert gone == tuple(sum(w[k] for m, w in alive.items() if m >> var & 1) for k in (0, 1))
            assert stay == tuple(sum(w[k] for m, w in alive.items() if not m >> var & 1) for k in (0, 1))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_forward_backward_like_all_paths():
    random = np.random.default_rng(2)
    counts = np.array([3, 0, 5, 1])
    spoken, transitions = random.random((9, 3)) + 0.01, random.normal(size=(3, 3))
    old, languages.CHUNK = languages.CHUNK, 2
    try:
        got = languages.posteriors(spoken, counts, transitions)
    finally:
        languages.CHUNK = old
    at = 0
    for n in counts.tolist():
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = math.prod(spoken[at + t, k] for t, k in enumerate(path)) * math.exp(sum(transitions[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                total[t, k] += weight
        assert n == 0 or np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n
    long = random.random((5000, 3)) ** 8 + 1e-9
    whole = languages.posteriors(long, np.array([5000]), transitions)
    assert np.isfinite(whole).all() and np.allclose(whole.sum(1), 1)


def test_training_follows_the_likelihood():
    random = np.random.default_rng(4)
    score, transitions = random.normal(size=(4, 6, 3)), random.normal(size=(3, 3))
    chance, pairs = languages.Trainer.expected(score, transitions)
    flat = languages.posteriors(np.exp(score - score.max(2, keepdims=True)).reshape(-1, 3), np.full(4, 6), transitions)
    assert np.allclose(chance.reshape(-1, 3), flat)
    assert np.allclose(pairs.sum(), 4 * 5) and np.allclose(pairs.sum(1), chance[:, :-1].sum((0, 1)))


ODD_TEXTS = [None, "", " \n\t ", "123 -- 456", "a\x1cb c d\x85e  f", "Ünï çödé 日本 😀 don't", "x" * 5000, "İ ǅ"]


def test_words_lie_between_white_space():
    codes, counts, spelled, letters = languages.words_of(pa.array(ODD_TEXTS))
    assert counts.tolist() == [len((t or "").split()) for t in ODD_TEXTS] == [len(re.findall(r"\S+", t or "")) for t in ODD_TEXTS]
    assert sum(codes >= 0) == sum(any(c.isalpha() for c in w) for t in ODD_TEXTS for w in (t or "").split())
    assert "don't" in spelled and letters.tolist() == [len(w) for w in spelled]
    words = [w for w in spelled if w]
    ids, sizes, keys = languages.features(words)
    for k, w in enumerate(words):
        own, n, key = languages.features([w])
        assert sizes[k] == n[0] and keys[k] == key[0] and (ids[sizes[:k].sum() : sizes[: k + 1].sum()] == own).all()


@pytest.fixture(scope="module")
def model(spark):
    return languages.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_languages(spark, model):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert len(judged) > 100 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in judged]) >= 0.98
    assert {r.lang_pred for r in got} <= {*model.languages, "und"}


def test_code_switched_words(spark, model):
    """Words of texts strung together from held-out documents get the language of their run."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang and r.text]
    by = collections.defaultdict(list)
    for r in docs:
        by[r.lang] += r.text.split()[5:45]
    runs = [(lang, by[lang][k * 40 : k * 40 + 25]) for k in range(4) for lang in sorted(by)]
    runs = [(lang, words) for lang, words in runs if len(words) == 25]
    text = "\n".join(" ".join(words) for _, words in runs)
    got = languages.spans(spark.createDataFrame([(text,), (None,), ("",)], "text string"), model).collect()
    spans = got[0].spans
    assert got[1].spans is None and got[2].spans == [] and [s.begin for s in spans] == sorted(s.begin for s in spans)
    right = total = at = 0
    for lang, words in runs:
        for w in words:
            at = text.index(w, at)
            if any(c.isalpha() for c in w):
                inside = [s for s in spans if s.begin <= at < s.stop]
                right, total = right + (len(inside) == 1 and inside[0].lang == lang), total + 1
            at += len(w)
    assert total > 200 and right / total >= 0.85


def test_languages_of_odd_rows(spark, odd_docs, model):
    odd = odd_docs.withColumn("lang_pred", odd_docs.source)
    got = languages.predict(odd, model).collect()
    assert len(got) == 10 and set(got[0].asDict()) == {*odd.columns}
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[6] == by[7] and by[5][0] in model.languages
    assert languages.predict(odd.limit(0), model).count() == 0
    nothing = languages.train(odd.withColumn("lang", odd.source).filter("doc_id is null"))
    assert nothing.languages == [] and {(r.lang_pred, r.score) for r in languages.predict(odd, nothing).collect()} == {("und", 0.0)}
    one = languages.train(odd.withColumn("lang", odd.source).filter("source = 'b'"))
    assert {r.lang_pred for r in languages.predict(odd, one).collect()} <= {"b", "und"}
    rows = languages.training_rows(odd.withColumn("lang", odd.source), longest=7, sample=1).collect()
    assert all(len(r.text) <= 7 for r in rows) and len(rows) == len({r.lang for r in rows})


def test_a_text_alone_decides(model):
    texts = ["the thing is in here", "que una casa", "x y z " * 3000, "le jardin, und das Haus"]
    alone = [languages.judged(pa.array([t]), model)[0][0].tolist() for t in texts]
    assert [languages.judged(pa.array([*texts[::-1], "more words", None]), model)[0].tolist()[k] for k in (3, 2, 1, 0)] == alone
