"""Near-duplicates, line dedup and fingerprints against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import levenshtein, near_components, without_like_lines, without_repeated_lines

from wardstone.llm import components, fingerprints, linededup, neardedup
from wardstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(seed, n=250):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


def partition(pairs):
    groups = {}
    for node, root in pairs:
        groups.setdefault(root, {root}).add(node)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(400)] + [(7, 7)]
    got = partition((r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)).collect())
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert got == partition(label.items())
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("visitors", [20_000, 3])
def test_anchor_links_lose_nothing(spark, visitors, monkeypatch):
    monkeypatch.setattr(neardedup, "VISITORS", visitors)
    monkeypatch.setattr(neardedup, "SHARE", 64 if visitors > 3 else 1)
    fps = clustered(3)
    edges = neardedup.links(spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")).collect()
    array = np.array(fps, np.uint64)
    pairs = [(fps[i], fps[int(j)]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 4)]

    def close(links):
        label = {x: x for x in fps}
        changed = True
        while changed:
            changed = False
            for a, b in links:
                m = min(label[a], label[b])
                changed |= label[a] != m or label[b] != m
                label[a] = label[b] = m
        return label

    assert close([(e.a % 2**64, e.b % 2**64) for e in edges]) == close(pairs)


def test_near_dedup_query(spark, docs_001):
    want, fps = near_components(docs_001)
    rows = QUERIES["op9_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.component_id, int(r.fingerprint, 16)) for r in rows} == {d: (want[d], fps[d]) for d, _ in docs_001}


def test_near_dedup_of_odd_rows(spark, odd_docs):
    rows = neardedup.near_groups(odd_docs).collect()
    assert len(rows) == 10
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.fp for r in blank} == {0} and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    stays = neardedup.drop_near_duplicates(odd_docs)
    assert stays.columns == odd_docs.columns
    ids = [r.doc_id for r in stays.collect()]
    assert sorted(ids, key=str) == [1, 4, 5, 6, 8, None]
    assert neardedup.drop_near_duplicates(odd_docs.limit(0)).count() == 0


def test_one_id_on_unlike_texts_loses_no_group(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"{x}{rng.randrange(5000)}" for _ in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in neardedup.drop_near_duplicates(df).collect()) == sorted([(1, a), (1, b)])


def test_near_copies_are_one_group(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(k, " ".join(words[:k] + [f"new{k}"] + words[k + 1 :])) for k in range(40)] + [(100 + k, " ".join(f"x{rng.randrange(5000)}" for _ in range(300))) for k in range(20)]
    groups = {r.doc_id: r.component_id for r in neardedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert groups == near_components(rows)[0]
    assert all(groups[100 + k] == 100 + k for k in range(20)) and len({groups[k] for k in range(40)}) < 5


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(2))
        assert linededup.edit_distance(a, b) == levenshtein(a, b)
        most = rng.randrange(8)
        bounded = linededup.edit_distance(a, b, most)
        assert bounded == levenshtein(a, b) or min(bounded, levenshtein(a, b)) > most


def test_crowded_cluster_is_verified_together(monkeypatch):
    """Lines that all look near are linked as by single distances, but few are measured alone."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde é日 ") for _ in range(rng.choice([20, 40, 90, 330, 800]))) for _ in range(150)]
    for k in range(0, 150, 2):
        copy = list(texts[k])
        for _ in range(rng.randrange(1, len(copy) // 4)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    want = {(a, b) for a in range(len(texts)) for b in range(a) if linededup.alike(texts[a], texts[b], 0.8)}
    assert 30 < len(want) < 75
    calls = []
    alike = linededup.alike
    monkeypatch.setattr(linededup, "alike", lambda *x: calls.append(x) or alike(*x))
    n = len(texts)
    a, b = linededup.verified(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), texts, 0.8)
    assert {tuple(sorted(p, reverse=True)) for p in zip(a.tolist(), b.tolist())} == want
    assert len(calls) < 200


def test_line_dedup_query(spark, docs_001):
    want = without_repeated_lines(docs_001)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__lines_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == want
    dropped = {r.doc_id: r.lines_dropped for r in QUERIES["op5_line_dedup"](spark, SF).collect()}
    assert dropped == {d: t.count("\n") - want[d].count("\n") + (1 if t and not want[d] and dropped[d] else 0) for d, t in docs_001}


@pytest.mark.parametrize(("crowd", "members"), [(4000, 10_000), (15, 10)])
def test_fuzzy_lines(spark, crowd, members, monkeypatch):
    monkeypatch.setattr(linededup, "MEMBERS", members)
    monkeypatch.setattr(linededup, "SHARE", 1 if members == 10 else 64)
    rng = random.Random(7)
    base = ["the quick brown fox jumps over the lazy dog and then it sleeps for a while near the old tree number one two three",
            "another line about something else entirely with several more words than the former one had in it today or so"]

    def changed(line):
        words = line.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["cat", "fish", "x", "thee", "owl"])
        return " ".join(words)

    rows = [(k, "\n".join(changed(rng.choice(base)) if rng.random() < 0.7 else f"unique {rng.random()} line {k}" for _ in range(4))) for k in range(120)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "***\n---\n***")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd).collect()}
    assert got == without_repeated_lines(rows)


def test_line_dedup_leaves_only_its_list(spark, tmp_path, monkeypatch):
    """Of what the search writes only the list of lines stays, which the result reads, and of the
    keys of all blocks no more than a turn's are shuffled at once."""
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(5))) for k in range(60)]
    rows += [(100 + k, f"{t} more") for k, t in rows[:20]]
    folders, turns, kept_rows = [], [], linededup.kept_rows
    monkeypatch.setattr(linededup, "shared_folder", lambda _, name: folders.append(f"{tmp_path}/{name}") or folders[-1])
    monkeypatch.setattr(linededup, "kept", lambda df, name: linededup.kept_below(df, f"{tmp_path}/{name}"))
    monkeypatch.setattr(linededup, "kept_rows", lambda df: turns.append(df) or kept_rows(df))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert folders == [f"{tmp_path}/line-dedup"] and len(turns) == linededup.TURNS
    assert [p.name for p in tmp_path.iterdir()] == ["repeated-lines"]
    assert {r.doc_id: r.text for r in got.collect()} == without_like_lines(rows)


def test_blocks_in_turns_give_all_keys():
    rng = random.Random(9)
    _, sig = linededup.sketches([" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(200)])
    pairs = [{*zip(*(x.tolist() for x in linededup.block_keys(sig, range(k, linededup.BLOCKS, linededup.TURNS))))} for k in range(linededup.TURNS)]
    everything = [*zip(*(x.tolist() for x in linededup.block_keys(sig)))]
    assert set().union(*pairs) == set(everything)
    assert sum(map(len, pairs)) == len(set(everything)) and max(map(len, pairs)) < len(everything) / 2


def test_lines_of_a_crowded_key_all_meet():
    fp, key = np.arange(-40, 40), np.repeat(np.array([-5, 0, 7, 9], np.int32), 20)
    at = list(linededup.meetings(fp, key, np.array([-5, 7], np.int32), np.array([3, 4])))
    assert sorted(zip(*(x.tolist() for x in at[0]))) == [(f, k) for f, k in zip(fp.tolist(), key.tolist()) if k in (0, 9)]
    places = collections.defaultdict(set)
    for own in at[1:]:
        for f, k in zip(*(x.tolist() for x in own)):
            places[f].add(k)
    for low, parts in ((-40, 3), (0, 4)):
        lines = range(low, low + 20)
        assert all(places[a] & places[b] for a in lines for b in lines) and {len(places[a]) for a in lines} == {parts}
        assert max(collections.Counter(k for a in lines for k in places[a]).values()) < 20
    assert not places.keys() & {*range(-20, 0), *range(20, 40)}
    none = list(linededup.meetings(fp, key, np.zeros(0, np.int32), np.zeros(0, np.int64)))
    assert len(none) == 1 and none[0][0].tolist() == fp.tolist()


def test_parts_of_a_crowded_cluster_are_written_once(spark, tmp_path, monkeypatch):
    """However many parts a part meets, its texts lie on the disk once."""
    rng = random.Random(12)
    base = [f"v{rng.randrange(900)}" for _ in range(30)]
    rows = [(k, " ".join([*base[: k % 30], f"n{k}", *base[k % 30 + 1 :], *["end"] * (k % 7)])) for k in range(200)]
    monkeypatch.setattr(linededup, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(linededup, "delete", lambda *_: None)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=15)
    files = [pq.read_table(f) for f in (tmp_path / "line-dedup/parts").glob("*.parquet")]
    lines = [t for f in files for t in f["normal"].to_pylist()]
    assert len(files) > 8 and sorted(lines) == sorted(linededup.normal_line(t) for _, t in rows)
    assert {r.doc_id: r.text for r in got.collect()} == without_like_lines(rows)


@pytest.mark.parametrize("n", [20, 90])
def test_known_groups_meet_by_one_link(n):
    """Of two groups found in two parts one link is returned, of lines of one group none."""
    texts = ["the same long line of words with number " + "".join("xy"[k >> b & 1] for b in range(7)) for k in range(n)]
    fp, part = np.zeros(n, np.int64), np.arange(n) % 2
    a, b = linededup.verified(np.arange(n) + 100, fp, part, texts, 0.8, part)
    assert len(a) == 1 and {(a[0] - 100) % 2, (b[0] - 100) % 2} == {0, 1}
    assert not len(linededup.verified(np.arange(n) + 100, fp, part, texts, 0.8, np.zeros(n, np.int64))[0])
    assert len(linededup.verified(np.arange(n) + 100, fp, part, texts, 0.8)[0]) == n - 1


def test_segments_lose_no_short_pair():
    rng = random.Random(11)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(5, 25)))
        b = list(a)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c", "d"])
        a, b = sorted((a, "".join(b)), key=len)
        if a != b and len(b) <= linededup.SHORT and linededup.alike(a, b, 0.8):
            assert set(linededup.segment_keys(a, 0.8)[0]) & set(linededup.segment_keys(b, 0.8)[1]), (a, b)


def test_lines_with_one_changed_word(spark):
    """Lines of 1 to 40 words and a copy of each: a word of 10 changed beyond 4 bits of a SimHash,
    a letter of a short line, a word left out."""
    rng = random.Random(21)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))

    rows = []
    for k, n in enumerate([1, 1, 2, 2, 3, 3, 8, 10, 10, 12, 12, 15, 15, 20, 20, 30, 40] * 3):
        words = [word() for _ in range(n)]
        copy, at = words.copy(), rng.randrange(n)
        if n < 4:
            copy[at] = copy[at][:-1] + "0"
        elif k % 3:
            copy[at] = word()
        else:
            del copy[at]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(copy))]
    want = without_like_lines(rows)
    assert sum(not t for t in want.values()) > 45
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_lines_of_the_smallest_scale(spark, docs_001):
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = without_like_lines(docs_001)
    assert {d for d, t in got.items() if t != want[d]} == set()


def test_line_dedup_of_odd_rows(spark, odd_docs):
    got = linededup.dedup_lines(odd_docs)
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert texts == sorted(((r.doc_id, "" if r.doc_id == 7 else r.text) for r in odd_docs.collect()), key=str)
    assert linededup.dedup_lines(odd_docs.limit(0)).count() == 0


def plain_fingerprint(text):
    mask, votes = (1 << 64) - 1, [0] * 64
    for word, n in collections.Counter(text.lower().split()).items():
        h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word)) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & mask
        h ^= h >> 31
        for k in range(64):
            votes[k] += (1 if h >> k & 1 else -1) * n.bit_length()
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_fingerprint_query(spark, docs_001):
    got = {r.doc_id: r for r in QUERIES["op8_document_fingerprints"](spark, SF).collect()}
    order = docs_001[::-1]
    for k, (doc, text) in enumerate(order):
        following, other = order[(k + 1) % len(order)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        r = got[doc]
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (plain_fingerprint(text), plain_fingerprint(edited))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - (int(r.fingerprint, 16) ^ int(got[following].fingerprint, 16)).bit_count() / 64
        assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 64
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.15


def test_fingerprints_of_odd_rows(spark, odd_docs):
    rows = fingerprints.with_edits(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[1].fp == by[2].fp == by[3].fp == 0 and by[6].fp == by[7].fp and by[None].next_fp == by[8].fp
    assert fingerprints.with_edits(odd_docs.limit(0)).count() == 0
    one = fingerprints.with_edits(spark.createDataFrame([(5, "abc def")], "doc_id bigint, text string")).collect()
    assert one[0].next_fp == one[0].fp and one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert {r.fp for r in fingerprints.fingerprint(odd_docs.filter("doc_id < 3")).collect()} == {0}


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (2, 3), (0, 1)])
def test_search_within_radius(spark, radius, blocks):
    fps = clustered(9, 150)
    df = spark.createDataFrame([(signed(x),) for x in [*fps, fps[0]]] + [(None,)], "fp bigint")
    got = {(r.query_fp, r.fp): r.distance for r in fingerprints.within(df.limit(100), df, radius, blocks).collect()}
    asked = {r.fp for r in df.limit(100).collect()}
    assert got == {(signed(a), signed(b)): (a ^ b).bit_count() for a in fps if signed(a) in asked for b in fps if (a ^ b).bit_count() <= radius}
