"""Languages of texts and of the words in them: a linear-chain conditional random field.

Words are the observations and languages the labels. A word speaks for each language by its
affixes (one to four letters at either end), its n-grams (one to four letters), itself as a whole
and the languages whose lexicon lists it; learned transitions say how readily a text changes its
language from one word to the next. Forward-backward gives the chance of each language at each
word, given the whole text, so that a word that several languages share is read by its
neighbours. The language of a text is the one with the largest share of its letters.

Documents are labelled as a whole, so training strings runs of words of documents of different
languages together: the changes inside these sequences are known.

Emissions belong to distinct words and are computed once for each. A text is cut into chunks of
words; the product of a chunk's transition matrices says what the chunk does to any message, so
messages pass from chunk to chunk first and then through all chunks at a time. That is the exact
recursion, and chunks are counted from the beginning of the text: the result depends on the text
alone, not on the rows around it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardstone.llm.store import slices

#: Hash buckets of features (a power of two), letters of affixes and n-grams.
BUCKET_BITS, LETTERS = 17, (1, 2, 3, 4)
#: Bounds of the training sample: languages (the commonest), documents of each, characters of one.
LANGUAGES, SAMPLE, LONGEST = 64, 300, 2000
#: A lexicon lists the words that so many sample documents of a language hold, commonest first.
LEXICON, SEEN_IN = 20_000, 2
#: Sequences strung together for training and their words.
SEQUENCES, WORDS = 8000, 24
#: How far one word alone may rule out a language (log), and words of a chunk.
CLIP, CHUNK = 20.0, 32
#: Distinct words whose features are held at a time, and bytes of text scored at a time.
LOT, SLICE = 10_000, 1 << 20
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Code of every word (-1: no letter in it), words per text, the distinct words (lower case,
    from the first letter to the last) and their letters. Words lie between white space."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.utf8_split_whitespace(lower)
    ends = np.asarray(split.offsets, np.int64)
    tokens = split.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(tokens.dictionary.cast(pa.large_string()), r"^\P{L}+|\P{L}+$", "").dictionary_encode()
    spelled = bare.dictionary.to_pylist()
    code = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in spelled:
        code[code == spelled.index("")] = -1
    token, counts = tokens.indices.to_numpy(zero_copy_only=False), np.diff(ends)
    blank = np.flatnonzero(pc.equal(tokens.dictionary, "").to_numpy(zero_copy_only=False))
    if len(blank):  # splitting leaves an empty token at either end of a text
        real = token != blank[0]
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        token = token[real]
    codes = code[token] if len(code) else np.zeros(0, np.int64)
    return codes, counts, spelled, np.fromiter(map(len, spelled), np.int64, len(spelled))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all words (none empty), one word after the other, how many each has, and
    a 64-bit key of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    end = start + np.repeat(lengths, lengths)
    at = np.arange(len(points))
    of = np.repeat(np.arange(len(words)), lengths)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)])
    keys = np.add.reduceat(points * powers[at - start], np.cumsum(lengths) - lengths) if len(words) else np.zeros(0, np.uint64)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        mixed = (h + np.uint64(kind * 0x1000193)) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    ids, owners = [bucket(keys, 0)], [np.arange(len(words))]
    h = np.zeros(len(points), np.uint64)
    for n in LETTERS:
        h = h * np.uint64(0x100000001B3)
        h[: max(0, len(points) - n + 1)] += points[n - 1 :]
        whole = at + n <= end
        for kind, where in ((n, whole), (16 + n, whole & (at == start)), (32 + n, whole & (at + n == end))):
            own = np.flatnonzero(where)
            ids.append(bucket(h[own], kind))
            owners.append(of[own])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(ids)[order], np.bincount(owners, minlength=len(words)), keys


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (bucket, language)
    lexicon: np.ndarray  # sorted keys of words
    listed: np.ndarray  # (word of the lexicon, language): its language's lexicon lists it
    listing: np.ndarray  # (language whose lexicon lists a word, language)
    transitions: np.ndarray  # (language, next language), log

    def lists(self, keys: np.ndarray) -> np.ndarray:
        """Which lexica list the words, as (word, language) of 0 and 1."""
        if not len(self.lexicon):
            return np.zeros((len(keys), len(self.languages)))
        at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == keys)[:, None], self.listed[at], False).astype(np.float64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """How each word speaks for each language (the strongest 1, none below exp(-CLIP))."""
        out = np.zeros((len(words), len(self.languages)))
        for k in range(0, len(words), LOT):
            ids, sizes, keys = features(words[k : k + LOT])
            score = np.add.reduceat(self.weights[ids].astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            out[k : k + LOT] = score + times(self.lists(keys), self.listing)
        out -= out.max(1, keepdims=True, initial=-np.inf)
        return np.exp(np.maximum(out, -CLIP))


def times(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """rows @ matrix, term by term: a row's result does not depend on how many rows there are."""
    total = rows[..., 0, None] * matrix[0]
    for k in range(1, len(matrix)):
        total += rows[..., k, None] * matrix[k]
    return total


def posteriors(spoken: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(word, language): the chance of each language at each word given all words of its text, by
    forward-backward. `spoken` holds the emissions of all words, `counts` the words per text."""
    n, kinds = spoken.shape
    if not n:
        return np.zeros((0, kinds))
    step = np.exp(transitions - transitions.max())
    cuts = -(-counts // CHUNK)
    total = int(cuts.sum())
    text = np.repeat(np.arange(len(counts)), cuts)
    rank = np.arange(total) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = (np.cumsum(counts) - counts)[text] + rank * CHUNK
    size = np.minimum(counts[text] - rank * CHUNK, CHUNK)
    order = np.argsort(-size, kind="stable")  # chunks that still go on come first
    begin, size, rank, text = begin[order], size[order], rank[order], text[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max()))]  # chunks longer than t
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)  # of the chunks in text order

    def normal(x: np.ndarray, axes: int | tuple[int, ...]) -> np.ndarray:
        return x / x.max(axes, keepdims=True)

    # what a chunk does to a message: (label before it, label at its end)
    through = np.where((rank == 0)[:, None, None], np.eye(kinds), step) * spoken[begin][:, None, :]
    for t in range(1, len(live)):
        m = live[t]
        through[:m] = normal(times(through[:m], step) * spoken[begin[:m] + t][:, None, :], (1, 2))
    into, after = np.ones((total, kinds)), np.ones((total, kinds))
    firsts = np.cumsum(cuts) - cuts
    by_cuts = np.argsort(-cuts, kind="stable")
    longer = [int(np.searchsorted(-cuts[by_cuts], -r, "left")) for r in range(int(cuts.max()))]  # texts of more than r chunks
    for r in range(1, len(longer)):
        own = firsts[by_cuts[: longer[r]]] + r
        here, before = place[own], place[own - 1]
        into[here] = normal((into[before][:, :, None] * through[before]).sum(1), 1)
    for r in range(len(longer) - 1, 0, -1):
        own = firsts[by_cuts[: longer[r]]] + r
        here, before = place[own], place[own - 1]
        after[before] = normal((through[here] * after[here][:, None, :]).sum(2), 1)
    # all chunks at a time: forward, then backward
    out = np.empty((n, kinds))
    message = np.where((rank == 0)[:, None], into, times(into, step)) * spoken[begin]
    out[begin] = message
    for t in range(1, len(live)):
        m = live[t]
        message = normal(times(message[:m], step) * spoken[begin[:m] + t], 1)
        out[begin[:m] + t] = message
    back = after.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        out[begin[:m] + t] *= back[:m]
        if t:
            back[:m] = normal(times(back[:m] * spoken[begin[:m] + t], step.T), 1)
    return out / out.sum(1, keepdims=True)


class Trainer:
    """Fits weights, lexicon weights and transitions together by the likelihood of sequences."""

    def __init__(self, texts: list[str], languages: list[str], seed: int = 1):
        self.names = sorted(set(languages))
        self.random = np.random.default_rng(seed)
        label = np.array([self.names.index(x) for x in languages], np.int64)
        codes, counts, self.spelled, _ = words_of(pa.array(texts, pa.large_string()))
        of = np.repeat(np.arange(len(texts)), counts)[codes >= 0]
        self.codes = codes[codes >= 0]
        counts = np.bincount(of, minlength=len(texts))
        self.starts, self.counts, self.label = np.cumsum(counts) - counts, counts, label
        words = [w or "-" for w in self.spelled]  # the blank one is never used
        parts = [features(words[k : k + LOT]) for k in range(0, len(words), LOT)]
        self.ids, self.sizes, self.keys = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32) for k in range(3))
        self.first = np.cumsum(self.sizes) - self.sizes
        kinds = len(self.names)
        self.model = Model(self.names, np.zeros((1 << BUCKET_BITS, kinds), np.float32), *self._lexicon(of), np.zeros((kinds, kinds)), np.zeros((kinds, kinds)))

    def _lexicon(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.stack([of, self.codes]), axis=1)
        listed: dict[int, list[int]] = {}
        for k in range(len(self.names)):
            held = Counter(pairs[1, self.label[pairs[0]] == k].tolist())
            for word, n in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
                if n >= SEEN_IN:
                    listed.setdefault(word, []).append(k)
        words = sorted(listed, key=lambda w: int(self.keys[w]))
        flags = np.zeros((len(words), len(self.names)), bool)
        for row, w in enumerate(words):
            flags[row, listed[w]] = True
        return self.keys[words].astype(np.uint64) if words else np.zeros(0, np.uint64), flags

    def sequences(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(word codes, labels): half of one language, half of two or three runs of words."""
        usable = [np.flatnonzero((self.label == k) & (self.counts > 0)) for k in range(len(self.names))]
        spoken = [k for k, docs in enumerate(usable) if len(docs)]
        words, labels = np.zeros((number, WORDS), np.int64), np.zeros((number, WORDS), np.int64)
        for row in range(number):
            runs = 1 if self.random.random() < 0.5 else int(self.random.integers(2, 4))
            ends = [*np.sort(self.random.integers(1, WORDS, runs - 1)).tolist(), WORDS]
            at = 0
            for end in ends:
                k = spoken[int(self.random.integers(len(spoken)))]
                doc = usable[k][int(self.random.integers(len(usable[k])))]
                n = self.counts[doc]
                inside = (int(self.random.integers(n)) + np.arange(end - at)) % n
                words[row, at:end], labels[row, at:end] = self.codes[self.starts[doc] + inside], k
                at = end
        return words, labels

    def fit(self, number: int = SEQUENCES, epochs: int = 2, rate: float = 0.5) -> Model:
        model, kinds = self.model, len(self.names)
        if kinds < 2 or not len(self.codes):
            return model
        words, labels = self.sequences(number)
        squares = [np.full(model.weights.shape, 1e-6, np.float32), np.full((kinds, kinds), 1e-6), np.full((kinds, kinds), 1e-6)]
        eye = np.eye(kinds)
        for _ in range(epochs):
            order = self.random.permutation(number)
            for lot in np.array_split(order, max(1, number // 256)):
                used, inverse = np.unique(words[lot], return_inverse=True)
                n = self.sizes[used]
                flat = np.repeat(self.first[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                ids, lists = self.ids[flat], model.lists(self.keys[used])
                scale = 1 / np.sqrt(n)
                score = np.add.reduceat(model.weights[ids].astype(np.float64), np.cumsum(n) - n, axis=0) * scale[:, None] + lists @ model.listing
                inverse = inverse.reshape(len(lot), WORDS)
                chance, pairs = self.expected(score[inverse], model.transitions)
                gap = (chance - eye[labels[lot]]) / len(lot)
                seen = np.zeros((kinds, kinds))
                np.add.at(seen, (labels[lot][:, :-1], labels[lot][:, 1:]), 1 / len(lot))
                back = np.zeros((len(used), kinds))
                np.add.at(back, inverse.ravel(), gap.reshape(-1, kinds))
                by = np.argsort(ids, kind="stable")
                touched, start = np.unique(ids[by], return_index=True)
                slope = np.add.reduceat(np.repeat(back * scale[:, None], n, axis=0)[by], start, axis=0) + 1e-6 * model.weights[touched]
                squares[0][touched] += (slope * slope).astype(np.float32)
                model.weights[touched] -= (rate * slope / np.sqrt(squares[0][touched])).astype(np.float32)
                for k, (value, slope) in enumerate(((model.listing, lists.T @ back), (model.transitions, pairs / len(lot) - seen + 1e-4 * model.transitions)), 1):
                    squares[k] += slope * slope
                    value -= rate * slope / np.sqrt(squares[k])
        return model

    @staticmethod
    def expected(score: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of labels (sequence, word, language) and expected numbers of transitions."""
        spoken = np.exp(np.maximum(score - score.max(2, keepdims=True), -CLIP))
        step = np.exp(transitions - transitions.max())
        length = score.shape[1]
        ahead, back = np.empty_like(spoken), np.ones_like(spoken)
        ahead[:, 0] = spoken[:, 0]
        for t in range(1, length):
            x = (ahead[:, t - 1] @ step) * spoken[:, t]
            ahead[:, t] = x / x.sum(1, keepdims=True)
        for t in range(length - 1, 0, -1):
            x = (back[:, t] * spoken[:, t]) @ step.T
            back[:, t - 1] = x / x.sum(1, keepdims=True)
        chance = ahead * back
        chance /= chance.sum(2, keepdims=True)
        pairs = ahead[:, :-1, :, None] * step * (back[:, 1:] * spoken[:, 1:])[:, :, None, :]
        return chance, (pairs / pairs.sum((2, 3), keepdims=True)).sum((0, 1))


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES,
                  sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(lang, text): at most `sample` documents of each of the commonest `languages`, and of each
    at most `longest` characters, from a place that a hash names. Held-out ids and rows without
    id, text or language teach nothing. Ids are chosen first, so texts are not sorted."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    place = F.md5(F.concat_ws(" ", F.lit("crf"), F.col("id").cast("string")))
    narrow = known.select("lang", "id", place.alias("place")).join(F.broadcast(common), "lang")
    # a task keeps its own first ids of each language before any are shuffled
    order = W.partitionBy("lang").orderBy("place", "id")
    ids = narrow.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("lang", "id").distinct()
    spare = F.greatest(F.length("text") - longest, F.lit(0)) + 1
    cut = F.expr(f"substring(text, cast(pmod(xxhash64(id), spare) as int) + 1, {int(longest)})")
    found = known.join(F.broadcast(ids), ["lang", "id"]).withColumn("spare", spare).select("lang", "id", cut.alias("text"))
    again = W.partitionBy("lang").orderBy("id", "text")
    return found.withColumn("k", F.row_number().over(again)).filter(F.col("k") <= sample).select("lang", "id", "text")


def train(docs: DataFrame, **options) -> Model:
    """Fit on the bounded sample of `training_rows`, on the driver."""
    rows = sorted(map(tuple, training_rows(docs, **options).collect()))
    return Trainer([text for *_, text in rows], [lang for lang, *_ in rows]).fit()


def judged(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the share of each language in its letters (none: all 0), then the chances at
    all its words and which words they are."""
    codes, counts, spelled, letters = words_of(texts)
    spoken_at = np.flatnonzero(codes >= 0)
    of = np.repeat(np.arange(len(counts)), counts)[spoken_at]
    words = codes[spoken_at]
    per_text = np.bincount(of, minlength=len(counts))
    known = [w or "-" for w in spelled]
    chance = posteriors(model.emissions(known)[words], per_text, model.transitions)
    share = np.zeros((len(counts), len(model.languages)))
    full = np.flatnonzero(per_text)
    if len(full):
        weight = letters[words].astype(np.float64)
        first = (np.cumsum(per_text) - per_text)[full]
        share[full] = np.add.reduceat(chance * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
    return share, chance, spoken_at


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the language of every whole text and its share of the letters (0 to 1), in
    columns `lang` and `score`, which replace columns of these names.

    Null texts and texts without a letter, and all texts if nothing was learned, are `und` with
    score 0. Ties go to the first language by name. Equal texts get equal results; nothing but
    the text enters them."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        for rows in slices(whole, "text", SLICE):
            share = judged(rows.column("text"), model)[0] if model.languages else np.zeros((rows.num_rows, 1))
            best = share.argmax(1)
            top = np.minimum(share[np.arange(len(best)), best], 1.0)
            names += [model.languages[k] if s > 0 else UNDETERMINED for k, s in zip(best.tolist(), top.tolist(), strict=True)]
            scores.append(top)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["lang", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang, score)]
    return docs.withColumn("__judged", judge(F.col(text_col).cast("string"))).select(*kept, F.col("__judged.lang").alias(lang), F.col("__judged.score").alias(score))


def spans(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with the runs of words of one language in every whole text: an array of (begin, stop,
    lang, words, score) in characters, in order; `score` is the least chance of a word in the run.
    Words without a letter belong to no run of their own. Null texts have a null array."""

    @F.arrow_udf("array<struct<begin: int, stop: int, lang: string, words: int, score: double>>")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        for rows in slices(whole, "text", SLICE):
            texts = rows.column("text")
            _, chance, at = judged(texts, model) if model.languages else (None, np.zeros((0, 1)), np.zeros(0, np.int64))
            best, top, k, done = chance.argmax(1).tolist(), chance.max(1, initial=0).tolist(), 0, 0
            which = at.tolist()
            for text in texts.to_pylist():
                runs: list[dict] | None = None if text is None else []
                for m in re.finditer(r"\S+", text or ""):
                    if k < len(which) and which[k] == done:
                        lang = model.languages[best[k]]
                        if runs and runs[-1]["lang"] == lang:
                            runs[-1].update(stop=m.end(), words=runs[-1]["words"] + 1, score=min(runs[-1]["score"], top[k]))
                        else:
                            runs.append({"begin": m.start(), "stop": m.end(), "lang": lang, "words": 1, "score": top[k]})
                        k += 1
                    done += 1
                out.append(runs)
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("score", pa.float64())])))

    return docs.withColumn(name, label(F.col(text_col).cast("string")))
