"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of the hashed character n-grams of "<word>" and the word itself; a window of
consecutive words is the average of the vectors of its n-grams, and a linear softmax gives the
chance that the window is toxic. A few insults in a long text are what labels mark, and the
average over the whole text would drown them, so every window of the whole text is scored and the
worst one speaks for the document.

Labels are of documents, not windows. Training starts from the log odds of n-grams in labelled
documents, takes the windows it believes in, fits vectors and softmax together on them (and on
the worst and on random windows of clean documents), and repeats with the fitted model; last, a
scale and an offset are fitted for the documents' worst windows.

The softmax is linear, so a trained model is one number per n-gram bucket: scoring adds numbers
of distinct words and runs windows over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wardstone.llm.store import slices

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 12, (3, 4, 5, 6)
#: Words of a window.
WINDOW = 5
#: Bound of the training sample: labelled documents of each class, and characters of one.
SAMPLE, LONGEST = 1500, 8000
#: Distinct words whose n-grams are held at a time, and bytes of text scored at a time.
LOT, SLICE = 10_000, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words, one after the other, and how many each has (one at least)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    ids, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h * np.uint64(0x100000001B3)
        h[: len(points) - n + 1] += points[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(np.arange(len(points)) + n <= ends)
            mixed = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed >> np.uint64(64 - 18)).astype(np.int64))
            owners.append(of[at])
    whole = np.array([hash_word(w) for w in marked], np.int64)
    ids.append(whole)
    owners.append(np.arange(len(marked)))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owners, minlength=len(marked))


def hash_word(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h >> (64 - 18)


@dataclass
class Model:
    weights: np.ndarray  # softmax logit of each bucket
    bias: float
    scale: float = 1.0
    offset: float = 0.0


def worst(sums: np.ndarray, sizes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the largest window average and where the window begins. sums and sizes
    are of words; documents without words get -inf."""
    ends, at = np.repeat(starts + counts, counts), np.arange(len(sums))
    # added up inside the window: what lies around it must not move the last digits
    total, size = sums.astype(np.float64), sizes.astype(np.int64)
    for k in range(1, WINDOW):
        inside = np.flatnonzero(at + k < ends)
        total[inside] += sums[inside + k]
        size[inside] += sizes[inside + k]
    # a window cut short by the document's end stands only if the document has no whole one
    first = np.repeat(starts, counts)
    value = np.where((at + WINDOW <= ends) | (at == first), total / np.maximum(size, 1), -np.inf)
    best = np.full(len(counts), -np.inf)
    where = np.zeros(len(counts), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        best[full] = np.maximum.reduceat(value, starts[full])
        hits = np.flatnonzero(value == np.repeat(best, counts))
        of = np.repeat(np.arange(len(counts)), counts)[hits]
        firsts = np.r_[True, of[1:] != of[:-1]]
        where[of[firsts]] = hits[firsts]
    return best, where


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words, words per text, and the distinct words: lower case, without
    non-letters at either end."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.utf8_split_whitespace(texts)
    flat = pc.utf8_trim(split.flatten(), ".,;:!?\"'()[]{}<>*#&$%-_`~/\\|+=@^") if len(texts) else split.flatten()
    ends = np.asarray(split.offsets, np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(ends)
    spelled = coded.dictionary.to_pylist()
    blank = [k for k, w in enumerate(spelled) if not w]
    if blank:  # splitting leaves empty words at the ends of texts and for bare punctuation
        keep = codes != blank[0]
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        codes = codes[keep]
    return codes, counts, spelled


class Trainer:
    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 1):
        self.random = np.random.default_rng(seed)
        self.labels = labels
        codes, self.counts, spelled = words_of(pa.array(texts, pa.large_string()))
        self.codes, self.starts = codes, np.cumsum(self.counts) - self.counts
        parts = [grams(spelled[k : k + LOT]) for k in range(0, len(spelled), LOT)]
        self.grams, self.sizes = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32) for k in (0, 1))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.vectors = self.random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.softmax = np.zeros((DIMENSIONS, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.squares = [np.full(BUCKETS, 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)]

    def odds(self) -> np.ndarray:
        """Log odds of each bucket to be in a toxic document, damped where seldom seen."""
        a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for doc, (start, count) in enumerate(zip(self.starts.tolist(), self.counts.tolist(), strict=True)):
            word = np.unique(self.codes[start : start + count])
            n = self.sizes[word]
            flat = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            (a if self.labels[doc] == 1 else b)[np.unique(self.grams[flat])] += 1
        share_a, share_b = (a + 0.5) / ((self.labels == 1).sum() + 1), (b + 0.5) / ((self.labels == 0).sum() + 1)
        return np.log(share_a / share_b) * np.minimum(a + b, 10) / 10

    def score(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        per_word = np.add.reduceat(weights[self.grams], self.first)
        return worst(per_word[self.codes], self.sizes[self.codes], self.starts, self.counts)

    def bags(self, begins: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of windows, one after the other, and how many each has."""
        stop = np.minimum(begins + WINDOW, (self.starts + self.counts)[docs])
        n = stop - begins
        words = self.codes[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        m = self.sizes[words]
        flat = np.repeat(self.first[words] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        return self.grams[flat], np.bincount(np.repeat(np.arange(len(n)), n), m, len(n)).astype(np.int64)

    def fit(self, begins: np.ndarray, docs: np.ndarray, toxic: np.ndarray, epochs: int, rate: float = 0.3):
        share = max(1, int((~toxic).sum())) / max(1, int(toxic.sum()))
        for _ in range(epochs):
            order = self.random.permutation(len(begins))
            for at in range(0, len(order), 512):
                own = order[at : at + 512]
                ids, n = self.bags(begins[own], docs[own])
                first = np.cumsum(n) - n
                mean = np.add.reduceat(self.vectors[ids], first, axis=0) / n[:, None]
                logits = mean @ self.softmax + self.bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), toxic[own].astype(int)] -= 1
                p *= np.where(toxic[own], min(share, 5), 1)[:, None] / len(own)
                back = (p @ self.softmax.T) / n[:, None]
                self._step(self.softmax, self.squares[1], mean.T @ p, rate)
                self._step(self.bias, self.squares[2], p.sum(0), rate)
                # vectors: one squared norm for each bucket
                by = np.argsort(ids, kind="stable")
                seen, start = np.unique(ids[by], return_index=True)
                g = np.add.reduceat(np.repeat(back, n, axis=0)[by], start, axis=0)
                self.squares[0][seen] += (g * g).mean(1)
                self.vectors[seen] -= rate * g / np.sqrt(self.squares[0][seen])[:, None]

    @staticmethod
    def _step(x: np.ndarray, squares: np.ndarray, g: np.ndarray, rate: float):
        squares += g * g
        x -= rate * g / np.sqrt(squares)

    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)

    def train(self, rounds: int = 3, epochs: int = 4) -> Model:
        full = np.flatnonzero(self.counts)
        toxic_docs, clean_docs = full[self.labels[full] == 1], full[self.labels[full] == 0]
        if not len(toxic_docs) or not len(clean_docs):
            # nothing to tell apart: every text has the share of toxic ones
            share = (self.labels.sum() + 0.5) / (len(self.labels) + 1)
            return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
        current = self.odds()
        for _ in range(rounds):
            best, where = self.score(current)
            # windows of toxic documents count as toxic if they stand out from clean documents' worst
            bar = np.quantile(best[clean_docs], 0.9)
            believed = toxic_docs[best[toxic_docs] > bar]
            believed = believed if len(believed) else toxic_docs
            anywhere = [self.starts[clean_docs] + (self.random.random(len(clean_docs)) * self.counts[clean_docs]).astype(np.int64) for _ in range(2)]
            begins = np.concatenate([where[believed], where[clean_docs], *anywhere])
            docs = np.concatenate([believed, clean_docs, clean_docs, clean_docs])
            self.fit(begins, docs, np.arange(len(begins)) < len(believed), epochs)
            current = self.weights()
        bias = float(self.bias[1] - self.bias[0])
        best, _ = self.score(current)
        x, y = best[full] + bias, self.labels[full]
        # scale and offset: a logistic fit of one variable by Newton steps
        weight = np.where(y == 1, 0.5 / max(1, int(y.sum())), 0.5 / max(1, int((y == 0).sum())))
        center, spread = float(np.median(x)), float(x.std() or 1.0)
        z = np.c_[(x - center) / spread, np.ones(len(x))]
        beta = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            g = z.T @ (weight * (p - y)) + 1e-4 * beta
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
            beta -= np.linalg.solve(h, g)
        return Model(current, bias, float(beta[0] / spread), float(beta[1] - beta[0] * center / spread))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    codes, counts, spelled = words_of(texts)
    best = np.full(len(texts), -np.inf)
    if len(codes):
        per_word, sizes = np.zeros(len(spelled)), np.zeros(len(spelled), np.int64)
        for k in range(0, len(spelled), LOT):
            ids, n = grams(spelled[k : k + LOT])
            per_word[k : k + LOT], sizes[k : k + LOT] = np.add.reduceat(model.weights[ids], np.cumsum(n) - n), n
        best, _ = worst(per_word[codes], sizes[codes], np.cumsum(counts) - counts, counts)
    z = np.where(np.isfinite(best), (np.where(np.isfinite(best), best, 0) + model.bias) * model.scale + model.offset, -30)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(text, toxic): at most `sample` documents of each class, none longer than `longest`
    characters, none held out; which ones is a matter of a hash of their id. Only their ids, a
    bounded number, meet the table of texts. Contradicting labels of an id count as toxic."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    # twice as many ids as rows wanted, since some texts are missing or too long
    ids = [known.filter(F.col("toxic") == k).orderBy(*order).limit(2 * sample) for k in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").filter(F.length("text") <= longest)
    both = [found.filter(F.col("toxic") == k).orderBy(*order, "text").limit(sample) for k in (0, 1)]
    return both[0].union(both[1]).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on the bounded sample, on the driver: at most 2 * sample * longest characters."""
    rows = sorted(training_rows(docs, labels, sample, longest).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return Trainer([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64)).train()


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) of every whole text as column `name`, which replaces a column
    of that name. Null texts and texts without words get the lowest score; equal texts, repeated
    rows among them, get equal scores, whatever rows stand around them; nothing but the text enters
    the score. An empty table gives an empty one."""

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array(np.concatenate([np.zeros(0), *(score_texts(rows.column("text"), model) for rows in slices(whole, "text", SLICE))]))

    return docs.withColumn(name, toxic(F.col(text_col).cast("string")))
