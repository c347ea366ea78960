"""Token ids of whole texts by the tokenizers library, words in use only once per worker.

In a byte-level BPE the pattern cuts before every space that a non-space follows, so the stretch
from such a space to the next is encoded alike wherever it stands. A text is therefore the
concatenation of the ids of its stretches, and a bounded cache of words saves most of the
library's work. Texts in which some space is followed by white space, and those that hold an added
token of the tokenizer, take the plain path."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
#: Words of either generation that a worker keeps (about 200 bytes each).
CACHE = 200_000
#: Bytes of text encoded at a time; words are looked up once for each.
SLICE = 4 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def packed(ids: Sequence[int]) -> bytes:
    return array("I", ids).tobytes()


class Stretches:
    """Ids of texts from the ids of their stretches.

    `alone` says the ids of a stretch (as native uint32), `whole` those of a text that the cuts do
    not fit, `odd` which stretches tell such texts (`odd_first`: also at a text's beginning).
    `lead` stands before the first stretch, and `space` before the others."""

    lead, space, odd_first = "", " ", False
    #: Strings that the library takes as one id wherever they stand.
    added: tuple[str, ...] = ()

    def __init__(self):
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        raise NotImplementedError

    def whole(self, text: str) -> Sequence[int]:
        raise NotImplementedError

    def odd(self, word: str) -> bool:
        raise NotImplementedError

    def remember(self, word: str, ids: Callable[[str], Sequence[int]]) -> bytes:
        """Two generations of words: those still in use move on to the new one."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.older, self.words = self.words, {}
            found = self.words[word] = self.older.get(word) or packed(ids(word))
        return found

    def forget(self):
        """Drop the older generation: a worker keeps no more between tasks than it must."""
        self.older = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the number of ids of each text; a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.asarray(split.offsets, np.int64)
        ends = ends - ends[0]
        first = ends[:-1]
        spelled = words.dictionary.to_pylist()
        odd_at = np.array(list(map(self.odd, spelled)), bool)[codes]
        if not self.odd_first:
            odd_at[first] = False
        plain = np.add.reduceat(odd_at, first) > 0
        for token in self.added:
            plain |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        raw = [self.alone(self.space + w) for w in spelled]
        if self.lead != self.space:
            raw += [self.alone(self.lead + spelled[c]) for c in codes[first].tolist()]
            codes[first] = len(spelled) + np.arange(n)
        flat = np.frombuffer(b"".join(raw), np.uint32)
        each = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        lengths = each[codes]
        if plain.any():
            lengths[np.repeat(plain, np.diff(ends))] = 0
        counts = np.add.reduceat(lengths, first)
        ids = gather(flat, (np.cumsum(each) - each)[codes], lengths)
        if plain.any():
            parts, at = [], 0
            for k in range(n):
                own = ids[at : at + counts[k]]
                at += counts[k]
                if plain[k]:
                    own = np.array(self.whole(texts[k].as_py()), np.uint32)
                    counts[k] = len(own)
                parts.append(own)
            ids = np.concatenate(parts)
        return ids, counts


class Encoder(Stretches):
    def __init__(self, path: str | None = None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = byte_letters()

    def _piece(self, piece: str) -> list[int]:
        """Ids of what the pattern takes as one piece."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def alone(self, text: str) -> bytes:
        # beyond the Latin and European letters the libraries' Unicode tables may differ
        if not text.isascii() and max(text) >= "ɐ":
            return packed(self.whole(text))
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return self.remember(text, self._piece)
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return self.remember(text[:-1], self._piece) + self.remember(text[-1], self._piece)
        return b"".join([self.remember(piece, self._piece) for piece in self.pieces(text)])

    def whole(self, text: str) -> Sequence[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def odd(self, word: str) -> bool:
        return not word or word[0].isspace()


def worker_encoder(path: str | None = None) -> Encoder:
    """The worker process's encoder for a tokenizer file. Functions reach workers by value, with
    globals of their own for each task; what outlives a task hangs on the library's module."""
    kept = vars(tokenizers).setdefault("_wardstone_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every text."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    ends = np.cumsum(counts + 1)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    return out, counts + 1
