"""Token ids of whole batches through a store of words met before."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

from newsdesk.llm import arrays

MOST_WORDS, MOST_CUTS = 800_000, 200_000
"""Entries kept by one Python worker (about 100 MB); a store is emptied beyond. The words of one run of texts always fit."""

# The tokenizer's own rule for cutting words (and the blank that parts them here), and what may not
# be cut ahead of it: characters that its normal form changes by more than lower case, and special tokens.
CUTS = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WHOLE = regex.compile(r"[^\x20-\x7eÀ-įı-ſ]|<\|")


class Arena:
    """Ids of numbered entries, one behind the other."""

    def __init__(self):
        self.size, self.ids, self.starts = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append entries; returns the number of the first."""
        first, used = self.size, int(self.starts[self.size])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < first + len(sizes) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[used : used + len(ids)] = ids
        self.starts[first + 1 : first + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.size += len(sizes)
        return first

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries ``at``, and the bounds of each among them."""
        starts = self.starts[at]
        sizes = self.starts[at + 1] - starts
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


class WordTokens:
    """A tokenizer that drops white space, so that words are encoded each on its own, once.

    ``name`` is a file of ``public_tokenizers`` or a path, of the kind of ``word_bpe_49k.json``: lower case,
    words cut by ``CUTS``, and a last token of each cut that ends in ``</w>``. Words are told apart by a
    64-bit hash.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.keys, self.places, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), Arena()
        self.cuts: dict[str, int] = {" ": 0}
        self.parts = Arena()
        self.parts.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    @classmethod
    @cache
    def of(cls, name: str) -> WordTokens:
        """One store for all tasks of a Python worker."""
        return cls(name)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and how many each has."""
        joined = " ".join(words)
        if WHOLE.search(joined):
            whole = np.array([bool(WHOLE.search(w)) for w in words])
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, x in zip(words, whole, strict=True) if x], add_special_tokens=False)]
            ids, counts = self._encoded([w for w, x in zip(words, whole, strict=True) if not x]) if not whole.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            sizes = np.zeros(len(words), np.int64)
            sizes[whole], sizes[~whole] = [len(x) for x in found], counts
            out = np.zeros(sizes.sum(), np.int64)
            of_whole = np.repeat(whole, sizes)
            out[of_whole], out[~of_whole] = [i for x in found for i in x], ids
            return out, sizes
        if len(self.cuts) > MOST_CUTS:
            self.cuts, self.parts = {" ": 0}, Arena()
            self.parts.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        cuts = CUTS.findall(joined.lower())
        if new := [c for c in dict.fromkeys(cuts) if c not in self.cuts]:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("the tokenizer cuts words in another way")
            first = self.parts.add(ids, np.diff(ends, prepend=0))
            self.cuts.update(zip(new, range(first, first + len(new)), strict=True))
        at = np.fromiter(map(self.cuts.__getitem__, cuts), np.int64, len(cuts))
        ids, bounds = self.parts.take(at)
        ends = bounds[np.concatenate([np.flatnonzero(at == 0), [len(at)]])]
        return ids, np.diff(ends, prepend=0)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        first = self.words.add(*self._encoded(words))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.places = np.insert(self.keys, at, keys), np.insert(self.places, at, np.arange(first, first + len(keys)))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and the rows' bounds among them."""
        words = arrays.words_of(text)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(text) + 1, np.int64)
        # Each word is looked up once, in the order of the store.
        keys, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            new = ~known
            if len(self.keys) + int(new.sum()) > MOST_WORDS:
                self.keys, self.places, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), Arena()
                new = np.ones(len(keys), bool)
            raw = words.raw.tobytes()
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            at, known = self._find(keys)
            if not known.all():
                raise ValueError("a word is missing from the store")
        ids, bounds = self.words.take(self.places[at][of])
        return ids, bounds[words.bounds]


arrays.emptied_by(WordTokens.of.cache_clear)
