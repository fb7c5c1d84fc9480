"""Batch encoding with a tokenizer file, through a bounded cache of words.

The tokenizer splits at white space before its merges run, so the ids of a
text are the ids of its white-space separated words one after another.  Each
Python worker keeps the ids of words it has met in numpy arrays (some 30 bytes
a word); only new words reach the tokenizer.  A word of up to 16 bytes is known
by all its bytes, never by a hash alone; longer ones aren't kept between slices.
A test holds this against plain encoding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd

from . import text as tx

#: Words that a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 2_000_000

#: A run of letters, then a mark or none: one piece or two for the pre-tokenizer.
_ASCII = re.compile(rb"[A-Za-z]+[.,;:!?]?")
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,;:!?]?")
_MARK = re.compile(rb"([.,;:!?])")

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes UTF-8 texts to uint32 ids, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether an id ends a piece; none if the model doesn't mark ends.
        self.closes: np.ndarray | None = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            #: The same model for words that are already in lower case and in pieces.
            self.light = Tokenizer.from_file(path)
            self.light.normalizer = normalizers.Sequence([])
            self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        #: By ascending key: the word's first and last bytes, and where in the pool its ids are.
        self.keys = np.zeros(0, np.uint64)
        self.first, self.last = np.zeros((2, 0), np.uint64)
        self.at, self.n = np.zeros((2, 0), np.int32)
        self.pool = np.zeros(0, "<u4")

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has.

        Words of letters go through the tokenizer many to a text, which spares an object for
        each; the token that closes a piece of the pre-tokenizer tells them apart."""
        found: dict[bytes, bytes] = {}
        plain, latin, rest = [], [], words
        if self.closes is not None:
            rest = []
            for w in words:
                (plain if _ASCII.fullmatch(w) else latin if _LATIN.fullmatch(w) else rest).append(w)
        self._each(rest, found)
        self._joined(latin, self.tokenizer, b" ".join, found)
        self._joined(plain, self.light, lambda some: _MARK.sub(rb" \1", b" ".join(some).lower()), found)
        parts = [found[w] for w in words]
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int32, len(parts)) // 4

    def _each(self, words: list[bytes], found: dict) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        self._put(words, flat, np.cumsum([len(i) for i in ids], dtype=np.int64), found)

    def _joined(self, words: list[bytes], tokenizer, join, found: dict) -> None:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(tokenizer.encode_batch_fast([join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            pieces = np.cumsum([1 + (w[-1] < 64) for w in some])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == pieces[-1]:
                self._put(some, ids.tobytes(), ends[pieces - 1], found)
            else:
                self._each(some, found)

    @staticmethod
    def _put(words: list[bytes], flat: bytes, ends: np.ndarray, found: dict) -> None:
        ends = (4 * ends).tolist()
        found.update((w, flat[a:b]) for w, a, b in zip(words, [0, *ends], ends))

    def _look_up(self, pages: tx.Pages, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Where in the pool the ids of each word of up to 16 bytes are, and how many.
        None if two different words share a 64-bit key."""
        first, last = tx.ends_of(pages, starts, ends)
        size = (ends - starts).astype(np.uint64)
        key = tx.mix(first + tx.mix(last + size * np.uint64(0x9E3779B97F4A7C15)))
        code, distinct = pd.factorize(key)
        one = np.empty(len(distinct), np.int64)
        one[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        f, l = first[one], last[one]
        if not ((f[code] == first).all() and (l[code] == last).all()):
            return None
        if len(self.keys) + len(distinct) > CACHE_WORDS:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        near = np.minimum(where, max(len(self.keys) - 1, 0))
        if len(self.keys):
            same = self.keys[near] == distinct
            if not ((self.first[near] == f) & (self.last[near] == l))[same].all():
                self._forget()
                return self._look_up(pages, starts, ends)
        else:
            same = np.zeros(len(distinct), bool)
        at, n = np.empty((2, len(distinct)), np.int32)
        at[same], n[same] = self.at[near[same]], self.n[near[same]]
        new = np.flatnonzero(~same)
        if len(new):
            raw = pages.raw
            ids, count = self.ids_of([raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            at[new] = len(self.pool) + np.cumsum(count) - count
            n[new] = count
            self.pool = np.concatenate([self.pool, ids])
            order = new[np.argsort(distinct[new])]
            put = np.searchsorted(self.keys, distinct[order])
            self.keys = np.insert(self.keys, put, distinct[order])
            self.first, self.last = np.insert(self.first, put, f[order]), np.insert(self.last, put, l[order])
            self.at, self.n = np.insert(self.at, put, at[order]), np.insert(self.n, put, n[order])
        return at[code], n[code]

    def encode_slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the last's end)."""
        pages = tx.Pages(texts)
        starts, ends = pages.words()
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        at, n = np.empty((2, len(starts)), np.int64)
        short = ends - starts <= 16
        pool = self.pool
        if short.any():
            found = self._look_up(pages, starts[short], ends[short])
            if found is None:
                short[:] = False
            else:
                at[short], n[short] = found
                pool = self.pool
        if not short.all():
            long = np.flatnonzero(~short)
            words = [pages.raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids, count = self.ids_of(list(distinct))
            code = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            at[long], n[long] = (len(pool) + np.cumsum(count) - count)[code], count[code]
            pool = np.concatenate([pool, ids])
        done = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(at - done[:-1], n) + np.arange(done[-1])]
        return ids, done[pages.text_of(starts)]

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn (null: none). Memory is bounded by a slice and the longest text."""
        for some in tx.in_slices(texts):
            if len(some[0]) > 2 * tx.SLICE_BYTES:
                yield np.concatenate([self.encode_slice([part])[0] for part in tx.cut(some[0])])
                continue
            ids, bounds = self.encode_slice(some)
            bounds = bounds.tolist()
            for a, b in zip(bounds, bounds[1:]):
                yield ids[a:b]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
