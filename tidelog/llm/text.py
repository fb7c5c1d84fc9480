"""Whole texts as numpy byte arrays: words, lines and their hashes, without an object a word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Bytes of text that are looked at together.
SLICE_BYTES = 2 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
_PAD = b"\n" * 16
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Pages:
    """Several texts, joined by newlines, as one array of bytes."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, _PAD])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        #: Where each text begins, and at last where a further one would.
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last byte of each run of bytes that aren't ASCII white space."""
        blank = _BLANK[self.bytes]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edges = np.concatenate([[0], edges])
        return edges[0::2], edges[1::2]

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending positions lie before each text's start."""
        return np.searchsorted(starts, self.starts)

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each position, as a little-endian word."""
        view = np.ndarray((len(self.bytes) - 7,), "<u8", self.raw, strides=(1,))
        return view[at]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def ends_of(pages: Pages, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last eight bytes of each word: with its length, all of a word of up to 16 bytes."""
    length = np.minimum(ends - starts, 8)
    first = pages.eight(starts) & _MASK[length]
    return first, pages.eight(np.maximum(ends - 8, starts)) & _MASK[length]


def in_slices(texts: Iterable[bytes | None], size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Groups of whole texts of about ``size`` bytes; a longer text is a group of its own. Null: empty."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        text = text or b""
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def cut(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, cut before white space, so that no word is divided."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def word_keys(pages: Pages, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word, the same for equal words everywhere."""
    first, last = ends_of(pages, starts, ends)
    key = mix(first + mix(last + (ends - starts).astype(np.uint64) * GOLD))
    long = np.flatnonzero(ends - starts > 16)
    if len(long):
        own = [xxhash.xxh3_64_intdigest(pages.raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        key[long] = mix(key[long] ^ np.array(own, np.uint64))
    return key
