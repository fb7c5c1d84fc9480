"""Simple-8b word-aligned coding of unsigned integers, in blocks, with numpy.

A 64-bit word holds a selector in its low four bits and, above it, as many
values of one width as fit into 60 bits.  The greedy choice (the most values
that fit) is made for all positions at once by sliding maxima of the widths;
then all blocks follow their chains of words in step.  A value of more than 60
bits becomes an escape word, whose payload is its place in a list of exceptions.
"""

from __future__ import annotations

import numpy as np

#: Values in a block (the last of a run may hold fewer).
BLOCK = 1024
#: How many values, of how many bits, for each selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 0], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 0], np.int64)
ESCAPE = 14
_PAD = 60


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, one at least."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.maximum(np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]), 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the place of each block's first word, and exceptions (values of more than 60 bits, in order)."""
    values = values.astype(np.uint64)
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    padded[:, :BLOCK].reshape(-1)[:] = 0
    whole = len(values) // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : len(values) - whole * BLOCK] = values[whole * BLOCK :]
    wide = widths(padded.reshape(-1)).reshape(padded.shape)
    choice = np.where(wide[:, :BLOCK] > 60, ESCAPE, 13).astype(np.uint8)
    most, n = wide, 1
    for selector in range(12, -1, -1):  # ever more values
        target = int(COUNTS[selector])
        while n < target:
            step = min(n, target - n)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            n += step
        fits = most[:, :BLOCK] <= BITS[selector]
        rows, columns = fits.shape
        choice[:, :columns][fits] = selector
    left = np.full(blocks, BLOCK)
    if whole < blocks:
        left[-1] = len(values) - whole * BLOCK
    first = np.zeros((blocks, BLOCK), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        first[row, at] = True
        at = at + COUNTS[choice[row, at]]
        on = at < left[row]
        row, at = row[on], at[on]
    words_in = first.sum(1)
    where = np.flatnonzero(first.reshape(-1))
    chosen = choice.reshape(-1)[where]
    place = where + where // BLOCK * _PAD
    flat = padded.reshape(-1)
    words = chosen.astype(np.uint64)
    for selector in range(14):
        own = np.flatnonzero(chosen == selector)
        if len(own):
            for k in range(COUNTS[selector]):
                words[own] |= flat[place[own] + k] << np.uint64(4 + k * BITS[selector])
    own = np.flatnonzero(chosen == ESCAPE)
    words[own] |= np.arange(len(own), dtype=np.uint64) << np.uint64(4)
    return words, np.cumsum(words_in) - words_in, flat[place[own]]


def decode(words: np.ndarray, block_starts: np.ndarray, total: int, exceptions: np.ndarray) -> np.ndarray:
    """The values of successive blocks; ``total`` counts them, as padding doesn't tell."""
    selector = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(block_starts)), np.diff(np.append(block_starts, len(words))))
    at = block * BLOCK + before - before[block_starts][block]
    end = np.minimum((block + 1) * BLOCK, total)
    out = np.zeros(total + _PAD, np.uint64)
    payload = words >> np.uint64(4)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[own]] = exceptions[payload[own].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            mine = own[at[own] + k < end[own]]
            out[at[mine] + k] = (payload[mine] >> np.uint64(k * BITS[s])) & mask
    return out[:total]
