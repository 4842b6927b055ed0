"""Words of Arrow texts as numpy arrays: their places, hashes, and hashes of runs of words.

A word is a maximal run of characters outside white space (``shared.SPACE``). All bytes of a batch
are handled at once; nothing is kept between batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of the first 64 places of a word.
_TABLE = mix(np.arange(64 * 256, dtype=np.uint64))


@dataclass
class Words:
    """Words of a batch of texts, in order.

    data: the bytes of all texts; start, end: each word's bytes; first: for every text the number of
    its first word, and the number of all words at the end.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: the sum of its bytes' table entries by place, mixed."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        byte = self.data[np.repeat(self.start, size) + place]
        if place.max() < 64:
            value = _TABLE[(place << 8) | byte]
        else:
            value = mix((place.astype(np.uint64) << np.uint64(8)) | byte)
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Per text its words (or those to keep), joined by one space."""
        keep = np.ones(len(self.start), bool) if keep is None else keep
        start, end = self.start[keep], self.end[keep]
        held = np.concatenate([[0], np.cumsum(keep)])[self.first]
        size = end - start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        bare = size - 1
        place = np.arange(int(bare.sum())) - np.repeat(np.cumsum(bare) - bare, bare)
        out[np.repeat(at[:-1], bare) + place] = self.data[np.repeat(start, bare) + place]
        whole = out.tobytes()
        return [whole[at[a] : at[b] - 1] if b > a else b"" for a, b in zip(held[:-1], held[1:], strict=True)]


def split(texts: pa.Array) -> Words:
    """The words of an Arrow string array; null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    solid = ~_SPACE[data]
    begin, close = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    close[:-1] &= ~solid[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begin[edge] = solid[edge]
    close[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(close) + 1, np.searchsorted(start, at))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on; shorter than ``hashes`` by ``n - 1``.

    Runs may pass from one text to the next; callers leave those out.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, made, power = 0, np.zeros(len(hashes) + 1, np.uint64), np.uint64(1)
    part, size, factor = hashes, 1, _ODD
    while True:
        if n & size:
            length = len(hashes) - have - size + 1
            made = made[:length] + power * part[have : have + length]
            have, power = have + size, np.uint64(int(power) * int(factor) & (1 << 64) - 1)
        if 2 * size > n:
            return mix(made)
        part = part[: len(part) - size] + factor * part[size:]
        size, factor = 2 * size, np.uint64(int(factor) * int(factor) & (1 << 64) - 1)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of ``width`` neighbours from each place on (the leftmost of equals)."""
    length = len(values) - width + 1
    if length <= 0:
        return np.zeros(0, np.int64)
    low, at = values[:length].copy(), np.zeros(length, np.int64)
    for j in range(1, width):
        less = values[j : j + length] < low
        low[less] = values[j : j + length][less]
        at[less] = j
    return at + np.arange(length)
