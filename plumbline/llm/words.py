"""Words and word shingles of whole Arrow batches, hashed with numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D. All words of
a chunk of rows are found and hashed together, so that the cost per word is a
few array operations instead of a Python call. The working memory is bounded by
``CHUNK`` bytes of text (or one text, if that is longer).

A word's hash goes over it in blocks of eight bytes, each of which passes two
lanes that mix every bit before the next block; words of more than ``LONG``
bytes are hashed by blake2b. A shingle's hash joins those of its words in pairs,
pairs of pairs and so on, mixed at every step. Neither is a sum of its parts, so
texts that differ don't meet by construction. Operators whose decisions are
final compare the words themselves as well (``spelled`` gives them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK, LONG = 1 << 20, 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)  # the first n bytes of a block

EXACT = np.arange(256, dtype=np.uint8)
LOWER = EXACT.copy()
LOWER[65:91] += 32
#: lower-case, and ASCII punctuation separates words too
LOOSE = LOWER.copy()
LOOSE[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(mix(a + np.uint64(0xD6E8FEB86659FD93)) ^ (b * np.uint64(0xA0761D6478BD642F)))


def _blocks(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a text on, as one number each."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))


def _spans(blocks: np.ndarray, at: np.ndarray, size: np.ndarray, tag: int = 0) -> np.ndarray:
    """Hashes of the stretches of ``size`` bytes (at most LONG) from ``at`` on."""
    one, two = mix(size.astype(np.uint64) + np.uint64(977 * tag)), np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for step in range(0, int(size.max(initial=0)), 8):
        live = slice(None) if step == 0 else np.flatnonzero(size > step)
        x = blocks[at[live] + step] & _KEEP[np.minimum(size[live] - step, 8)]
        one[live], two[live] = mix(one[live] ^ x), mix(two[live] + x * np.uint64(0x9FB21C651E98DF25)) ^ one[live]
    return mix(one ^ (two >> np.uint64(7)) ^ (two << np.uint64(57)))


@dataclass
class Words:
    """Words of rows ``first .. first + len(rows) - 1``; row i has words rows[i] .. rows[i + 1] - 1."""

    first: int
    rows: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # as given
    folded: np.ndarray  # as hashed

    def __len__(self) -> int:
        return len(self.rows) - 1

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave their row are meaningless (see ``inside``)."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, done, power, width = None, 0, self.hashes, 1
        while True:
            if k & width:
                part = power[done : done + n]
                out = part.copy() if out is None else _join(out, part)
                done += width
            if done == k:
                return mix(out + np.uint64(k))
            power = _join(power[:-width], power[width:])
            width *= 2

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes (8 at most) of the words that are longer, and which words these are."""
        long = np.flatnonzero(self.ends - self.starts > n)
        return _spans(_blocks(self.folded), self.starts[long], np.full(len(long), n), 1), long

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.rows))

    def inside(self, k: int) -> np.ndarray:
        """Which k-grams lie within one row."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        left = np.repeat(self.rows[1:], np.diff(self.rows))[:n] - np.arange(n)
        return left >= k

    def spelled(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A number for each of the words, the same for the same word and for no other (within this call)."""
        return cut(self.folded, self.starts[which], self.ends[which]).dictionary_encode().indices.to_numpy()


def cut(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The stretches of a text, as an array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = text[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def binary(column) -> pa.Array:
    """A text column as large binary, nulls as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).fill_null(b"")
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def words_of(column, fold: np.ndarray = EXACT, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of all rows, in chunks of rows that hold about ``chunk`` bytes."""
    texts = binary(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        to = min(to, len(texts))
        yield _hash(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold)
        at = to


def _hash(first: int, raw: np.ndarray, bounds: np.ndarray, fold: np.ndarray) -> Words:
    text = raw if fold is EXACT else fold[raw]
    n = len(text)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64), none, none, raw, text)
    solid = ~_SPACE[text]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = solid[edge]
    stop[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    size = ends - starts
    hashes = _spans(_blocks(text), starts, np.minimum(size, LONG))
    for i in np.flatnonzero(size > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(first, np.searchsorted(starts, bounds), hashes, starts, ends, raw, text)
