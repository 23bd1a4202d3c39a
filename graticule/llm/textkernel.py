"""Vectorised work on batches of texts as byte arrays.

A batch's texts lie in one byte array with offsets, as Arrow holds them. Words, their hashes and shingles of words are
found by array operations over all bytes of a batch at once, so no Python string is made for a word. Batches are
cut so that a block holds about `BLOCK_BYTES` of text (a longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; the arrays beside take some 60 times as much.
BLOCK_BYTES = 1 << 19
#: Bytes of a longer text that are hashed at once.
STRIDE = 1 << 19

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STRIDE_POWER, _STRIDE_INVERSE = pow(_BASE, STRIDE, 1 << 64), pow(_BASE_INVERSE, STRIDE, 1 << 64)
#: Lower-cases A to Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, newline, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (a public finaliser of shifts and products)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A number for each byte.
BYTE_SALT = mix64(np.arange(1, 257, dtype=U) * U(_BASE))


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _BASE_INVERSE if inverse else _BASE, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)


def powers(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, inverse)[:n]


class Block:
    """Some texts as bytes: `data`, and `offsets` with one more entry than texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, null: np.ndarray):
        self.data, self.offsets, self.null = data, offsets, null

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """Which text each byte position lies in."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        outside = np.ones(len(self.data) + 2, dtype=bool)
        outside[1:-1] = IS_SPACE[self.data]
        starts = np.flatnonzero(outside[:-1] & ~outside[1:])
        ends = np.flatnonzero(~outside[:-1] & outside[1:])
        # a text's end also ends a word
        edges = self.offsets[1:-1]
        edges = np.unique(edges[(edges > 0) & (edges < len(self.data))])
        if len(edges):
            joined = edges[~outside[edges] & ~outside[edges + 1]]
            if len(joined):
                starts, ends = np.sort(np.r_[starts, joined]), np.sort(np.r_[ends, joined])
        return starts, ends, self.doc_of(starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
        """64-bit hash of the bytes of each span, after a byte-wise mapping; starts and ends ascend.

        Running sums are taken a stride of bytes at a time, so that only the spans themselves take memory.
        """
        upto_start, upto_end = np.zeros(len(starts), dtype=U), np.zeros(len(starts), dtype=U)
        with np.errstate(over="ignore"):
            total, lift, lower = U(0), U(1), U(1)
            for a in range(0, len(self.data), STRIDE):
                part = self.data[a : a + STRIDE]
                run = np.zeros(len(part) + 1, dtype=U)
                np.cumsum(BYTE_SALT[table[part]] * powers(len(part), False), out=run[1:])
                run = run * lift + total
                here = slice(*np.searchsorted(starts, (a, a + len(part))))
                upto_start[here] = run[starts[here] - a]
                here = slice(*np.searchsorted(ends, (a, a + len(part)), side="right"))
                upto_end[here] = run[ends[here] - a]
                total = run[-1]
                lift = lift * U(_STRIDE_POWER)
            raw = upto_end - upto_start
            for a in range(0, len(self.data), STRIDE):
                here = slice(*np.searchsorted(starts, (a, a + STRIDE)))
                raw[here] *= powers(STRIDE, True)[starts[here] - a] * lower
                lower = lower * U(_STRIDE_INVERSE)
            return mix64(raw + (ends - starts).astype(U) * U(_BASE))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """Blocks of an Arrow string array, each with the row at which it starts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    held = texts.buffers()[2] if n else None
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], null[at:to])
        at = to


def slices(block: Block, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A block of one text in parts of about `limit` bytes that begin after white space; a longer unbroken run stays whole."""
    data, at = block.data, 0
    while at < len(data):
        to = at + limit
        while to < len(data):
            blanks = np.flatnonzero(IS_SPACE[data[to - limit : to]])
            if len(blanks):
                to += int(blanks[-1]) + 1 - limit
                break
            to += limit
        part = data[at : min(to, len(data))]
        yield Block(part, np.array([0, len(part)]), np.zeros(1, dtype=bool))
        at = to


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a text, in order, and the first run of each text (n_docs + 1 entries).

    A text of fewer words, but at least one, has one run: all its words.
    """
    counts = np.bincount(doc, minlength=n_docs) if n_docs > 1 else np.full(n_docs, len(words))
    first_word = np.r_[0, np.cumsum(counts)]
    with np.errstate(over="ignore"):
        n = len(words)
        full = np.zeros(max(0, n - width + 1), dtype=U)
        for i in range(width):
            full += mix64(words[i : i + len(full)] + U(i + 1)) * U(2 * i + 3)
        full = mix64(full)
        if n_docs == 1 and n >= width:  # as with a long text, which is a block of its own
            return full, np.array([0, len(full)])
        runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.r_[0, np.cumsum(runs)]
        out = np.zeros(first[-1], dtype=U)
        long = np.flatnonzero(counts >= width)
        if len(long):
            take = np.repeat(first_word[long] - first[long], runs[long])
            place = np.repeat(np.r_[0, np.cumsum(runs[long])[:-1]], runs[long])
            index = np.arange(len(take)) - place + np.repeat(first[long], runs[long])
            out[index] = full[index + take]
        for d in np.flatnonzero((counts > 0) & (counts < width)):
            part = words[first_word[d] : first_word[d + 1]]
            acc = U(int(len(part)) * 0x51ED27)
            for i, w in enumerate(part):
                acc = mix64(np.array([acc + w + U(i + 1)], dtype=U))[0]
            out[first[d]] = acc
    return out, first
