"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The model is a vocabulary of byte pieces with log-probabilities. A pre-token (a word with the blank before it) is segmented
with the greatest sum of log-probabilities; its token count is the number of pieces (ties: fewer pieces). The forward
score of a prefix depends on the prefix alone, so the new pre-tokens of a block are laid out as a trie and each node's
score, and piece count, is computed once for all pre-tokens that share the prefix. The node where a pre-token ends holds its
count, and a document's count is the sum over its words.

The trie is an array of nodes by depth: in the sorted pre-tokens, a prefix is a new node where it is longer than what a
pre-token shares with the one before. The pieces that end at a node are found for all nodes at once, a byte further back
at each step; then the scores follow depth by depth.

Vocabulary: the published byte-level BPE ranks. Their probabilities follow the rank by a Zipf law, log p = -log(rank + 1);
single bytes get the probability of the last rank, so that every text can be segmented. It's a fixed function of a published file;
nothing is trained.

Pre-tokens and pieces are told by 64-bit hashes. A worker remembers the counts of up to `MEMORY` pre-tokens; beyond that it
starts anew, which changes no result. A pre-token of more than `TRIE_BYTES` bytes is not laid out but read in slices, with
the scores of as many bytes before a slice as the longest piece has; so neither a long text nor one unbroken word needs more
memory than some 50 bytes a byte of a slice, beside the positions of the text's words (32 bytes a word).

Edge cases: a null or empty text, or one of white space only, has no words and no tokens; rows that repeat a doc_id are
counted each, and so are rows without one; equal sums are decided by the fewer pieces; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import map_texts
from graticule.llm.textkernel import BYTE_SALT, Block, powers

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a worker remembers.
MEMORY = 2_000_000
#: Longest pre-token, blank included, that the trie holds, and pre-tokens that are laid out at once.
TRIE_BYTES = 48
TRIE_WORDS = 1 << 15
#: Words of a block that are looked up at once, and bytes of a long pre-token.
WORDS_AT_ONCE = 1 << 18
SLICE = 1 << 16
_KEEP = np.arange(256, dtype=np.uint8)
_TOP = 44

U = np.uint64


@lru_cache(maxsize=2)
def pieces_of(path: str) -> dict[bytes, float | None]:
    """Log-probability of each piece; None for what is only the end of a piece."""
    with open(path) as lines:  # the tokenizer files are installed on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    scores = {piece: -math.log(rank + 1) for piece, rank in ranks.items()}
    last = -math.log(len(ranks) + 1)
    for byte in range(256):
        scores[bytes([byte])] = last
    ends = {piece[i:] for piece in scores for i in range(1, len(piece))}
    return dict.fromkeys(ends) | scores


class Counter:
    """A worker's piece table and the counts of the pre-tokens that it has met."""

    _made: dict[str, Counter] = {}

    def __init__(self, pieces: dict[bytes, float | None]):
        self.longest = max(map(len, pieces))
        self.powers = powers(self.longest, False)
        scores = np.array([math.nan if s is None else s for s in pieces.values()])
        keys = np.zeros(len(pieces), dtype=U)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):  # as hashed from a node backwards
                has = size >= k
                keys[has] += BYTE_SALT[flat[end[has] - k]] * self.powers[k - 1]
        order = np.argsort(keys)
        self.keys, self.scores = np.r_[keys[order], U(0)], scores[order]
        self.first = np.searchsorted(keys[order], np.arange((1 << (64 - _TOP)) + 1, dtype=U) << U(_TOP))
        self.first[-1] = len(keys)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Counter:
        """The worker's counter for a vocabulary."""
        if path not in cls._made:
            cls._made[path] = cls(pieces_of(path))
        return cls._made[path]

    def forget(self) -> None:
        self.known, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key in the piece table, -1 where it isn't there."""
        top = (key >> U(_TOP)).astype(np.int64)
        place, last = self.first[top], self.first[top + 1]
        out = np.full(len(key), -1)
        open_ = np.flatnonzero(place < last)
        while len(open_):
            at = place[open_]
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = at[hit]
            place[open_] += 1
            open_ = open_[~hit & (at + 1 < last[open_])]
        return out

    def pieces_before(self, data: np.ndarray, end: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places in `end`, scores) of the pieces that end at each of these positions, within `room` bytes."""
        at, key = np.arange(len(end)), np.zeros(len(end), dtype=U)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                wide = room[at] >= k
                at, key = at[wide], key[wide]
                if not len(at):
                    return
                key = key + BYTE_SALT[data[end[at] - k]] * self.powers[k - 1]
                place = self.find(key)
                found = place >= 0  # no piece ends like the others, nor with anything longer
                at, key = at[found], key[found]
                score = self.scores[place[found]]
                real = ~np.isnan(score)
                yield k, at[real], score[real]

    def by_trie(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of pre-tokens, the rows of a matrix of zero-padded bytes, by one trie of them."""
        width = words.shape[1]
        order = np.lexsort((size, np.ascontiguousarray(words).view(f"S{width}").ravel()))
        words, size = words[order], size[order]
        same = np.cumprod(words[1:] == words[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        shared = np.r_[0, np.minimum(same, np.minimum(size[1:], size[:-1]))]
        depth = np.arange(1, width + 1)[:, None]
        new = (depth > shared) & (depth <= size)  # by depth, then in the order of the words
        deep, word = np.nonzero(new)
        deep += 1
        node = np.zeros((width + 1, len(words)), dtype=np.int64)  # by depth and word; 0 is the root
        node[deep, word] = np.arange(1, len(deep) + 1)
        np.maximum.accumulate(node, axis=1, out=node)  # what isn't new is the last word's that was
        begins = np.r_[0, np.cumsum(new.sum(axis=1))] + 1  # first node of each depth
        flat = words.ravel()
        end = word * width + deep
        edges = []
        for k, at, score in self.pieces_before(flat, end, deep):
            edges.append((at + 1, node[deep[at] - k, word[at]], score, np.searchsorted(at + 1, begins)))
        best, fewest = np.full(len(deep) + 1, -np.inf), np.zeros(len(deep) + 1, dtype=np.int64)
        best[0] = 0.0
        for d in range(width):
            for to, source, score, bound in edges[: d + 1]:
                a, b = bound[d], bound[d + 1]
                if a < b:
                    into, before = to[a:b], source[a:b]
                    total, many = best[before] + score[a:b], fewest[before] + 1
                    better = (total > best[into]) | ((total == best[into]) & (many < fewest[into]))
                    best[into[better]], fewest[into[better]] = total[better], many[better]
        out = np.zeros(len(words), dtype=np.int64)
        out[order] = fewest[node[size, np.arange(len(words))]]
        return out

    def by_window(self, word: np.ndarray) -> int:
        """Count of one long pre-token (without its blank), slice by slice."""
        best, fewest, origin = [0.0], [0], 0  # of the positions from `origin` on
        n = len(word) + 1
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            low = max(0, a - self.longest)
            data = np.r_[np.uint8(32), word[: b - 1]] if low == 0 else word[low - 1 : b - 1]
            end = np.arange(a + 1, b + 1)
            found = [(end[at], np.full(len(at), k), s) for k, at, s in self.pieces_before(data, end - low, end - low)]
            to, size, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(to, kind="stable")
            at, top, many = a, 0.0, 0
            for e, k, s in zip(to[order].tolist(), size[order].tolist(), score[order].tolist(), strict=True):
                if e != at:
                    if at > a:
                        best.append(top)
                        fewest.append(many)
                    at, top, many = e, -math.inf, 0
                total, pieces = best[e - k - origin] + s, fewest[e - k - origin] + 1
                if total > top or (total == top and pieces < many):
                    top, many = total, pieces
            best.append(top)
            fewest.append(many)
            gone = max(0, len(best) - self.longest - 1)
            best, fewest, origin = best[gone:], fewest[gone:], origin + gone
        return fewest[-1]

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Count new words; keys are sorted and unknown so far."""
        counts = np.zeros(len(keys), dtype=np.int64)
        size = ends - starts + 1
        short = np.flatnonzero(size <= TRIE_BYTES)
        short = short[np.argsort(size[short], kind="stable")]  # words of like length share a matrix
        for a in range(0, len(short), TRIE_WORDS):
            some = short[a : a + TRIE_WORDS]
            n = size[some]
            words = np.zeros((len(some), int(n.max())), dtype=np.uint8)
            words[:, 0] = 32
            row = np.repeat(np.arange(len(some)), n - 1)
            column = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n - 1)[:-1]], n - 1)
            words[row, column + 1] = data[starts[some][row] + column]
            counts[some] = self.by_trie(words, n)
        for i in np.flatnonzero(size > TRIE_BYTES):
            counts[i] = self.by_window(data[starts[i] : ends[i]])
        place = np.searchsorted(self.known, keys)
        self.known, self.counts = np.insert(self.known, place, keys), np.insert(self.counts, place, counts)

    def count(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Count of each word."""
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[place] != keys if len(self.known) else np.ones(len(keys), dtype=bool)
        if new.any():
            self.learn(data, keys[new], starts[at[new]], ends[at[new]])
            place = np.searchsorted(self.known, keys)
        return self.counts[place][which]


def count_block(block: Block, path: str) -> dict[str, object]:
    """Words and tokens of each text of a block."""
    counter = Counter.of(path)
    starts, ends, doc = block.words()
    hashes = block.hashes(starts, ends, _KEEP)
    tokens = np.zeros(block.n, dtype=np.int64)
    for a in range(0, len(starts), WORDS_AT_ONCE):
        part = slice(a, a + WORDS_AT_ONCE)
        counts = counter.count(block.data, hashes[part], starts[part], ends[part])
        tokens += np.bincount(doc[part], weights=counts, minlength=block.n).astype(np.int64)
    return {"n_words": np.bincount(doc, minlength=block.n), "n_tokens": tokens}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_texts(rows, lambda block: count_block(block, path), [("n_words", "long"), ("n_tokens", "long")], ["doc_id"])
