"""Best-two-fit packing of tokenised documents into sequences.

Documents are tokenised with a public tokenizer, ended by a separator id, and cut into pieces of at most `capacity`
tokens; only documents longer than that are cut. The pieces are dealt by a hash into groups of about `GROUP` pieces, and
each group is packed by itself: a bin is filled greedily with the largest piece that fits until none fits; then its
smallest piece is taken out and, where two unpacked pieces fit the expanded gap more tightly than that piece did, they
replace it, until no exchange tightens the bin. Pieces are held as lists by length, so the work of a bin depends on the
capacity, not on the number of pieces; a group loses less than one sequence in its last bin.

Tokenising: texts made of ASCII and two-byte Latin letters are lower-cased and cut into pre-tokens (runs of letters,
single digits, runs of other marks) by array operations; ids are looked up for each distinct pre-token, which the
tokenizer itself encodes once. Every other text (other scripts, apostrophes, which begin contractions, and texts that may
hold a special token) goes to the tokenizer as a whole. Both give the tokenizer's own ids. A text of more than a megabyte is
tokenised in parts that begin after white space, which no token spans; only a run without any blank stays whole.

Groups: the pieces are dealt by a hash of the piece and its number among equal ones, so that a group stays small whatever
share of all pieces is equal.

Edge cases: a null or empty text is one piece of length 1 (the separator); repeated rows and equal doc_id are
documents of their own, each with its pieces; a null doc_id is kept; of pieces of one length the greater doc_id, piece and
checksum are placed first, equal ones in any order; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import bound_batches, cut, maybe_broadcast
from graticule.llm.textkernel import BLOCK_BYTES, Block, blocks, slices

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces that are packed together, about.
GROUP = 50_000
#: Distinct pre-tokens whose ids a worker remembers; beyond that it forgets the half that it has not met for longest.
MEMORY = 700_000

# Classes of bytes in texts of ASCII and two-byte Latin letters: 0 blank, 1 letter, 2 digit, 3 mark.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 1


def plain(block: Block) -> np.ndarray:
    """Texts that the array path handles: ASCII without apostrophes and "<|", and letters U+00C0 to U+00FF."""
    data = block.data
    odd = (data >= 128) & (data != 0xC3)
    odd[1:] &= ~((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd |= data == 39
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    upto = np.r_[0, np.cumsum(odd)]
    return upto[block.offsets[1:]] == upto[block.offsets[:-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    if len(low) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the pre-tokens of plain texts."""
    if not len(block.data):
        return (np.zeros(0, np.int64),) * 3
    kind = _CLASS[block.data]
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    heads = block.offsets[:-1]
    change[heads[heads < len(kind)]] = True
    starts = np.flatnonzero(change)
    ends = np.r_[starts[1:], len(kind)]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, block.doc_of(starts)


class Encoder:
    """Token ids of texts, with the ids of known pre-tokens in one long array."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder of this vocabulary."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Start with an empty memory: keys in order, where their ids are and how many, and when each was last met."""
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.many, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.now = 0

    def forget_half(self) -> None:
        kept = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        many = self.many[kept]
        first = np.r_[0, np.cumsum(many, dtype=np.int64)[:-1]]
        self.ids = self.ids[np.repeat(self.first[kept] - first, many) + np.arange(int(many.sum()))]
        self.keys, self.first, self.many, self.met = self.keys[kept], first, many, self.met[kept]

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode new pre-tokens; keys are sorted and unknown so far."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        many = np.fromiter((len(x) for x in found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(many.sum()))
        first = len(self.ids) + np.r_[0, np.cumsum(many, dtype=np.int64)[:-1]]
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.keys, keys)
        self.first, self.many, self.met = np.insert(self.first, place, first), np.insert(self.many, place, many), np.insert(self.met, place, self.now)
        self.keys = np.insert(self.keys, place, keys)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's ids begin (one entry more than texts)."""
        if block.n == 1 and len(block.data) > BLOCK_BYTES:
            parts = list(slices(block))
            if len(parts) > 1:
                ids = np.concatenate([self.encode(part)[0] for part in parts])
                return ids, np.array([0, len(ids)])
        low = Block(lowered(block.data), block.offsets, block.null)
        simple = plain(block)
        starts, ends, doc = pretokens(low)
        mine = simple[doc]
        starts, ends, doc = starts[mine], ends[mine], doc[mine]
        hashes = low.hashes(starts, ends, np.arange(256, dtype=np.uint8))
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MEMORY:
            self.forget_half()
        self.now += 1
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            view = low.data
            self.learn(keys[new], [view[a:b].tobytes().decode() for a, b in zip(starts[at[new]], ends[at[new]], strict=True)])
        place = np.searchsorted(self.keys, keys)
        self.met[place] = self.now
        first, many = self.first[place][which], self.many[place][which]
        own = [block.text(i).decode("utf-8", "replace") for i in np.flatnonzero(~simple)]
        others = iter([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)] if own else [])
        ids = self.ids[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))] if len(many) else np.zeros(0, np.uint32)
        per = np.bincount(doc, weights=many, minlength=block.n).astype(np.int64)
        if simple.all():
            return ids, np.r_[0, np.cumsum(per)]
        edge = np.r_[0, np.cumsum(per)]
        parts = [ids[edge[i] : edge[i + 1]] if simple[i] else next(others) for i in range(block.n)]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document (kept columns only on first pieces)."""
    keep = keep or []
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for at, block in blocks(batch.column(1)):
                ids, first = encoder.encode(block)
                out: list[tuple[int, int, int, int, int]] = []
                for i in range(block.n):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(SEPARATOR)).astype("<u4")
                    for p, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        out.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
                owner, *columns = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                ids_of = batch.column(0).slice(at, block.n).take(pa.array(owner))
                extra = [batch.column(2 + k).slice(at, block.n).take(pa.array(owner)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(columns[0].astype(np.int32)), *[pa.array(c) for c in columns[1:]], *extra], [*names, *keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, bins filled one after the other."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stacks[lengths[i]].append(int(i))
    left = 0  # bit L: some unpacked piece has length L
    for size, stack in enumerate(stacks):
        if stack:
            left |= 1 << size

    def largest(most: int) -> int:
        """Length of the largest unpacked piece of at most this length, 0 if there is none."""
        return (left & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and left & ((1 << (most + 1)) - 1) else 0

    def take(size: int) -> int:
        nonlocal left
        item = stacks[size].pop()
        if not stacks[size]:
            left ^= 1 << size
        return item

    def give(size: int, item: int) -> None:
        nonlocal left
        stacks[size].append(item)
        left |= 1 << size

    def best_pair(gap: int, more_than: int) -> tuple[int, int]:
        """Two lengths of unpacked pieces with the largest sum in (more_than, gap]; (0, 0) if there are none."""
        found, best = (0, 0), more_than
        a = largest(gap - 1)
        while a and 2 * a > best:
            b = largest(min(a, gap - a))
            if b == a and len(stacks[a]) < 2:
                b = largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = largest(a - 1)
        return found

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while left:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while size := largest(gap):
            inside.append((size, take(size)))
            gap -= size
        while gap and inside and left:
            size, item = inside[-1]  # filled by falling length: the last is the smallest
            a, b = best_pair(gap + size, size)
            if not a:
                break
            inside.pop()
            first, second = take(a), take(b)
            give(size, item)
            inside += [(a, first), (b, second)]
            inside.sort(reverse=True)
            gap += size - a - b
        at = 0
        for size, item in inside:
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of `rows` (doc_id, piece, length and more) with sequence_id and offset."""
    n = rows.count()
    groups = max(1, -(-n // group))
    named = ["doc_id", "piece", "ids_crc32"]
    often = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > max(1, group // 10))  # ten of a group at most
    share = F.xxhash64(*named)
    if often.limit(1).count():  # equal pieces that would fill a group go round all groups, from their partition's place on
        few = maybe_broadcast(often.select(*[F.col(c).alias(f"_{c}") for c in named]), often.count())
        meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named])
        # numbered before the join, on rows that are read again in the same order
        rows = rows.withColumn("_nth", F.monotonically_increasing_id()).join(few, meet, "left")
        rows = rows.withColumn("_nth", F.when(F.col("_piece").isNotNull(), F.col("_nth")).otherwise(F.lit(0)))
        rows, share = rows.drop("_doc_id", "_piece", "_ids_crc32"), F.xxhash64(*named, "_nth")
    dealt = rows.withColumn("_group", F.pmod(share, F.lit(groups)).cast("long")).drop("_nth")
    rows = dealt.drop("_group")
    columns = [f for f in rows.schema.fields]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        out = frame.drop(columns="_group")
        out["sequence_id"] = bins * groups + int(frame["_group"].iloc[0])
        out["offset"] = offsets
        return out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(pack, ddl)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP, keep: list[str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    rows = cut(pieces(docs, vocabulary, capacity, keep))
    return pack_pieces(rows, capacity, group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(keep or []))
