"""Language identification by language-bitmask n-gram filters.

For each language the n-grams (four bytes of lower-cased letters, with word ends as blanks) of its training texts go
into a Bloom filter. The filters of all languages are bit-sliced: they share the slots, and a slot holds one bit for each
language. The slots of an n-gram, combined by AND, name all languages that contain it, in one look-up for all of them.
A text's n-grams are counted per language; the count is corrected by the filter's false-positive rate, known from its
share of set bits, and by the language's coverage: the share of a further text's n-grams that its training texts can be
expected to hold, 1 - (n-grams met once) / (all met). The language with the largest corrected share is the prediction, and
that share is the score.

The filters are fitted on a bounded sample of labelled rows: of each language with n of them, those whose hash of doc_id
and text falls below `MAX_SAMPLE` / n of its range, so about `MAX_SAMPLE`, and all where there are no more; equal texts
of a language count once. All n-grams of the sample are kept: the number of slots follows from theirs. Slots are set in
tasks, a page of slots in each group; the driver gets the filter itself and no list of n-grams.

Edge cases: a text that is null or has no letter is `und` with score 0; of equal shares, and where no n-gram is known (with
score 0), the language with most training documents is taken (ties: the first by name); without any training row everything
is `und`; rows with equal doc_id are predicted each by its own text; a null doc_id hashes as
the empty string and is trained on like others. A very long text is read in slices, in some 10 bytes of memory a byte. An
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import bound_batches, cut, map_texts
from graticule.llm.textkernel import Block

#: Training documents of a language, about.
MAX_SAMPLE = 1500
#: Languages that are told apart at most, and bytes of all filters: both are sent to every task, so more of either is an error.
MAX_LANGUAGES, MAX_FILTER = 1000, 512 << 20
#: Look-ups for each n-gram, slots for each n-gram of the largest language, and the least number of slots (as a power of two).
LOOKUPS = 3
SPARSE = 12
LEAST_BITS = 16
#: Slots that are set in one group.
PAGE_BITS = 16
#: Bytes of a long text that are worked on at once.
SLICE = 1 << 20
#: Coverage that is never fallen below in corrections, and coverage that counts as full.
LEAST_COVERAGE, FULL_COVERAGE = 0.2, 0.95
UNDETERMINED = "und"
#: Stands for a text among the n-grams that are counted.
TEXT = -1
#: Files of the counts, which are those of a bounded sample.
FILES = 32

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of all texts as 32-bit numbers, and the text of each, some at a time. Inner blanks end an n-gram."""
    n = block.n
    # two blanks before each text and one after the last, so that no n-gram spans texts
    folded = np.full(len(block.data) + 2 * n + 2, 32, dtype=np.uint8)
    low = _FOLD[block.data]
    if len(low) > 1:  # capitals of the two-byte Latin letters
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][second] += 0x20
    if n == 1:
        folded[2:-2] = low
    else:
        folded[np.arange(len(low)) + np.repeat(2 * np.arange(1, n + 1), np.diff(block.offsets))] = low
    starts = block.offsets[:-1] + 2 * np.arange(n)
    for at in range(0, max(len(folded) - 3, 0), SLICE):
        part = folded[at : at + SLICE + 3]
        a, b, c, d = part[:-3], part[1:-2], part[2:-1], part[3:]
        whole = np.flatnonzero((b != 32) & ((c != 32) | (d == 32)))
        code = a[whole].astype(np.uint32) | b[whole].astype(np.uint32) << 8 | c[whole].astype(np.uint32) << 16 | d[whole].astype(np.uint32) << 24
        yield code, np.searchsorted(starts, whole + at, side="right") - 1


def slots(code: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th slot of each n-gram."""
    odd = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[i]
    with np.errstate(over="ignore"):
        x = code * np.uint32(odd)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - bits)


@dataclass(frozen=True)
class Filters:
    """Bit-sliced filters: `masks[j][slot]` holds the bits of the languages 8j to 8j+7."""

    languages: list[str]
    texts: np.ndarray
    masks: np.ndarray
    false_rate: np.ndarray
    coverage: np.ndarray

    def counts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language contains."""
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        wide = int(self.masks.shape[1]).bit_length() - 1
        total, hits = np.zeros(block.n, dtype=np.int64), np.zeros((block.n, 8 * len(self.masks)), dtype=np.int64)
        for code, doc in grams(block):
            places = [slots(code, i, wide) for i in range(LOOKUPS)]
            for j, mask in enumerate(self.masks):
                held = mask[places[0]]
                for place in places[1:]:
                    held = held & mask[place]
                hits[:, 8 * j : 8 * j + 8] += np.bincount(doc * 256 + held, minlength=block.n * 256).reshape(block.n, 256) @ bits
            total += np.bincount(doc, minlength=block.n)
        return total, hits[:, : len(self.languages)]

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        letters = has_letter(block)
        if not self.languages:
            return np.full(block.n, UNDETERMINED, dtype=object), np.zeros(block.n)
        total, hits = self.counts(block)
        coverage = np.where(self.coverage < FULL_COVERAGE, np.maximum(self.coverage, LEAST_COVERAGE), 1)
        right = np.maximum((hits - self.false_rate * total[:, None]) / (1 - self.false_rate), 0) / coverage
        order = np.argsort(-self.texts, kind="stable")  # among equals, and where nothing is known, the first of these
        best = order[np.round(right, 9)[:, order].argmax(axis=1)]
        names = np.array(self.languages, dtype=object)[best]
        score = np.clip(right[np.arange(block.n), best] / np.maximum(total, 1), 0, 1)
        return np.where(letters, names, UNDETERMINED), np.where(letters, score, 0.0)


def has_letter(block: Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    letters = np.flatnonzero(_ASCII_LETTER[block.data])
    out = np.searchsorted(letters, block.offsets[1:]) > np.searchsorted(letters, block.offsets[:-1])
    for i in np.flatnonzero(~out & (np.diff(block.offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in block.text(i).decode("utf-8", "replace"))
    return out


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def sample(docs: DataFrame, max_sample: int) -> DataFrame:
    """(lang, text), the training texts: of equal texts of a language one."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))  # a row for each language
    if sizes.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"the documents have more than {MAX_LANGUAGES} languages")
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") * F.col("_n") < F.lit(float(max_sample) * 2.0**53)
    near = rows.where("text is not null").join(F.broadcast(sizes), "lang").where(drawn).select("lang", "text", F.xxhash64("text").alias("mark"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # as many as the sample has, so that a text of many rows leaves a task once
        for batch in batches:
            fresh = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh))

    return near.mapInArrow(first, near.schema).dropDuplicates(["lang", "mark"]).select("lang", "text")


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Filters:
    """Filters from about max_sample documents of each language outside the held-out fold."""

    def count(block: Block) -> dict[str, object]:
        owner = np.concatenate([(doc.astype(np.uint64) << np.uint64(32)) | code for code, doc in grams(block)] or [np.zeros(0, np.uint64)])
        owner, many = np.unique(owner, return_counts=True)
        edge = np.searchsorted(owner >> np.uint64(32), np.arange(block.n + 1))
        low = (owner & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts = list(zip(edge[:-1], edge[1:], strict=True))
        return {"grams": [np.r_[TEXT, low[a:b]] for a, b in parts], "many": [np.r_[1, many[a:b]] for a, b in parts]}

    counted = map_texts(sample(docs, max_sample), count, [("grams", "array<long>"), ("many", "array<long>")], ["lang"])
    each = counted.select("lang", F.explode(F.arrays_zip("grams", "many")).alias("_g")).groupBy("lang", F.col("_g.grams").alias("gram")).agg(F.sum("_g.many").alias("many"))
    each = cut(each.coalesce(FILES))
    real = F.col("gram") != TEXT
    facts = each.groupBy("lang").agg(
        F.sum(F.when(~real, F.col("many"))).alias("texts"),
        F.sum(F.when(real, 1).otherwise(0)).alias("kinds"),
        F.sum(F.when(real, F.col("many")).otherwise(0)).alias("met"),
        F.sum(F.when(real & (F.col("many") == 1), 1).otherwise(0)).alias("once"),
    )
    known = {r["lang"]: r for r in facts.collect()}  # a row for each language
    languages = sorted(known)
    if not languages:
        return Filters([], np.zeros(0, np.int64), np.zeros((1, 1 << LEAST_BITS), np.uint8), np.zeros(0), np.zeros(0))
    most = max((r["kinds"] for r in known.values()), default=1)
    bits = min(31, max(LEAST_BITS, int(SPARSE * most - 1).bit_length()))
    layers = -(-len(languages) // 8)
    if layers << bits > MAX_FILTER:
        raise ValueError(f"filters of {len(languages)} languages with up to {most} n-grams take more than {MAX_FILTER} bytes")
    of = {lang: i for i, lang in enumerate(languages)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            lang = np.array([of[x] for x in batch.column(0).to_pylist()], dtype=np.int32)
            slot = np.concatenate([slots(code, k, bits) for k in range(LOOKUPS)]).astype(np.int64)
            lang = np.tile(lang, LOOKUPS)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> PAGE_BITS), pa.array((slot & ((1 << PAGE_BITS) - 1)).astype(np.int32)), pa.array(lang)], ["page", "slot", "lang"])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros((layers, 1 << PAGE_BITS), dtype=np.uint8)
        lang = frame["lang"].to_numpy()
        np.bitwise_or.at(page, (lang // 8, frame["slot"].to_numpy()), (1 << lang % 8).astype(np.uint8))
        return pd.DataFrame({"page": frame["page"].iloc[:1], "bits": [page.tobytes()]})

    pages = each.where(real).select("lang", "gram").mapInArrow(spread, "page long, slot int, lang int").groupBy("page").applyInPandas(fill, "page long, bits binary")
    masks = np.zeros((layers, 1 << bits), dtype=np.uint8)
    for row in pages.collect():  # the filter itself
        at = row["page"] << PAGE_BITS
        masks[:, at : at + (1 << PAGE_BITS)] = np.frombuffer(row["bits"], np.uint8).reshape(layers, -1)[:, : (1 << bits) - at]
    full = np.array([((masks[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    coverage = np.array([1 - known[x]["once"] / max(known[x]["met"], 1) for x in languages])
    return Filters(languages, np.array([known[x]["texts"] for x in languages]), masks, full**LOOKUPS, coverage)


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The kept columns, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(block: Block) -> dict[str, object]:
        names, score = shared.value.predict(block)
        return {"lang_pred": names, "score": score}

    return map_texts(docs, run, [("lang_pred", "string"), ("score", "double")], keep)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, with filters learned from the table itself."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return predict(rows, train(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
