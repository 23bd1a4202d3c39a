"""BM25 over batches of texts as array kernels.

A chunk is one row, so its term frequencies are counted in the row and nothing of a text is exchanged: one pass over the
texts counts the document frequencies of the queries' terms, a second scores a block of chunks against all queries as a
product of two small matrices (chunks by terms, terms by queries) and passes on the best of each query. What travels to
the tasks is the batch of queries, whose size is checked by the caller; what comes back from a block is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.batches import bound_batches

#: Text bytes that are scored at once, and queries.
BLOCK_BYTES = 1 << 21
QUERY_BLOCK = 1024

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
# Bytes of a token after lower-casing, and the two-byte letters that fold to ASCII.
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[97:123] = _TOKEN[48:58] = True
_PAIRS = ((0xC4, 0xB1), (0xC5, 0xBF))


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (multiply, shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


_BYTE = _spread(np.arange(1, 257, dtype=U) * U(_BASE))


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(n, 1), base, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each token of lower-cased texts, and the text it is in."""
    starts, ends, doc = token_spans(data, offsets)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * _powers(len(data), _BASE), out=total[1:])
        raw = (total[ends] - total[starts]) * _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))[starts]
        return _spread(raw + (ends - starts).astype(U)), doc


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token of lower-cased texts, and the text it is in."""
    inside = _TOKEN[data]
    for first, second in _PAIRS:
        both = np.flatnonzero((data[:-1] == first) & (data[1:] == second))
        inside[both] = inside[both + 1] = True
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.r_[False, inside]
    after = np.r_[inside, False]
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of blocks of an Arrow string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass(frozen=True)
class Batch:
    """Queries as arrays: their ids, the hashes of all their terms in order, and (query, term) for each term of a query."""

    qids: list
    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray

    @staticmethod
    def of(rows: list[tuple], lowered: list[str]) -> Batch:
        """From (qid, lower-cased text) pairs; a query's repeated terms count once."""
        ids = list(dict.fromkeys(rows))
        place = {q: i for i, q in enumerate(ids)}
        parts = []
        for _, _, data, offsets in [(0, 0, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in lowered]:
            parts.append(token_hashes(data, offsets)[0] if len(data) else np.zeros(0, U))
        owner = np.repeat(np.array([place[q] for q in rows], dtype=np.int64), [len(p) for p in parts]) if rows else np.zeros(0, np.int64)
        terms, term = np.unique(np.concatenate([*parts, np.zeros(0, U)]), return_inverse=True)
        pairs = np.unique(np.stack([owner, term], axis=1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
        return Batch(ids, terms, pairs[:, 0], pairs[:, 1])


def matched(data: np.ndarray, offsets: np.ndarray, n: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; and (text, term, frequency) of the wanted terms."""
    hashes, doc = token_hashes(data, offsets)
    length = np.bincount(doc, minlength=n)
    if not len(terms):
        return length, *(np.zeros(0, np.int64),) * 3
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    wanted = terms[place] == hashes
    key, tf = np.unique(doc[wanted] * len(terms) + place[wanted], return_counts=True)
    return length, key // len(terms), key % len(terms), tf


def term_counts(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf, length) of every term of every chunk, counted in the task that reads the chunk; nothing is exchanged."""
    bound_batches(chunks.sparkSession)
    held = chunks.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at, n, data, offsets in text_blocks(part.column(1)):
                hashes, doc = token_hashes(data, offsets)
                if not len(hashes):
                    continue
                order = np.lexsort((hashes, doc))
                new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
                head = np.flatnonzero(new)
                one, tf = order[head], np.diff(np.r_[head, len(order)])
                starts, ends, _ = token_spans(data, offsets)
                many = ends[one] - starts[one]
                upto = np.r_[0, np.cumsum(many)]
                spelled = data[np.repeat(starts[one] - upto[:-1], many) + np.arange(upto[-1])]
                terms = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(spelled)).cast(pa.string())
                length = np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, n).take(pa.array(doc[one])), terms, pa.array(tf.astype(np.int64)), pa.array(length[doc[one]].astype(np.int64))], [key, "term", "tf", "length"])

    return held.mapInArrow(run, f"`{key}` {chunks.schema[key].dataType.simpleString()}, term string, tf long, length long")


def frequencies(chunks: DataFrame, batch: Batch, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Chunks with a token, their tokens, and the chunks that have each term of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, facts = np.zeros(len(batch.terms), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for part in batches:
            for _, n, data, offsets in text_blocks(part.column(0)):
                length, _, term, _ = matched(data, offsets, n, batch.terms)
                df += np.bincount(term, minlength=len(df))
                facts += [int((length > 0).sum()), int(length.sum())]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[facts, df[some]])], ["term", "n"])

    bound_batches(chunks.sparkSession)
    counted = chunks.select(F.lower(F.coalesce(text, F.lit(""))).alias("text")).mapInArrow(run, "term long, n long")
    found = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each of the batch's terms at most
    df = np.zeros(len(batch.terms), dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return int(found.get(-1) or 0), int(found.get(-2) or 0), df


def mean_length(n: int, total: int) -> float:
    """Mean number of tokens to six decimals, as it is stored; never 0."""
    return max(float(Decimal(repr(total / n)).quantize(Decimal("1e-6"), ROUND_HALF_UP)), 1e-9) if n else 1e-9


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each column (rounded to nine decimals, ties by id); rows may be fewer."""
    near = np.round(score, 9)
    if ids.dtype == object:  # ids that are strings: their places in order
        ids = np.unique(ids.astype(str), return_inverse=True)[1]
    if len(ids) > k:
        fence = np.partition(near, len(ids) - k, axis=0)[len(ids) - k]
        row, column = np.nonzero((near >= fence) & (near > -np.inf))
    else:
        row, column = np.nonzero(near > -np.inf)
    order = np.lexsort((ids[row], -near[row, column], column))
    row, column = row[order], column[order]
    first = np.searchsorted(column, column)
    kept = np.arange(len(column)) - first < k
    return row[kept], column[kept]


def score_chunks(chunks: DataFrame, batch: Batch, weights: np.ndarray, avgdl: float, k: int, k1: float, b: float, routes: dict[int, list[int]] | None = None, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(qid, key, score): for each block of chunks the k best of each query that share a term with it.

    weights: idf of each term. routes: for the place of a query, the only page marks (column `_page`) that it may find.
    """
    bound_batches(chunks.sparkSession)
    routed = routes is not None
    columns = [key, F.lower(F.coalesce(text, F.lit(""))).alias("text"), *(["_page"] if routed else [])]
    held = chunks.select(*columns)
    marks = np.array(sorted({p for pages in (routes or {}).values() for p in pages}), dtype=np.int64)
    pairs = np.array([(np.searchsorted(marks, p), q) for q, pages in (routes or {}).items() for p in pages], dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    bound = np.array([q in (routes or {}) for q in range(len(batch.qids))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = np.array(batch.qids)
        for part in batches:
            for at, n, data, offsets in text_blocks(part.column(1)):
                length, row, term, tf = matched(data, offsets, n, batch.terms)
                if not len(row):
                    continue
                ids = part.column(0).slice(at, n).to_numpy(zero_copy_only=False)
                present, column = np.unique(term, return_inverse=True)
                worth = weights[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length[row], 1) / avgdl))
                mine = np.zeros((n, len(present)))
                mine[row, column] = worth
                place = np.full(len(batch.terms), -1)
                place[present] = np.arange(len(present))
                pages = part.column(2).slice(at, n).to_numpy(zero_copy_only=False) if routed else None
                for q in range(0, len(qids), QUERY_BLOCK):
                    inside = slice(*np.searchsorted(batch.query, (q, q + QUERY_BLOCK)))
                    asked, of = place[batch.term[inside]], batch.query[inside] - q
                    asked, of = asked[asked >= 0], of[asked >= 0]
                    wide = min(QUERY_BLOCK, len(qids) - q)
                    has = np.zeros((len(present), wide))
                    has[asked, of] = 1
                    score = mine @ has
                    score[score <= 0] = -np.inf
                    if routed:
                        score[_outside(pages, marks, pairs, bound[q : q + wide], q)] = -np.inf
                    r, c = best(score, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q + c]), pa.array(ids[r]), pa.array(score[r, c])], ["qid", key, "score"])

    named = "string" if batch.qids and isinstance(batch.qids[0], str) else "long"
    return held.mapInArrow(run, f"qid {named}, `{key}` {chunks.schema[key].dataType.simpleString()}, score double")


def _outside(pages: np.ndarray, marks: np.ndarray, pairs: np.ndarray, bound: np.ndarray, first: int) -> np.ndarray:
    """Which (chunk, query) a query's routes leave out, for the queries from `first` on."""
    out = np.tile(bound, (len(pages), 1))
    if len(marks):
        mark = np.minimum(np.searchsorted(marks, pages), len(marks) - 1)
        known = np.flatnonzero(marks[mark] == pages)
        a, b = np.searchsorted(pairs[:, 0], mark[known]), np.searchsorted(pairs[:, 0], mark[known], side="right")
        row = np.repeat(known, b - a)
        which = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange(len(row))
        query = pairs[which, 1] - first
        near = (query >= 0) & (query < len(bound))
        out[row[near], query[near]] = False
    return out
