"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of byte classes, word and line lengths, repetition of words, runs of words and
lines) are computed by array operations over blocks of texts. The trees are grown level by level from per-bin sums of
gradients and second derivatives of the logistic loss, then flattened into arrays, so that all documents of a block walk
down a tree together.

The trees are fitted on a bounded sample: the `MAX_SAMPLE` labelled rows of smallest hash (of doc_id, then of the text).
Only text statistics enter a score.

Edge cases: a null text scores as an empty one, and an empty one as its statistics say (0, but 1 for the shares of distinct
words, runs and lines); several labels of one document vote, a tie counts as 0; null labels are left out; without any label
every score is 0.5; rows with one doc_id are scored each by its own text, and each is a training row; a null doc_id hashes
as the empty string and has no label. A very long text is read whole, in some 16 bytes of memory a byte (bytes are counted
a stride at a time; what grows are the positions and hashes of its words). An empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import map_texts
from graticule.llm.textkernel import LOWER, STRIDE, Block, shingle_hashes

#: Labelled rows that the trees are fitted on, at most.
MAX_SAMPLE = 20_000
#: A document is kept from this score on.
THRESHOLD = 0.3

_CLASSES = {
    "upper": [(65, 90)],
    "lower": [(97, 122)],
    "digit": [(48, 57)],
    "blank": [(9, 9), (11, 13), (32, 32)],
    "newline": [(10, 10)],
    "stop": [(44, 44), (46, 46), (58, 59), (63, 63)],
    "bang": [(33, 33)],
    "mark": [(35, 38), (42, 43), (60, 62), (64, 64), (94, 96), (124, 124), (126, 126)],
    "bracket": [(34, 34), (39, 41), (45, 45), (47, 47), (91, 93), (123, 123), (125, 125)],
    "control": [(0, 8), (14, 31), (127, 127)],
    "high": [(128, 255)],
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _ranges in enumerate(_CLASSES.values()):
    for _a, _b in _ranges:
        _MEMBER[_a : _b + 1, _i] = 1
_IS_MARK = _MEMBER[:, 6] + _MEMBER[:, 7] > 0

FEATURES = [
    *(f"share_{c}" for c in _CLASSES),
    *("log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "line_words", "byte_entropy"),
    *("distinct_words", "top_word", "same_as_previous", "caps_words", "marked_words", "distinct_runs", "top_run", "distinct_lines", "top_line"),
]


def _repetition(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and share of the most frequent value, per document (1 and 0 without values)."""
    if n == 1:
        counts, key = np.array([len(hashes)]), np.sort(hashes >> np.uint64(24))
    else:
        counts = np.bincount(doc, minlength=n)
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    if not len(key):
        return np.ones(n), np.zeros(n)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    runs = np.diff(np.r_[first, len(key)])
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, runs)
    some = np.maximum(counts, 1)
    return np.where(counts > 0, distinct / some, 1.0), top / some


def _byte_counts(block: Block) -> np.ndarray:
    """How often each byte occurs in each text."""
    if block.n == 1:
        return sum((np.bincount(block.data[a : a + STRIDE], minlength=256) for a in range(0, len(block.data), STRIDE)), np.zeros(256, np.int64))[None, :]
    owner = np.repeat(np.arange(block.n), np.diff(block.offsets))
    return np.bincount(owner * 256 + block.data, minlength=block.n * 256).reshape(block.n, 256)


def statistics(block: Block) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, data, offsets = block.n, block.data, block.offsets
    size = np.diff(offsets)
    share = _byte_counts(block) / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, doc = block.words()
    words = np.bincount(doc, minlength=n) if n > 1 else np.array([len(doc)])
    w = np.maximum(words, 1)
    per_word = lambda x: np.bincount(doc, weights=x, minlength=n) / w if n > 1 else np.array([x.sum() / w[0]])
    length = ends - starts
    mean = per_word(length)
    spread = np.sqrt(np.maximum(per_word(length * length) - mean * mean, 0))
    is_upper = lambda at: (data[at] >= 65) & (data[at] <= 90)
    caps = per_word(is_upper(starts) & (length > 1) & is_upper(np.minimum(starts + 1, max(len(data) - 1, 0)))) if len(doc) else np.zeros(n)
    marked = per_word(_IS_MARK[data[ends - 1]]) if len(doc) else np.zeros(n)
    del length
    hashes = block.hashes(starts, ends, LOWER)
    del starts, ends
    distinct, top = _repetition(doc, hashes, n)
    same = np.zeros(len(doc), dtype=bool)
    if len(doc) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    again = per_word(same)
    runs, first = shingle_hashes(hashes, doc, n, 3)
    del hashes, doc
    distinct_runs, top_run = _repetition(np.repeat(np.arange(n), np.diff(first)) if n > 1 else first, runs, n)
    del runs
    # lines: the bytes between newlines and the text's bounds
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][size > 0], breaks + 1]) if len(data) else np.zeros(0, np.int64)
    line_start = line_start[line_start < len(data)]
    line_doc = block.doc_of(line_start)
    line_end = np.minimum(np.r_[line_start[1:], len(data)], offsets[line_doc + 1]) if len(line_start) else line_start
    lines = np.bincount(line_doc, minlength=n)
    distinct_lines, top_line = _repetition(line_doc, block.hashes(line_start, line_end), n)
    columns = [
        *(share @ _MEMBER).T,
        *(np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, words / np.maximum(lines, 1), entropy, distinct, top),
        *(again, caps, marked),
        *(distinct_runs, top_run, distinct_lines, top_line),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Trees:
    """Trees as arrays of nodes; a leaf is its own child and has a value. Node 0 of tree t is at roots[t]."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 10) -> Trees:
    """Trees that predict y (0 or 1) from x."""
    if not len(y):
        return Trees(0.0, 0, *(np.zeros(0, t) for t in (int, int, float, int, int, float)))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("limit", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = y - p, p * (1 - p)
        roots.append(add(0.0))
        where = np.full(len(y), roots[-1])
        level = [roots[-1]]
        for deep in range(depth + 1):
            place = np.full(len(nodes["value"]), -1)
            place[level] = np.arange(len(level))
            slot = place[where]
            live = slot >= 0
            g = np.bincount(slot[live], grad[live], len(level))
            h = np.bincount(slot[live], curve[live], len(level))
            for i, node in enumerate(level):
                nodes["value"][node] = rate * g[i] / (h[i] + ridge)
            if deep == depth:
                break
            best: list[tuple[float, int, int]] = [(1e-6, -1, -1)] * len(level)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                width = len(e) + 1
                key = slot[live] * width + binned[live, f]
                sums = [np.bincount(key, v, len(level) * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for v in (grad[live], curve[live], np.ones(live.sum()))]
                gl, hl, nl = sums
                n = np.bincount(slot[live], minlength=len(level))[:, None]
                gain = gl**2 / (hl + ridge) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(nl < least) | (n - nl < least)] = -1
                at = gain.argmax(axis=1)
                for i, b in enumerate(at):
                    if gain[i, b] > best[i][0]:
                        best[i] = (float(gain[i, b]), f, int(b))
            new = []
            for i, node in enumerate(level):
                _, f, b = best[i]
                if f < 0:
                    continue
                left, right = add(0.0), add(0.0)
                nodes["feature"][node], nodes["limit"][node] = f, float(edges[f][b])
                nodes["left"][node], nodes["right"][node] = left, right
                here = where == node
                where[here] = np.where(binned[here, f] <= b, left, right)
                new += [left, right]
            level = new
            if not level:
                break
        total += np.asarray(nodes["value"])[where]
    return Trees(base, depth, np.array(roots), np.array(nodes["feature"]), np.array(nodes["limit"]), np.array(nodes["left"]), np.array(nodes["right"]), np.array(nodes["value"]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Trees:
    """Trees from at most max_sample labelled documents outside the held-out fold."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("double").alias("_y"))
    chosen = votes.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_mark")).join(F.broadcast(chosen), "doc_id")
    rows = map_texts(texts, lambda block: {"x": list(statistics(block))}, [("x", "array<double>")], ["doc_id", "_y", "_mark"])
    # an id may have several texts: the rows that are learned from are bounded, in an order of their own
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_mark").limit(max_sample).toPandas().sort_values(["doc_id", "_mark"], kind="stable")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["_y"].to_numpy())


def score(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """The kept columns and the score of every document."""
    return map_texts(docs, lambda block: {"score": model.score(statistics(block))}, [("score", "double")], keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, with trees learned from the labels."""
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
