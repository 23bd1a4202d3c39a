"""Choosing among ranked candidates: capped top-k and maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.text import tokens

#: Tokens of a chunk, from its start, that the word-overlap similarity looks at (part of the measure's definition).
OVERLAP_TOKENS = 256


def capped_top_k(ranked: DataFrame, k: int, max_per_page: int = 3, max_per_doc: int = 12) -> DataFrame:
    """The k best rows of each query with at most so many of a page and of a doc (0 or less: no cap).

    Greedy selection with two counters equals two rank filters one after the other: first within the page, then within
    the doc among what is left.
    """
    best = [F.round("score", 9).desc(), F.col("chunk_id")]
    kept = ranked
    for cap, by in ((max_per_page, ["qid", "doc_id", "page_id"]), (max_per_doc, ["qid", "doc_id"])):
        if cap > 0:
            kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_n") <= cap).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).where(F.col("rank") <= k)


def relevance(score: Column, by: list[str] | None = None) -> Column:
    """Score scaled to 0..1 within a query; 1 where all scores are equal."""
    over = Window.partitionBy(*(by or ["qid"]))
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def overlap_words(text: Column) -> Column:
    """Distinct leading tokens for the word-overlap similarity."""
    return F.array_distinct(F.slice(tokens(text), 1, OVERLAP_TOKENS))


def jaccard(one: Column, two: Column) -> Column:
    """Shared words over all words of two lists; 0 if either is empty."""
    union = F.size(F.array_union(one, two))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(one, two)) / union)


def clamped_dot(one: Column, two: Column) -> Column:
    """Inner product in double precision, within 0..1."""
    wide = F.zip_with(one, two, lambda a, b: a.cast("double") * b.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)))


def _similarity(a: tuple, b: tuple) -> float:
    """Of two candidates (vector or None, word set): vectors where both have one, else words."""
    if a[0] is not None and b[0] is not None:
        total = 0.0
        for x, y in zip(a[0], b[0], strict=True):
            total += x * y
        return max(0.0, min(1.0, total))
    if not a[1] or not b[1]:
        return 0.0
    return len(a[1] & b[1]) / len(a[1] | b[1])


def mmr_choose(scores: list[float], items: list[tuple], pages: list, docs: list, k: int, weight: float, max_per_page: int, max_per_doc: int) -> list[tuple[int, float]]:
    """Positions in selection order, with the value each was chosen at. Candidates come best first."""
    weight = min(1.0, max(0.0, weight))
    n = len(scores)
    low, high = (min(scores), max(scores)) if n else (0.0, 0.0)
    rel = [(s - low) / (high - low) if high > low else 1.0 for s in scores]
    nearest = [0.0] * n  # greatest similarity to what is chosen so far, kept up to date
    free = list(range(n))
    per_page: dict = {}
    per_doc: dict = {}
    out: list[tuple[int, float]] = []
    while free and len(out) < k:
        best, value = -1, -np.inf
        for i in free:
            if max_per_page > 0 and per_page.get(pages[i], 0) >= max_per_page or max_per_doc > 0 and per_doc.get(docs[i], 0) >= max_per_doc:
                continue
            now = rel[i] if not out else weight * rel[i] - (1 - weight) * nearest[i]
            if round(now, 9) > value:
                best, value = i, round(now, 9)
        if best < 0:
            break
        out.append((best, value))
        free.remove(best)
        per_page[pages[best]] = per_page.get(pages[best], 0) + 1
        per_doc[docs[best]] = per_doc.get(docs[best], 0) + 1
        for i in free:
            nearest[i] = max(nearest[i], _similarity(items[best], items[i]))
    return out


def mmr(ranked: DataFrame, k: int = 8, weight: float = 0.8, candidates: int = 80, max_per_page: int = 3, max_per_doc: int = 12, use_vectors: bool = True) -> DataFrame:
    """Maximal marginal relevance among the best `candidates` rows of each query.

    ranked: (qid, chunk_id, doc_id, page_id, score, text, vector). A query's candidates are bounded by `candidates`, so
    a group is small whatever the corpus. The returned score is the relevance score; `place` is the selection order.
    """
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    best = ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(candidates, k))
    vector = F.col("vector").cast("array<double>") if use_vectors else F.lit(None).cast("array<double>")
    best = best.select("qid", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("page_id").cast("string").alias("page_id"), "score", overlap_words(F.col("text")).alias("words"), vector.alias("vector"), "_n")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n", ignore_index=True)
        items = [(None if v is None else np.asarray(v).tolist(), set(w)) for v, w in zip(frame["vector"], frame["words"], strict=True)]
        pages = list(zip(frame["doc_id"], frame["page_id"], strict=True))
        picked = mmr_choose(frame["score"].tolist(), items, pages, frame["doc_id"].tolist(), k, weight, max_per_page, max_per_doc)
        at = [i for i, _ in picked]
        return pd.DataFrame({"qid": frame["qid"].iloc[at].to_numpy(), "chunk_id": frame["chunk_id"].iloc[at].to_numpy(), "score": frame["score"].iloc[at].to_numpy(), "value": [v for _, v in picked], "place": range(1, len(at) + 1)})

    schema = T.StructType([best.schema["qid"], best.schema["chunk_id"]]).add("score", T.DoubleType()).add("value", T.DoubleType()).add("place", T.IntegerType())
    return best.groupBy("qid").applyInPandas(choose, schema)
