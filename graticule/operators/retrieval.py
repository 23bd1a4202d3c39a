"""Ranking operators over batches of queries: BM25, vectors, rank fusion, boosts, routing.

Every operator takes all queries at once and returns (qid, chunk_id, score, rank). Scores are compared after rounding to
nine decimals, then by chunk id, so that sums in any order rank alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graticule.functions.text import STOPWORDS, tokens
from graticule.operators import scoring
from graticule.operators.batches import bound_batches
from graticule.operators.index import BROADCAST_ROWS, CorpusIndex, corpus_stats, document_frequency, idf, postings
from graticule.operators.lineage import cut

#: Words of a batch, and (query, page) pairs of its routes, up to which the batch is sent to every task; beyond that, joins.
BATCH_WORDS = 500_000
#: Vectors in a block of candidates and in a block of queries, and components of all queries that are sent to the tasks at once.
CANDIDATES, QUERIES = 4096, 256
WAVE = 4_000_000


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows of each group by rounded score, ties by key, with their 1-based rank.

    The rank filter becomes a partial top-k before the exchange, so a task passes on k rows of a group at most.
    """
    order = Window.partitionBy(*(by or ["qid"])).orderBy(F.round(score, 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(qid, term), each term once for a query."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def page_mark() -> Column:
    """A number for a page within its doc."""
    return F.xxhash64(F.length(F.col("doc_id").cast("string")), F.col("doc_id").cast("string"), F.col("page_id").cast("string"))


def bm25_scores(queries: DataFrame, posted: DataFrame, df: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, chunk_id, score) of every chunk that shares a term with a query, from postings (chunk_id, term, tf, length).

    The way of stored indexes, and of batches too large to be sent to every task.
    """
    wanted = query_terms(queries)
    weights = df.join(wanted.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(stats.select("n_chunks", F.greatest("avgdl", F.lit(1e-9)).alias("avgdl"))))  # stats: one row
    by_term = wanted.join(weights.select("term", idf(F.col("n_chunks"), F.col("df")).alias("idf"), "avgdl"), "term")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # measured on the queries alone
    matched = posted.join(F.broadcast(by_term) if few else by_term, "term")
    saturation = F.col("tf") + k1 * (1 - b + b * F.greatest("length", F.lit(1)) / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / saturation
    return matched.groupBy("chunk_id", "qid").agg(F.sum(part).alias("score")).select("qid", "chunk_id", "score")


def _batch(queries: DataFrame) -> scoring.Batch | None:
    """The batch as arrays, if it is small enough to be sent to every task."""
    asked = queries.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    words = asked.agg(F.sum(F.size(tokens(F.col("text"))) + 1)).first()[0] or 0
    if words > BATCH_WORDS:
        return None
    rows = asked.orderBy("qid").collect()  # bounded by the words just counted
    return scoring.Batch.of([r["qid"] for r in rows], [r["text"] for r in rows])


def restricted(scored: DataFrame, chunks: DataFrame, routes: DataFrame) -> DataFrame:
    """Scores within each query's routed pages, all of them for queries that have none."""
    placed = scored.join(chunks.select("chunk_id", "doc_id", "page_id"), "chunk_id")
    inside = placed.join(routes, ["qid", "doc_id", "page_id"], "left_semi")
    free = placed.join(routes.select("qid").distinct(), "qid", "left_anti")
    return inside.unionByName(free).select("qid", "chunk_id", "score")


def bm25(queries: DataFrame, chunks: DataFrame | CorpusIndex, k: int = 8, allowed: DataFrame | None = None, routes: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best chunks of each query by BM25.

    chunks: (chunk_id, text), with routes also doc_id and page_id; or a stored index, of which the query terms' postings are
    read. Statistics are those of all chunks, also where `allowed` (chunk_id) restricts what may be found, or `routes`
    (qid, doc_id, page_id) what a query that has routes may find.
    """
    indexed = isinstance(chunks, CorpusIndex)
    batch = None if indexed else _batch(queries)
    if batch is not None and routes is not None:
        few = routes.limit(BATCH_WORDS + 1).count() <= BATCH_WORDS
        batch = batch if few else None
    if batch is None:
        if indexed:
            posted, df, stats, rows = chunks.postings_of(query_terms(queries).select("term").distinct()), chunks.terms, chunks.stats, chunks.chunks
        else:
            posted, rows, stats = postings(chunks, terms=query_terms(queries).select("term").distinct()), chunks, corpus_stats(chunks)
            df = document_frequency(posted)
        if allowed is not None:
            posted = posted.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        scored = bm25_scores(queries, posted, df, stats, k1, b)
        return top_k(restricted(scored, rows, routes) if routes is not None else scored, k)
    n, total, df = scoring.frequencies(chunks, batch)
    weights = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
    rows = chunks if allowed is None else chunks.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    pages = None
    if routes is not None:
        place = {q: i for i, q in enumerate(batch.qids)}
        pages = {}
        for r in routes.select("qid", page_mark().alias("page")).collect():  # bounded by the count above
            if r["qid"] in place:
                pages.setdefault(place[r["qid"]], []).append(r["page"])
        rows = rows.withColumn("_page", page_mark())
    scored = scoring.score_chunks(rows, batch, weights, scoring.mean_length(n, total), k, k1, b, pages)
    return top_k(scored.withColumn("qid", F.col("qid").cast(queries.schema["qid"].dataType)), k)


def vector_rank(queries: DataFrame, vectors: DataFrame, k: int, leave_out_self: bool = False, routes: DataFrame | None = None, wave: int = WAVE) -> DataFrame:
    """The k nearest vectors of each query by inner product in double precision.

    queries: (qid, vector); vectors: (chunk_id, vector), all of one dimension; ids are numbers or strings. The candidates
    stay where they are read: the queries are sent to them in waves of a bounded size, and a task passes on the k best it has
    seen of each query. With routes (qid, doc_id, page_id), vectors also has doc_id and page_id, and a query that has routes
    ranks all vectors of its pages and no others. Null vectors take no part.
    """
    bound_batches(vectors.sparkSession)
    routed = routes is not None
    no_page = F.lit(None).cast("string")
    page = F.concat(F.length(F.col("doc_id").cast("string")), F.lit(":"), "doc_id", "page_id") if routed else no_page
    asked = queries.where("vector is not null").select("qid", F.col("vector").cast("array<double>").alias("vector"))
    pages = routes.groupBy("qid").agg(F.collect_set(page).alias("pages")) if routed else None
    asked = asked.join(pages, "qid", "left") if routed else asked.withColumn("pages", F.array(no_page).cast("array<string>"))
    held = vectors.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), page.alias("page"))
    least, most, total = asked.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.sum(F.size("vector") + 8 * F.greatest(F.size("pages"), F.lit(0)))).first()
    sizes = held.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    bounds = [x for x in (least, most, *sizes) if x is not None]
    if bounds and min(bounds) != max(bounds):
        raise ValueError(f"vectors have between {min(bounds)} and {max(bounds)} dimensions")
    waves = max(1, -(-(total or 0) // wave))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    types = [to_arrow_type(f.dataType) for f in schema]

    def ranked(rows: list) -> DataFrame:
        qid = np.array([r["qid"] for r in rows], dtype=None if types[0] != pa.string() else object)
        q = np.array([r["vector"] for r in rows], dtype=np.float64)
        allowed = [None if r["pages"] is None or not routed else set(r["pages"]) for r in rows]

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, types[1].to_pandas_dtype()), np.zeros(0))] * (-(-len(qid) // QUERIES))
            for batch in batches:
                for at in range(0, batch.num_rows, CANDIDATES):
                    part = batch.slice(at, CANDIDATES)
                    cid = part.column(0).to_numpy(zero_copy_only=False)
                    c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)
                    code, names = pd.factorize(part.column(2).to_numpy(zero_copy_only=False)) if routed else (None, ())
                    place = {name: i for i, name in enumerate(names)}
                    for n, first in enumerate(range(0, len(qid), QUERIES)):
                        mine = q[first : first + QUERIES]
                        score = np.zeros((len(mine), len(cid)))
                        for d in range(mine.shape[1]):  # in component order: equal vectors get equal scores
                            score += mine[:, d, None] * c[None, :, d]
                        if leave_out_self:
                            score[qid[first : first + QUERIES, None] == cid[None, :]] = -np.inf
                        for row, may in zip(score, allowed[first : first + QUERIES], strict=True):
                            if may is not None:
                                row[~np.isin(code, [place[p] for p in may if p in place])] = -np.inf
                        column, row = scoring.best(score.T, cid, k)
                        best[n] = _merged(best[n], (row + first, cid[column], score[row, column]), k)
            for row, cid, score in best:
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row], types[0]), pa.array(cid, types[1]), pa.array(score)], schema.names)

        return held.mapInArrow(product, schema)

    if waves == 1:
        return top_k(ranked(asked.collect()), k)  # bounded by the size of a wave
    place = F.pmod(F.xxhash64("qid"), F.lit(waves))
    parts = [cut(top_k(ranked(asked.where(place == w).collect()), k)) for w in range(waves)]
    return reduce(DataFrame.unionByName, parts)


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (query, id, score) of each query of both."""
    if not len(one[0]):
        return two
    query, ids, score = (np.concatenate(x) for x in zip(one, two, strict=True))
    place = np.unique(ids.astype(str), return_inverse=True)[1] if ids.dtype == object else ids
    order = np.lexsort((place, -np.round(score, 9), query))
    query, ids, score = query[order], ids[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], score[kept]


def rrf(lexical: DataFrame, semantic: DataFrame, k: float = 60, lexical_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    """(qid, chunk_id, score) by reciprocal-rank fusion; a chunk that one side lacks gets nothing from it."""
    one = lexical.select("qid", "chunk_id", F.col("rank").alias("_b"))
    two = semantic.select("qid", "chunk_id", F.col("rank").alias("_e"))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    return one.join(two, ["qid", "chunk_id"], "full_outer").select("qid", "chunk_id", (part(lexical_weight, "_b") + part(semantic_weight, "_e")).alias("score"))


def heading_factor(query: Column, heading: Column, boost: float, extra_stopwords: tuple[str, ...] = ()) -> Column:
    """1 + boost times the share of the query's words, stop-words aside, that a heading path has."""
    stop = F.array(*[F.lit(w) for w in [*STOPWORDS, *extra_stopwords]])
    words = F.array_except(tokens(query), stop)
    shared = F.size(F.array_intersect(words, tokens(heading)))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(1.0 + boost * shared / F.size(words))


def granularity_factor(granularity: Column, part: float = 1.05, section: float = 1.0, topic: float = 0.9) -> Column:
    """Weight by the kind of a chunk: p(art), s(ection), t(opic), else 1."""
    return F.when(granularity == "p", part).when(granularity == "s", section).when(granularity == "t", topic).otherwise(F.lit(1.0))


def priority_factor(doc: Column, priority: list[str], boost: float) -> Column:
    """From 1 + boost for the first listed doc down to 1 for the last; 1 for one that isn't listed, and if only one is."""
    if len(priority) < 2:
        return F.lit(1.0)
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), doc) - 1
    return F.when(place >= 0, 1.0 + boost * (1.0 - place / float(len(priority) - 1))).otherwise(F.lit(1.0))


def adjusted(ranked: DataFrame, factors: list[Column]) -> DataFrame:
    """Ranked rows with their score times the factors, ranked anew; what was cut off before stays off."""
    score = F.col("score")
    for factor in factors:
        score = score * factor
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return ranked.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def routed_pages(queries: DataFrame, summaries: DataFrame, k: int = 12, max_pages: int = 20, unit_k: int | None = None) -> DataFrame:
    """(qid, doc_id, page_id): the pages that the summary corpus names for a query, in rank order, `max_pages` at most.

    summaries: (chunk_id, doc_id, page_id, text). Unit ranks fuse with themselves only, so their order is BM25's.
    """
    hits = bm25(queries, summaries.select("chunk_id", "text"), k if k > 0 else max(unit_k or 0, 10))
    paged = hits.join(summaries.select("chunk_id", "doc_id", "page_id"), "chunk_id").groupBy("qid", "doc_id", "page_id").agg(F.min("rank").alias("first"))
    if max_pages <= 0:
        return paged.select("qid", "doc_id", "page_id")
    order = Window.partitionBy("qid").orderBy("first", "doc_id", "page_id")
    return paged.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_pages).select("qid", "doc_id", "page_id")


def routed_bm25(queries: DataFrame, chunks: DataFrame | CorpusIndex, routes: DataFrame, k: int) -> DataFrame:
    """BM25 within each query's routed pages, and without restriction for queries that have none."""
    return bm25(queries, chunks, k, routes=routes)


def multi_pass_merge(passes: list[DataFrame]) -> DataFrame:
    """Results of several passes one after the other, a chunk where it appears first; (qid, chunk_id, score, place)."""
    tagged = [p.select("qid", "chunk_id", "score", F.lit(i).alias("_pass"), "rank") for i, p in enumerate(passes)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    first = Window.partitionBy("qid", "chunk_id").orderBy("_pass", "rank")
    kept = every.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("qid", "chunk_id", "score", F.row_number().over(Window.partitionBy("qid").orderBy("_pass", "rank")).alias("place"))
