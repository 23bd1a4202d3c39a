"""Search over a corpus as one lazy plan: mode, routing, boosts, selection, exclusions, expansion and the context pack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators import context, lineage, retrieval, selection
from graticule.operators.index import CorpusIndex


@dataclass(frozen=True)
class SearchConfig:
    """Settings of a search. The defaults are those of the stored default settings."""

    mode: str = "bm25"
    k: int = 8
    max_citations: int = 8
    max_images: int = 6
    doc_priority_boost: float = 0.0
    heading_boost: float = 0.0
    mmr_enabled: bool = True
    mmr_lambda: float = 0.8
    mmr_candidates: int = 80
    mmr_use_embeddings: bool = True
    expand_neighbors: int = 1
    expand_max_chars: int = 4200
    expand_include_images: bool = False
    summary_enabled: bool = True
    summary_k: int = 12
    summary_max_pages: int = 20
    max_per_page: int = 3
    max_per_doc: int = 12
    rrf_k: float = 60
    bm25_weight: float = 1.0
    embedding_weight: float = 0.6
    bm25_candidates: int = 120
    embedding_candidates: int = 120
    doc_priority: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def resolve(stored: dict[str, object]) -> SearchConfig:
        """Defaults with stored values over them. A missing or empty value leaves the default; so does a zero for the
        fusion constant, the weights and lambda, as an explicit 0 there has always meant the default."""
        known = {f.name for f in fields(SearchConfig)}
        zero_is_default = {"rrf_k", "bm25_weight", "embedding_weight", "mmr_lambda"}
        kept = {k: v for k, v in stored.items() if k in known and v is not None and not (k in zero_is_default and not v)}
        return replace(SearchConfig(), **kept)

    def candidates(self) -> int:
        """Rows that ranking passes on to selection."""
        wanted = context.oversample(min(max(self.k, 1), 25))
        return max(self.mmr_candidates, wanted) if self.use_mmr() else wanted

    def use_mmr(self) -> bool:
        """Diversity selection is for more than one result."""
        return self.mmr_enabled and self.k > 1


def heading(path: Column) -> Column:
    return F.array_join(path, " ")


def _stages(queries: DataFrame, chunks: DataFrame, config: SearchConfig, vectors: DataFrame | None, query_vectors: DataFrame | None, summaries: DataFrame | None, exclusions: DataFrame | None, index: CorpusIndex | None, allowed: DataFrame | None) -> dict[str, DataFrame | None]:
    """The plan of a search by stage: routes, candidates with their factors, what selection picked, the results."""
    if config.mode not in ("bm25", "embedding", "hybrid"):
        raise ValueError(f"unknown mode {config.mode}")
    if config.mode != "bm25" and (vectors is None or query_vectors is None):
        raise ValueError(f"mode {config.mode} needs vectors of chunks and queries")
    limit = config.candidates()
    routes = retrieval.routed_pages(queries, summaries, config.summary_k, config.summary_max_pages, config.k) if config.summary_enabled and summaries is not None else None

    def lexical(n: int) -> DataFrame:
        return retrieval.bm25(queries, index if index is not None else chunks, n, allowed, routes)

    def semantic(n: int) -> DataFrame:
        held = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        if routes is None:
            return retrieval.vector_rank(query_vectors, held, n)
        return retrieval.vector_rank(query_vectors, held.join(chunks.select("chunk_id", "doc_id", "page_id"), "chunk_id"), n, routes=routes)

    if config.mode == "bm25":
        ranked = lexical(limit)
    elif config.mode == "embedding":
        ranked = semantic(limit)
    else:
        first, second = max(config.bm25_candidates, config.k), max(config.embedding_candidates, config.k)
        ranked = retrieval.rrf(lexical(first), semantic(second), config.rrf_k, config.bm25_weight, config.embedding_weight)

    rows = ranked.join(chunks, "chunk_id").join(queries.withColumnRenamed("text", "query"), "qid")
    factors = {
        "heading_factor": retrieval.heading_factor(F.col("query"), heading(F.col("heading_path")), config.heading_boost),
        "granularity_factor": retrieval.granularity_factor(F.col("granularity")),
        "priority_factor": retrieval.priority_factor(F.col("doc_id"), list(config.doc_priority), config.doc_priority_boost),
    }
    explained = rows.withColumn("base_score", F.col("score"))
    for name, factor in factors.items():
        explained = explained.withColumn(name, factor)
    candidates = retrieval.adjusted(explained, [F.col(name) for name in factors]).drop("query")
    scored = candidates.drop("base_score", *factors)
    wanted = context.oversample(min(max(config.k, 1), 25)) if exclusions is not None else config.k
    picked = None
    if config.use_mmr():
        held = vectors if vectors is not None else chunks.select("chunk_id", F.lit(None).cast("array<float>").alias("vector"))
        picked = selection.mmr(scored.join(held, "chunk_id", "left"), wanted, config.mmr_lambda, config.mmr_candidates, config.max_per_page, config.max_per_doc, config.mmr_use_embeddings and vectors is not None)
        chosen = picked.select("qid", "chunk_id", "score", F.col("place").alias("rank")).join(chunks, "chunk_id")
    else:
        chosen = selection.capped_top_k(scored.drop("rank"), wanted, config.max_per_page, config.max_per_doc)
    if exclusions is not None:
        chosen = context.excluded(chosen, exclusions, config.k)
    columns = ["qid", "rank", "chunk_id", "doc_id", "page_id", "granularity", "seq", "heading_path", "text", "images", "score"]
    results = context.expand(chosen.select(*columns), chunks, config.expand_neighbors, config.expand_max_chars)
    if config.expand_include_images:
        results = results.withColumn("images", F.col("expanded_images"))
    return {"routes": routes, "candidates": candidates, "mmr": picked, "results": results.drop("expanded_images")}


def search(
    queries: DataFrame,
    chunks: DataFrame,
    config: SearchConfig = SearchConfig(),
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    summaries: DataFrame | None = None,
    exclusions: DataFrame | None = None,
    index: CorpusIndex | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Results of a batch of queries: qid, rank, chunk_id, doc_id, page_id, granularity, seq, heading_path, text, images, score
    and expanded.

    queries: (qid, text). chunks: (chunk_id, doc_id, page_id, granularity, seq, heading_path, text, images). vectors:
    (chunk_id, vector) and query_vectors: (qid, vector) for the modes that need them. summaries: (chunk_id, doc_id,
    page_id, text), for routing. exclusions: (doc_id). index: the stored index of the chunks, whose postings are then read in
    place of the texts. allowed: (chunk_id), what may be found at all. Routing restricts hard: a query with routed pages finds
    nothing outside them. Exclusions follow selection, so fewer than k results may be left.
    """
    return _stages(queries, chunks, config, vectors, query_vectors, summaries, exclusions, index, allowed)["results"]


def explain(
    queries: DataFrame,
    chunks: DataFrame,
    config: SearchConfig = SearchConfig(),
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    summaries: DataFrame | None = None,
    exclusions: DataFrame | None = None,
    index: CorpusIndex | None = None,
    allowed: DataFrame | None = None,
    most: int = 50,
) -> dict[str, DataFrame]:
    """How a search came to its results: `settings` (name, value), `routes`, the best `candidates` with each factor of their
    score, the `mmr` trace in selection order, and what was `selected` with the sizes of what is returned."""
    stages = _stages(queries, chunks, config, vectors, query_vectors, summaries, exclusions, index, allowed)
    spark = queries.sparkSession
    shown = ["qid", "rank", "chunk_id", "doc_id", "page_id", "granularity", "heading_path", "base_score", "heading_factor", "granularity_factor", "priority_factor", "score"]
    out = {"settings": spark.createDataFrame([(f.name, str(getattr(config, f.name))) for f in fields(config)], "name string, value string")}
    out["candidates"] = stages["candidates"].where(F.col("rank") <= most).select(*shown)
    if stages["routes"] is not None:
        out["routes"] = stages["routes"]
    if stages["mmr"] is not None:
        out["mmr"] = stages["mmr"]
    sizes = stages["results"].select("qid", F.col("rank").alias("place"), "chunk_id", F.col("score").alias("returned_score"), F.length("expanded").alias("text_chars"), F.size("images").alias("images_count"))
    out["selected"] = sizes.join(stages["candidates"].select(*[c for c in shown if c != "rank"]), ["qid", "chunk_id"], "left")
    return out


def passes(run: Callable[[DataFrame, int], DataFrame], queries: DataFrame, requests: list[DataFrame], k: int = 8) -> DataFrame:
    """Results of a search and of the further searches that replies asked for, one after the other, a chunk once.

    `run` searches (qid, text) for a number of results. requests: one frame for each further pass, (qid, request) with the
    struct of `context.context_request`. A pass fetches as many as filters may drop, keeps what the request names, and is cut
    to the request's k (1 to 25).
    """
    found = [run(queries, k)]
    for asked in requests:
        asked = asked.where("request is not null").select("qid", F.col("request.query").alias("text"), F.greatest(F.lit(1), F.least(F.lit(25), "request.k")).alias("_k"), F.col("request.doc_ids").alias("_docs"), F.col("request.page_ids").alias("_pages"))
        more = run(asked.select("qid", "text"), context.oversample(25)).join(asked.drop("text"), "qid")
        named = lambda column, names: F.col(names).isNull() | (F.size(names) == 0) | F.array_contains(names, F.col(column).cast("string"))
        kept = more.where(named("doc_id", "_docs") & named("page_id", "_pages"))
        order = Window.partitionBy("qid").orderBy("rank")
        found.append(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_k")).drop("_k", "_docs", "_pages"))
    return retrieval.multi_pass_merge(found)


@dataclass(frozen=True)
class Conversation:
    """What a retrieval loop has come to: `results` (qid, chunk_id, score, pass, place), a chunk once for each query, and
    `outcomes` (qid, answer, passes, state) with the state `answered`, or `limit` where the last answer asked once more."""

    results: DataFrame
    outcomes: DataFrame


def converse(
    run: Callable[[DataFrame, int], DataFrame],
    respond: Callable[[DataFrame, DataFrame, int], DataFrame],
    queries: DataFrame,
    k: int = 8,
    limit: int = 12,
) -> Conversation:
    """Search, answer, and search again for what answers ask for, until none asks or the limit of calls is met.

    `run` searches (qid, text) for a number of results: (qid, chunk_id, doc_id, page_id, score, rank). `respond` gets the queries
    that are still open (qid, text, as first asked), all results so far of every query, and the number of the pass (from 1), and
    returns (qid, answer); an answer that is missing counts as empty. All open queries take a pass together. The set of open
    queries shrinks: those whose answer asks for nothing leave it. A pass adds what a query hasn't found yet, after what it has.
    A limit of n allows n - 1 further passes, and none of 0 or less ends the loop; a query whose answer asks at the limit ends
    without an answer of its own. Each pass is cut to the shared checkpoint folder, so a plan doesn't grow with the passes.
    """
    first = lineage.cut(queries.select("qid", "text"))
    asked = first.withColumns({"_k": F.lit(k), "_docs": F.lit(None).cast("array<string>"), "_pages": F.lit(None).cast("array<string>")})
    found: DataFrame | None = None
    ended: list[DataFrame] = []
    number = 0
    while True:
        number += 1
        hits = run(asked.select("qid", "text"), k if number == 1 else context.oversample(25)).join(asked.drop("text"), "qid")
        named = lambda column, names: F.col(names).isNull() | (F.size(names) == 0) | F.array_contains(names, F.col(column).cast("string"))
        hits = hits.where(named("doc_id", "_docs") & named("page_id", "_pages"))
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("_n") <= F.col("_k"))
        if found is not None:
            hits = hits.join(found.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
            held = found.groupBy("qid").agg(F.max("place").alias("_held"))
            hits = hits.join(held, "qid", "left")
        else:
            hits = hits.withColumn("_held", F.lit(0))
        place = F.coalesce("_held", F.lit(0)) + F.row_number().over(Window.partitionBy("qid").orderBy("_n"))
        new = lineage.cut(hits.select("qid", "chunk_id", "doc_id", "page_id", "score", F.lit(number).alias("pass"), place.cast("int").alias("place")))
        found = new if found is None else found.unionByName(new)

        still = first.join(asked.select("qid"), "qid", "left_semi")
        answers = still.join(respond(still, found, number).select("qid", "answer"), "qid", "left")
        answers = lineage.cut(answers.withColumn("request", context.context_request(F.col("answer"), k)))
        over = 0 < limit <= number
        leaving = answers if over else answers.where("request is null")
        state = F.when(F.col("request").isNull(), F.lit("answered")).otherwise(F.lit("limit"))
        ended.append(leaving.select("qid", F.when(F.col("request").isNull(), F.col("answer")).alias("answer"), F.lit(number).alias("passes"), state.alias("state")))
        asked = answers.where("request is not null").select("qid", F.col("request.query").alias("text"), F.greatest(F.lit(1), F.least(F.lit(25), "request.k")).alias("_k"), F.col("request.doc_ids").alias("_docs"), F.col("request.page_ids").alias("_pages"))
        if over or not asked.limit(1).count():
            break
    return Conversation(found, reduce(DataFrame.unionByName, ended))
