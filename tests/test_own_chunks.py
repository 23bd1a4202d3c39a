"""Searches over the chunks that the library makes itself, whose ids are texts, against a plain search."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.engine import SearchConfig, search
from graticule.operators import chunking, retrieval, selection

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    pages = []
    for g in range(3):
        for p in range(5):
            body = "\n\n".join(f"## {rng.choice(WORDS)} {i}\n\n{say(rng.randrange(5, 60))}\n\n### {rng.choice(WORDS)}\n\n{say(rng.randrange(3, 40))}" for i in range(3))
            pages.append((f"g{g}", f"p{p}", f"Guide {g}", f"Page {p}", f"# Page {p}\n\n{body}"))
    chunks = chunking.chunk_pages(spark.createDataFrame(pages, "doc_id string, page_id string, doc_title string, page_title string, markdown string")).cache()
    rows = sorted(chunks.collect(), key=lambda r: r["chunk_id"])
    vectors = {r["chunk_id"]: np.round(np.array([rng.gauss(0, 1) for _ in range(6)]), 3) for r in rows}
    return chunks, rows, vectors


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_bm25(rows, query):
    lengths = {r["chunk_id"]: len(tokens(r["text"])) for r in rows}
    mean = round(sum(lengths.values()) / len(rows), 6)
    df = collections.Counter(t for r in rows for t in set(tokens(r["text"])))
    out = {}
    for r in rows:
        tf = collections.Counter(tokens(r["text"]))
        for t in set(tokens(query)):
            if tf[t]:
                idf = math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                out[r["chunk_id"]] = out.get(r["chunk_id"], 0) + idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[r["chunk_id"]] / mean))
    return out


def ordered(scores):
    return sorted(scores, key=lambda c: (-round(scores[c], 9), c))


def plain_search(rows, vectors, query, vector, mode, mmr, k=8):
    by_id = {r["chunk_id"]: r for r in rows}
    near = {c: float(np.dot(v, vector)) for c, v in vectors.items()}
    lexical = plain_bm25(rows, query)
    limit = 80 if mmr else 40
    if mode == "bm25":
        scores = {c: lexical[c] for c in ordered(lexical)[:limit]}
    elif mode == "embedding":
        scores = {c: near[c] for c in ordered(near)[:limit]}
    else:
        scores = collections.defaultdict(float)
        for side, weight in ((lexical, 1.0), (near, 0.6)):
            for rank, c in enumerate(ordered(side)[:120], 1):
                scores[c] += weight / (60 + rank)
    scores = {c: s * {"p": 1.05, "s": 1.0, "t": 0.9}[by_id[c]["granularity"]] for c, s in scores.items()}
    best = ordered(scores)
    page = lambda c: (by_id[c]["doc_id"], by_id[c]["page_id"])
    if mmr:
        best = best[:80]
        items = [(vectors[c].tolist() if mode != "bm25" else None, set(tokens(by_id[c]["text"])[:256])) for c in best]
        return [best[i] for i, _ in selection.mmr_choose([scores[c] for c in best], items, [page(c) for c in best], [by_id[c]["doc_id"] for c in best], k, 0.8, 3, 12)]
    taken, pages, docs = [], collections.Counter(), collections.Counter()
    for c in best:
        if pages[page(c)] < 3 and docs[page(c)[0]] < 12:
            pages[page(c)] += 1
            docs[page(c)[0]] += 1
            taken.append(c)
    return taken[:k]


@pytest.mark.parametrize("ids", ["text", "number"])
@pytest.mark.parametrize("mode", ["bm25", "embedding", "hybrid"])
def test_every_mode(spark, corpus, mode, ids):
    chunks, rows, vectors = corpus
    rng = random.Random(len(mode))
    asked = [(f"q{i}" if ids == "text" else i, " ".join(rng.choice(WORDS) for _ in range(3)), np.round([rng.gauss(0, 1) for _ in range(6)], 3)) for i in range(4)]
    kind = "string" if ids == "text" else "long"
    queries = spark.createDataFrame([a[:2] for a in asked], f"qid {kind}, text string")
    held = spark.createDataFrame([(c, v.tolist()) for c, v in vectors.items()], "chunk_id string, vector array<double>")
    points = spark.createDataFrame([(a[0], a[2].tolist()) for a in asked], f"qid {kind}, vector array<double>")
    for mmr in (True, False):
        given = (held, points) if mode != "bm25" else (None, None)
        found = search(queries, chunks, SearchConfig(mode=mode, mmr_enabled=mmr), *given)
        got = collections.defaultdict(dict)
        for r in found.collect():
            got[r["qid"]][r["rank"]] = r["chunk_id"]
        for qid, text, vector in asked:
            assert [c for _, c in sorted(got[qid].items())] == plain_search(rows, vectors, text, vector, mode, mmr)


def test_vectors_in_waves(spark, corpus):
    """Queries in several waves, tasks of several batches: the same as all at once; routes and self-matches left out."""
    _, _, vectors = corpus
    held = spark.createDataFrame([(c, v.tolist()) for c, v in vectors.items()] + [("null", None)], "chunk_id string, vector array<double>").repartition(3)
    points = held.withColumnRenamed("chunk_id", "qid")
    once = sorted(map(tuple, retrieval.vector_rank(points, held, 5, leave_out_self=True).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    waves = sorted(map(tuple, retrieval.vector_rank(points, held, 5, leave_out_self=True, wave=200).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(q, c, float(np.dot(a, vectors[c])), i) for q, a in vectors.items() for i, c in enumerate(sorted((c for c in vectors if c != q), key=lambda c: (-round(float(np.dot(a, vectors[c])), 9), c))[:5], 1)]
    assert [(q, c, i) for q, c, _, i in once] == [(q, c, i) for q, c, _, i in sorted(want)]
    assert waves == once
    assert retrieval.vector_rank(points.limit(0), held, 5).count() == 0
    assert retrieval.vector_rank(points, held.limit(0), 5).count() == 0


def test_candidates_are_not_exchanged(spark, corpus):
    _, _, vectors = corpus
    held = spark.createDataFrame([(c, v.tolist()) for c, v in vectors.items()], "chunk_id string, vector array<double>")
    plan = retrieval.vector_rank(held.limit(5).withColumnRenamed("chunk_id", "qid"), held, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below


def test_bm25_with_text_ids_and_no_query(spark, corpus):
    chunks, _, _ = corpus
    none = spark.createDataFrame([], "qid string, text string")
    got = retrieval.bm25(none, chunks, 3)
    assert dict(got.dtypes)["qid"] == "string" and got.join(none, "qid").count() == 0
    routes = spark.createDataFrame([("q", "g1", "p1")], "qid string, doc_id string, page_id string")
    asked = spark.createDataFrame([("q", "alpha beta gamma"), ("r", "alpha")], "qid string, text string")
    found = retrieval.bm25(asked, chunks, 3, routes=routes).join(chunks, "chunk_id").where("qid = 'q'")
    assert {(r["doc_id"], r["page_id"]) for r in found.collect()} == {("g1", "p1")}
    assert found.where(F.col("score") <= 0).count() == 0
