"""The search API: settings, modes, routing, exclusions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.engine import SearchConfig, explain, passes, search
from graticule.operators import context, retrieval, scoring
from graticule.operators.index import CorpusIndex

DDL = "chunk_id long, doc_id string, page_id string, granularity string, seq long, heading_path array<string>, text string, images array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "a", "a1", "p", 0, ["A", "Red"], "red cat", []),
        (2, "a", "a1", "p", 1, ["A"], "red dog red", []),
        (3, "b", "b1", "p", 0, ["B"], "red cat", []),
        (4, "b", "b1", "t", 1, ["B"], "blue", []),
        (5, "c", "c1", "p", 0, [], "?!", []),
    ]
    return spark.createDataFrame(rows, DDL)


def batch(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def hits(found):
    return [(r["qid"], r["chunk_id"]) for r in found.orderBy("qid", "rank").collect()]


def test_explicit_zeros_and_unknown_keys():
    got = SearchConfig.resolve({"rrf_k": 0, "mmr_lambda": 0, "embedding_weight": None, "heading_boost": 0.0, "max_per_page": 0, "other": 1})
    assert (got.rrf_k, got.mmr_lambda, got.embedding_weight, got.max_per_page) == (60, 0.8, 0.6, 0)
    assert SearchConfig(k=1).use_mmr() is False and SearchConfig(k=8).candidates() == 80
    assert SearchConfig(mmr_enabled=False, k=8).candidates() == 40


def test_modes_need_their_inputs(spark, chunks):
    with pytest.raises(ValueError):
        search(batch(spark, "red"), chunks, SearchConfig(mode="other"))
    with pytest.raises(ValueError):
        search(batch(spark, "red"), chunks, SearchConfig(mode="hybrid"))


def test_boosts_caps_and_expansion(spark, chunks):
    plain = SearchConfig(mmr_enabled=False, heading_boost=1.0, max_per_page=1)
    found = search(batch(spark, "red", "", "blue"), chunks, plain)
    assert hits(found) == [(0, 1), (0, 3), (2, 4)]
    first = found.where("qid = 0 and rank = 1").first()
    assert first["expanded"] == "red cat\n\nred dog red"


def test_routing_restricts_and_falls_back(spark, chunks):
    units = spark.createDataFrame([(1, "b", "b1", "red things")], "chunk_id long, doc_id string, page_id string, text string")
    found = search(batch(spark, "red", "dog"), chunks, SearchConfig(), summaries=units)
    assert hits(found) == [(0, 3), (1, 2)]


def test_exclusions_follow_selection(spark, chunks):
    gone = spark.createDataFrame([("a",)], "doc_id string")
    assert hits(search(batch(spark, "red"), chunks, SearchConfig(), exclusions=gone)) == [(0, 3)]


def test_embedding_and_hybrid_modes(spark, chunks):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0])], "chunk_id long, vector array<float>")
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, vector array<float>")
    config = SearchConfig(mode="embedding", mmr_enabled=False)
    assert hits(search(batch(spark, "red"), chunks, config, vectors, asked)) == [(0, 4), (0, 1)]
    both = hits(search(batch(spark, "red"), chunks, SearchConfig(mode="hybrid"), vectors, asked))
    assert {c for _, c in both} == {1, 2, 3, 4}


def test_routing_ranks_all_vectors_of_its_pages(spark):
    rows = [(i, "z", "z1", "p", i, [], "other", []) for i in range(1000)] + [(2000 + i, "r", "r1", "p", i, [], "other", []) for i in range(3)]
    near = [(i, [1.0, i / 1000]) for i in range(1000)] + [(2000 + i, [0.5, -i / 10]) for i in range(3)]
    units = spark.createDataFrame([(1, "r", "r1", "red things")], "chunk_id long, doc_id string, page_id string, text string")
    asked = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0])], "qid long, vector array<float>")
    frames = spark.createDataFrame(rows, DDL), spark.createDataFrame(near, "chunk_id long, vector array<float>")
    settings = dict(k=3, mmr_enabled=False, bm25_candidates=3, embedding_candidates=3, max_per_page=0, max_per_doc=0)
    for mode in ("embedding", "hybrid"):
        found = hits(search(batch(spark, "red", "blue"), frames[0], SearchConfig(mode=mode, **settings), frames[1], asked, units))
        assert found == [(0, 2000), (0, 2001), (0, 2002), (1, 999), (1, 998), (1, 997)]


def test_expansion_stays_within_its_doc_and_merges_images(spark):
    rows = [(1, "a", "intro", "p", 0, [], "one", ["x.png"]), (2, "a", "intro", "p", 1, [], "red", ["y.png"]), (3, "b", "intro", "p", 0, [], "other", ["z.png"]), (4, "b", "intro", "p", 1, [], "blue", []), (5, "a", "intro", "p", 2, [], "two", ["x.png"])]
    frame = spark.createDataFrame(rows, DDL)
    for n in (1, 2):
        config = SearchConfig(mmr_enabled=False, expand_neighbors=n, expand_include_images=True)
        found = search(batch(spark, "red", "blue"), frame, config).orderBy("qid").collect()
        assert [(r["expanded"], r["images"]) for r in found] == [("one\n\nred\n\ntwo", ["x.png", "y.png"]), ("other\n\nblue", ["z.png"])]
        own = search(batch(spark, "red"), frame, SearchConfig(mmr_enabled=False, expand_neighbors=n)).first()
        assert own["images"] == ["y.png"]


def test_index_and_texts_give_the_same_results(spark, chunks, tmp_path):
    CorpusIndex.build(chunks).save(str(tmp_path))
    index = CorpusIndex.load(spark, str(tmp_path))
    units = spark.createDataFrame([(1, "b", "b1", "red things")], "chunk_id long, doc_id string, page_id string, text string")
    for extra in ({}, {"summaries": units}, {"allowed": chunks.where("chunk_id > 1")}):
        asked = batch(spark, "red", "dog blue", "", "red red cat")
        one, two = (search(asked, chunks, SearchConfig(mmr_enabled=False), index=i, **extra).select("qid", "rank", "chunk_id", F.round("score", 9).alias("s")).orderBy("qid", "rank").collect() for i in (None, index))
        assert one == two and one
    plan = retrieval.bm25(batch(spark, "red"), index)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan


def test_large_batches_take_the_way_of_joins(spark, chunks, monkeypatch):
    asked = batch(spark, "red", "dog blue", "cat")
    routes = spark.createDataFrame([(0, "b", "b1")], "qid long, doc_id string, page_id string")
    allowed = chunks.where("chunk_id <> 3")
    shown = lambda df: df.select("qid", "rank", "chunk_id", F.round("score", 9).alias("s")).orderBy("qid", "rank").collect()
    want = [shown(retrieval.bm25(asked, chunks, 3, **x)) for x in ({}, {"routes": routes}, {"allowed": allowed})]
    monkeypatch.setattr(retrieval, "BATCH_WORDS", 1)
    assert [shown(retrieval.bm25(asked, chunks, 3, **x)) for x in ({}, {"routes": routes}, {"allowed": allowed})] == want


def test_no_text_is_exchanged_before_the_term_filter(spark, chunks):
    for plan in (retrieval.bm25(batch(spark, "red"), chunks, 3), retrieval.bm25(batch(spark, "red"), chunks, 3, routes=spark.createDataFrame([(0, "b", "b1")], "qid long, doc_id string, page_id string"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        below = text[text.index("MapInArrow") :]
        assert "Exchange" not in below.replace("BroadcastExchange", "")


def test_blocks_of_queries_and_texts_change_nothing(spark, chunks, monkeypatch):
    asked = batch(spark, "red", "dog blue", "cat", "red cat")
    want = hits(retrieval.bm25(asked, chunks, 2))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 5)
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 2)
    assert hits(retrieval.bm25(asked, chunks, 2)) == want


def test_token_hashes_tell_tokens_apart():
    texts = ["red cat", "", "ısı ſet", "a-b1 é a", "red"]
    flat = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, doc = scoring.token_hashes(np.frombuffer(flat, np.uint8), offsets)
    want = [(t, i) for i, x in enumerate(texts) for t in re.findall("[a-z0-9ıſ]+", x)]
    assert doc.tolist() == [i for _, i in want]
    assert [[a == b for b in hashes.tolist()] for a in hashes.tolist()] == [[a == b for b, _ in want] for a, _ in want]


def test_explain_shows_every_stage(spark, chunks):
    units = spark.createDataFrame([(1, "a", "a1", "red things")], "chunk_id long, doc_id string, page_id string, text string")
    got = explain(batch(spark, "red dog"), chunks, SearchConfig(heading_boost=1.0), summaries=units)
    assert set(got) == {"settings", "routes", "candidates", "mmr", "selected"}
    rows = got["candidates"].orderBy("rank").collect()
    assert [r["score"] for r in rows] == pytest.approx([r["base_score"] * r["heading_factor"] * r["granularity_factor"] * r["priority_factor"] for r in rows]) and len(rows) == 2
    assert got["selected"].where("text_chars > 0").count() == 2 and got["mmr"].count() == 2


def test_further_passes_follow_requests(spark, chunks):
    run = lambda asked, n: search(asked, chunks, SearchConfig(mmr_enabled=False, k=n))
    asked = batch(spark, "blue", "dog")
    answers = spark.createDataFrame([(0, 'REQUEST_MORE_CONTEXT\n{"query": "red", "k": 1, "doc_ids": ["b"]}'), (1, "an answer")], "qid long, answer string")
    requests = answers.select("qid", context.context_request(F.col("answer")).alias("request"))
    got = passes(run, asked, [requests], 8).orderBy("qid", "place").collect()
    assert [(r["qid"], r["chunk_id"]) for r in got] == [(0, 4), (0, 3), (1, 2)]
    narrowed = context.requested(run(batch(spark, "red"), 8), 5, page_ids=["b1"])
    assert hits(narrowed) == [(0, 3)]
