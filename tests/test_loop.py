"""The retrieval loop against a plain loop over each query, with a scripted responder."""

import json
import random

from pyspark.sql import functions as F

from graticule.engine import converse
from graticule.operators import retrieval
from graticule.operators.context import NEED_MORE

WORDS = "red green blue dog cat fox sun moon".split()


def corpus(spark, n=60, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"d{i % 4}", f"p{i % 7}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, page_id string, text string").cache()


def script(qid, number):
    """What a query's answer asks for in a pass: None, or a request."""
    rng = random.Random(qid * 31 + number)
    if number > qid % 5:
        return None
    request = {"query": " ".join(rng.sample(WORDS, 2)), "k": rng.choice([0, 1, 4, 99])}
    if rng.random() < 0.5:
        request["doc_ids"] = rng.sample(["d0", "d1", "d2"], 2)
    if rng.random() < 0.3:
        request["page_ids"] = ["p1", "p2", "p3"]
    return request


def plain(spark, rows, run, qid, text, k, limit):
    found, number, asked = [], 0, {"query": text, "k": k}
    while True:
        number += 1
        hits = run(spark.createDataFrame([(qid, asked["query"])], "qid long, text string"), k if number == 1 else 125).orderBy("rank").collect()
        hits = [h for h in hits if h["doc_id"] in asked.get("doc_ids", [h["doc_id"]]) and h["page_id"] in asked.get("page_ids", [h["page_id"]])]
        found += [(h["chunk_id"], number) for h in hits[: min(25, asked["k"] or k)] if h["chunk_id"] not in dict(found)]
        asked = script(qid, number)
        if asked is None:
            return found, (number, "answered")
        if 0 < limit <= number:
            return found, (number, "limit")


def test_equal_to_a_loop_over_each_query(spark):
    rows = corpus(spark)
    run = lambda asked, k: retrieval.bm25(asked, rows, k).join(rows.drop("text"), "chunk_id")
    seen = []

    def respond(still, found, number):
        open_ones = {r["qid"]: r["text"] for r in still.collect()}
        seen.append((number, sorted(open_ones)))
        assert found.select("qid", "chunk_id").distinct().count() == found.count()
        said = [(q, f"{NEED_MORE}\n```json\n{json.dumps(script(q, number))}\n```" if script(q, number) else f"answer {number}") for q in open_ones]
        return spark.createDataFrame(said, "qid long, answer string")

    texts = {q: " ".join(random.Random(q).sample(WORDS, 3)) for q in range(10)}
    queries = spark.createDataFrame(list(texts.items()), "qid long, text string")
    for limit in (3, 0):
        seen.clear()
        got = converse(run, respond, queries, 4, limit)
        outcomes = {r["qid"]: (r["passes"], r["state"]) for r in got.outcomes.collect()}
        placed = {}
        for r in got.results.orderBy("qid", "place").collect():
            placed.setdefault(r["qid"], []).append((r["chunk_id"], r["pass"]))
            assert r["place"] == len(placed[r["qid"]])
        for q, text in texts.items():
            assert (placed[q], outcomes[q]) == plain(spark, rows, run, q, text, 4, limit)
        assert [n for n, _ in seen] == list(range(1, 4 if limit else 6))
        assert [len(o) for _, o in seen] == [sum(q % 5 >= n for q in texts) for n in range(len(seen))]


def test_answers_that_are_missing_or_queries_that_are_none(spark):
    rows = corpus(spark, 5)
    run = lambda asked, k: retrieval.bm25(asked, rows, k).join(rows.drop("text"), "chunk_id")
    silent = lambda still, found, number: still.select("qid", F.lit(None).cast("string").alias("answer")).where("qid > 1")
    got = converse(run, silent, spark.createDataFrame([(1, "red"), (2, "nothing here")], "qid long, text string"))
    assert sorted((r["qid"], r["answer"], r["passes"], r["state"]) for r in got.outcomes.collect()) == [(1, None, 1, "answered"), (2, None, 1, "answered")]
    assert converse(run, silent, spark.createDataFrame([], "qid long, text string")).outcomes.count() == 0
