"""Chunks and postings are made where a page or chunk is read: no text and no token is exchanged."""

import collections
import random
import re

from graticule.operators import chunking, index, scoring
from graticule.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_without_an_exchange(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("source doc_id", "doc_id page_id", "source doc_title", "lang page_title", "text markdown")
    assert "Exchange" not in plan(chunking.chunk_pages(pages))


def test_postings_without_an_exchange(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id chunk_id", "text")
    assert "Exchange" not in plan(index.postings(docs))
    assert plan(index.document_frequency(index.postings(docs))).count("Exchange hashpartitioning") == 1


def test_numbers_of_chunks(spark):
    page = "# T\n\n## A\n\none ![](/assets/x.png)\n\n!!!\n\n### B\n\ntwo\n\n## C\n\nthree\n\n### D\n\nfour"
    pages = spark.createDataFrame([("d", "p", "Doc", "Page", page), ("d", "q", "Doc", "Page", page), ("d", "e", "Doc", "Page", None)], "doc_id string, page_id string, doc_title string, page_title string, markdown string")
    got = chunking.chunk_pages(pages).collect()
    by_kind = collections.defaultdict(list)
    for r in got:
        by_kind[r["page_id"], r["granularity"]].append(r["seq"])
        assert r["chunk_id"] == f"d:{r['page_id']}:{r['granularity']}{r['seq']:03d}"
    assert {p for p, _ in by_kind} == {"p", "q"}
    assert all(len(set(v)) == len(v) for v in by_kind.values())


def test_term_counts_against_counting(spark):
    rng = random.Random(2)
    texts = ["", None, "A a ß ſet ıx 日本 x1-x1", "?!"] + [" ".join(rng.choice(["ab", "Ab", "c9", "é", "d-e", "İ"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame([(f"k{i}" if i else None, t) for i, t in enumerate(texts)], "chunk_id string, text string")
    want = set()
    for i, t in enumerate(texts):
        found = re.findall("[a-z0-9ıſ]+", spark_lower(t or ""))
        want |= {(f"k{i}" if i else None, term, n, len(found)) for term, n in collections.Counter(found).items()}
    got = [tuple(r) for r in scoring.term_counts(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def spark_lower(text):
    return "".join(c.lower() for c in text)
