"""Every stage of the pipeline on rows with nulls, ties, repeated rows and clashing columns, on an empty table, and on a long text."""

import random

import pytest

pytest.importorskip("graticule.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

from graticule.llm import quality
from graticule.llm.common import table

STAGES = dict(corpus_pipeline.STAGES)
DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_key", "_copies", "_mark", "_bucket", "_many", "_row", "_i", "_part", "_node", "node", "root", "body", "score", "size", "piece", "length", "lang_pred", "n_shingles", "key", "pick"]
#: The edge rows have ids of their own.
BASE = 10**7
PROSE = "The river runs through the old town and the people walk along it every evening to see the boats come home. "


def edge_rows():
    rng = random.Random(1)
    words = (PROSE * 3).split()
    text = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    same = text()
    rows = [(i, text(), "en", f"s{i % 3}", 300) for i in range(30)]
    rows += [(30, same, "en", "s0", 300), (30, same, "en", "s0", 300), (31, same, None, None, None), (None, same, "en", "s1", 300), (None, text(), "en", "s1", 300), (None, None, None, None, None)]
    rows += [(32, "", "en", "s1", 0), (33, " \n\t ", "fr", None, 4), (34, "12345 !!!", "en", "s2", 9), (34, text(), "en", "s2", 300)]
    return [(None if i is None else BASE + i, *rest) for i, *rest in rows]


@pytest.fixture(scope="module")
def edge(spark, sf_dir):
    """The edge rows among the documents, from which the trained stages learn."""
    return spark.createDataFrame(edge_rows(), DDL).unionByName(table(spark, sf_dir, "documents").select(*corpus_pipeline.COLUMNS).limit(150)).cache()


def kept(spark, name, docs, sf_dir):
    return STAGES[name](spark, docs, sf_dir)


@pytest.mark.parametrize("name", list(STAGES))
def test_clashing_columns_change_nothing(spark, sf_dir, edge, name):
    plain = kept(spark, name, edge, sf_dir)
    more = kept(spark, name, edge.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]), sf_dir)
    assert more.columns == plain.columns
    drop = ["sequence_id", "offset"] if name == "packing" else []
    assert sorted(map(str, more.drop(*drop).collect())) == sorted(map(str, plain.drop(*drop).collect()))
    if name != "packing":
        assert plain.columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table(spark, sf_dir, name):
    assert kept(spark, name, spark.createDataFrame([], DDL), sf_dir).count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_a_long_text_among_others(spark, sf_dir, edge, name):
    """A text of 5 MB that no other document is like goes through every stage whole (the mix takes it or not, and the
    classifier, which has learned from few documents here, decides by its score)."""
    rng = random.Random(2)
    words = PROSE.split()
    long = " ".join(rng.choice(words) for _ in range(1_000_000))
    docs = edge.unionByName(spark.createDataFrame([(10**9, long, "en", "s0", len(long))], DDL))
    out = kept(spark, name, docs, sf_dir).where(f"doc_id = {10**9}")
    if name == "packing":
        assert out.agg(F.sum("length")).first()[0] > 1_000_000
    else:
        found = [r["text"] for r in out.collect()]
        assert all(t == long for t in found)
        if name == "quality":  # kept if the score of the whole text says so
            model = quality.train(docs, table(spark, sf_dir, "labels"))
            score = quality.score(docs.where(f"doc_id = {10**9}"), model, ["doc_id"]).first()["score"]
            assert 0 <= score <= 1
            assert len(found) == int(score >= quality.THRESHOLD)
        else:
            assert len(found) <= 2 if name == "mixing" else len(found) == 1


def test_what_stages_do_with_edges(spark, sf_dir, edge):
    near = kept(spark, "near_duplicates", edge, sf_dir)
    assert near.where(f"doc_id = {BASE + 30}").count() == 1 and near.where(f"doc_id = {BASE + 31}").count() == 0
    assert near.where("doc_id is null and text is not null").count() == 1  # its own text stays, the copy goes
    assert near.where(f"doc_id in ({BASE + 32}, {BASE + 33})").count() == 2
    language = kept(spark, "language", edge, sf_dir)
    assert language.where(f"doc_id in ({BASE + 32}, {BASE + 33}) or text is null or text like '12345%'").count() == 0
    mixed = kept(spark, "mixing", edge, sf_dir)
    assert mixed.where("text is null or trim(text) = ''").count() == 0
    pieces = kept(spark, "packing", edge, sf_dir)
    assert pieces.where(f"doc_id = {BASE + 32}").first()["length"] == 1 and pieces.where(f"doc_id = {BASE + 30}").count() == 2
