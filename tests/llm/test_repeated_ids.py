"""Repeated and null ids, and columns with any names, in the operators that join documents with facts of their own."""

import hashlib

import pytest

pytest.importorskip("graticule.llm")

from pyspark.sql import functions as F

from graticule.llm import fingerprint, langid, mixing

CLASHING = ["_key", "_copies", "_mark", "_bucket", "_many", "_row", "_i", "_part", "row", "key", "part", "many", "size"]


def words(i):
    return " ".join(f"w{(i * 37 + j * j) % 211}" for j in range(20 + i % 7))


def test_many_texts_of_one_id(spark, monkeypatch):
    """200 texts of one id and 200 of null: each row its own fingerprint, whatever parts the id is dealt in."""
    given = [(1, words(i)) for i in range(200)] + [(None, words(500 + i)) for i in range(200)] + [(1, words(3))] * 5 + [(2, "alone in the end"), (None, None)]
    alone = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given)], "doc_id long, text string")
    want = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(alone).collect()}
    docs = spark.createDataFrame(given, "doc_id long, text string")
    marks = {(r["doc_id"], r["text"]): r["m"] for r in docs.withColumn("m", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    first = {k: min((m, t or "") for (d, t), m in marks.items() if d == k)[1] for k in (None, 1, 2)}
    after = {None: first[1], 1: first[2], 2: first[None]}

    def edited(doc_id, text):
        text = text or ""
        return text[: len(text) - len(text) // 4] + after[doc_id][: len(text) // 4]

    expected = sorted((d is not None, d or 0, len(t or ""), hashlib.sha256(edited(d, t).encode()).hexdigest(), want[i]) for i, (d, t) in enumerate(given))
    for hot in (16, 4096):
        monkeypatch.setattr(fingerprint, "HOT", hot)
        got = fingerprint.fingerprint_documents(docs).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == expected


def test_hot_null_id_is_dealt_in_parts(spark, monkeypatch):
    """No task of the fingerprints holds all rows of null."""
    monkeypatch.setattr(fingerprint, "HOT", 50)
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    asked = []
    real = fingerprint.signatures

    def seen(texts, sides, partition, samples):
        asked.append((partition, texts.groupBy("key", "part").count().agg(F.max("count")).first()[0]))
        return real(texts, sides, partition, samples)

    monkeypatch.setattr(fingerprint, "signatures", seen)
    assert fingerprint.fingerprint_documents(docs).count() == 3000
    assert asked[0][0] == ["key", "part", "mark"]
    assert asked[0][1] < 150


def test_fingerprint_of_a_long_text(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(800_000))  # 5 MB
    rows = [(1, long), (2, long + " x"), (3, "short text")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] > 0.95
    assert got[1]["n_chars"] == len(long)


def test_take_with_clashing_columns(spark):
    rows = [(i, f"a b c d {i}" * (1 + i % 3), "st"[i % 2]) for i in range(60)] + [(7, "a b", None)] * 3
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.take(plain).collect()))
    assert len(want) > 80
    more = plain.select("*", *[F.lit(i % 3).alias(c) for i, c in enumerate(CLASHING)])
    got = mixing.take(more)
    assert got.columns == more.columns
    assert got.where("_key is null or _copies is null").count() == 0
    assert sum(r.asDict()["doc_id"] is not None for r in got.collect()) == len(want)


def test_take_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, _row int")
    assert mixing.take(none).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 10)
    with pytest.raises(ValueError, match="more than 10 languages"):
        langid.train(docs)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 100)
    monkeypatch.setattr(langid, "MAX_FILTER", 1000)
    with pytest.raises(ValueError, match="bytes"):
        langid.train(docs)
