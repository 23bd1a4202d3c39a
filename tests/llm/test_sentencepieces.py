"""Distinct-chunk encoding against the library itself on whole texts."""

import hashlib
import random
import tracemalloc

import pytest

pytest.importorskip("graticule.llm")
sentencepiece = pytest.importorskip("sentencepiece")

import pyarrow as pa

from graticule.llm import sentencepieces
from graticule.llm.common import table, tokenizer_path
from graticule.llm.textkernel import blocks

MODEL = tokenizer_path(sentencepieces.MODEL)
DDL = "doc_id long, text string, ids string, decoded string, lang string"
ODD = ["", " ", "  ", "a", "a ", " a", "  a  b   ", "▁", "a▁b", "▁ ▁x", "tab\tand\nline \r\n end", "x\x00y", "é 中文 𝄞 日本語! 🙂", "<s> </s> <unk> <0x41>", "it's 42%", " nb　sp", "é ﻿ ​", "a" * 5000, " " * 300, "\n" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(texts, library, limit=1 << 19):
    chunks = sentencepieces.Chunks(MODEL)
    at = 0
    for _, block in blocks(pa.array(texts, pa.string()), limit):
        got = chunks.encode(block, True)
        for ids, said in zip(got["ids"].to_pylist(), got["decoded"].to_pylist(), strict=True):
            text = texts[at] or ""
            want = library.encode(text, add_eos=True)
            assert ids == want, text[:80]
            assert said == library.decode(want), text[:80]
            at += 1
    assert at == len(texts)


def test_odd_texts(library):
    check([*ODD, None], library)
    check([*ODD, None], library, limit=1)


def test_random_texts(library):
    rng = random.Random(4)
    marks = [" ", "  ", "▁", "\n", "a", "the", "Th", "é", "ß", "中", "𝄞", ".", "1", "\t", "ing", "-", "́", "\x7f"]
    check(["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(3000)], library)
    check(["".join(chr(rng.choice([rng.randrange(32, 600), rng.randrange(0x2570, 0x2590), rng.randrange(0xE000, 0x10000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(1500)], library)


def test_memory_turns_over(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 10)
    monkeypatch.setattr(sentencepieces, "LONGEST", 6)
    monkeypatch.setattr(sentencepieces, "AT_ONCE", 7)
    rng = random.Random(5)
    check([" ".join(rng.choice(["one", "two", "threefold", "fourteen", "x", "yes", "no"]) + str(rng.randrange(30)) for _ in range(60)) for _ in range(80)], library, limit=400)


def test_long_text(library):
    """A text of 3 MB of distinct words, in bounded memory."""
    text = " ".join(f"w{i:x}" for i in range(450_000))
    (_, block), *_ = blocks(pa.array([text]))
    chunks = sentencepieces.Chunks(MODEL)
    head = text[: text.index(" ", 200_000)]
    want = library.encode(head)
    tracemalloc.start()
    got = chunks.encode(block, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["ids"][0].values.slice(0, len(want)).to_pylist() == want
    assert got["decoded"][0].as_py() == text
    assert peak < 200e6


def test_refuses_crossing_pieces(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    sentencepieces.check_vocabulary(MODEL)
    proto.pieces[500].piece = "of▁the"
    crossing = tmp_path / "crossing.model"
    crossing.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        sentencepieces.check_vocabulary(str(crossing))


def test_query(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = sentencepieces.encoded_digests(docs, MODEL).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark):
    rows = [(1, "a b", "x", "y", None), (1, "a b", "x", "y", None), (None, "a b", None, None, None), (2, None, None, None, "en"), (3, "", None, None, None)]
    got = sentencepieces.encoded_digests(spark.createDataFrame(rows, DDL), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 1), (3, 1)]
    assert {r["ids_sha256"] for r in got if r["n_tokens"] == 1} == {hashlib.sha256(b"2").hexdigest()}
    assert sentencepieces.encoded_digests(spark.createDataFrame([], DDL), MODEL).count() == 0
    kept = sentencepieces.encode(spark.createDataFrame(rows, DDL).select("doc_id", "lang", "text"), MODEL, ["lang", "doc_id"], end=False)
    assert kept.columns == ["lang", "doc_id", "ids", "decoded"]
