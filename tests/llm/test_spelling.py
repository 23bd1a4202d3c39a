"""Spelling variants against brute force over all pairs of words, the automaton, and edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("graticule.llm")

from graticule.llm import spelling
from graticule.llm.common import table

DDL = "doc_id long, text string, word string, n string, key string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counts_of(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def edits(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        yield word[:i] + word[i + 1 :]


def brute(n):
    alphabet = sorted({c for w in n for c in w})
    near = {w: {v for v in edits(w, alphabet) if v in n and v != w} for w in n}
    form = {}
    for w, them in near.items():
        best = min(them, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß×") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    words = []
    for i, stem in enumerate(stems):
        words += [stem] * (1000 // (i + 1))
        if i < 5:  # a chain of forms
            words += [stem + "e"] * 30 + [stem + "ed"] * 2
        for _ in range(12):
            w = stem
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + rng.choice("abcdeXé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdEÉ") + w[at + 1 :]])
            words += [w] * rng.choice([1, 2, 5, 40])
    rng.shuffle(words)
    share = -(-len(words) // n_docs)
    marks = [" ", ", ", "-", "1", "\n", "Š"]
    return [(i, "".join(w + rng.choice(marks) for w in words[i * share : (i + 1) * share])) for i in range(n_docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = spelling.variants(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DDL))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counts_of(rows))
    assert sum(r[1] is not None for r in want) > 20
    assert any(r[1] not in (None, r[2]) for r in want)
    assert {tuple(r) for r in got.collect()} == want


def test_split_halves(spark):
    """Keys of few words and tasks of few rows: what is split finds the same, once."""
    n = counts_of(corpus(3))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(r[0], r[4]) for r in brute(n) if r[4]}
    for in_task, hot in ((40, 3), (10**9, 5), (200, 10**9)):
        got = spelling.near_words(words, in_task, hot).collect()
        assert {(r["word"], r["n_near"]) for r in got} == want
        assert len(got) == len(want)


def test_automaton():
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)})
    made = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = np.array([made.root]), 0
        for c in w:
            edge, there = made.step(state, np.array([c]))
            assert there[0]
            number += int(made.skips[edge[0]])
            state = made.targets[edge]
        assert made.final[state[0]]
        assert number == i
    # as few states as there are different sets of continuations
    ends = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            ends[w[:i]].add(w[i:])
    assert len(made.final) == len({frozenset(x) for x in ends.values()})
    for asked in words[::40]:
        who, number = made.near([asked], np.array([0]))
        assert len(number) == len(set(number.tolist()))
        assert {words[v] for v in number.tolist()} == {v for v in words if v != asked and v in {e.encode("latin-1") for e in edits(asked.decode("latin-1"), "abcé")}}


def test_long_words():
    """Words of 100,000 letters that differ in the middle, and one near word of a word that repeats one letter."""
    rng = random.Random(7)
    long = bytes(rng.choice(b"abcdef") for _ in range(100_000))
    other = long[:70_000] + long[70_001:]
    words = sorted([long, other, b"a" * 30, b"a" * 31])
    made = spelling.Automaton(words)
    who, number = made.near([long, b"a" * 30], np.array([50_000, 15]))
    assert [(w, words[v]) for w, v in zip(who.tolist(), number.tolist(), strict=True)].sort() == [(0, other), (1, b"a" * 31)].sort()
    assert len(number) == 2


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(counts_of(rows))
    assert len(want) > 300
    assert {tuple(r) for r in spelling.variants(docs).collect()} == want


def test_edges(spark):
    rows = [(None, "Wonderful wonderful", None, None, None), (None, "wonderfull Électrique électrique", None, None, None), (1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, "wonderfull", "a", "b", "c"), (3, "wonderfull", "a", "b", "c")]
    want = brute(counts_of([r[:2] for r in rows]))
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DDL)).collect()} == want
    assert spelling.variants(spark.createDataFrame([], DDL)).count() == 0
    long = [(1, "x" * 200_000 + " " + "wonderful " * 40, "a", "b", "c"), (2, "x" * 200_000 + " wondrful wondrful", "a", "b", "c")]
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(long, DDL)).collect()} == brute_long(long)


def brute_long(rows):
    n = counts_of([r[:2] for r in rows])
    short = {w: k for w, k in n.items() if len(w) < 100}
    return brute(short) | {(w, None, w, k, 0, None) for w, k in n.items() if len(w) >= 100}
