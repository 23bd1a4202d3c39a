"""Blocks of the n-gram join that are bounded by n-grams: the same links, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("graticule.llm")

from graticule.llm import ngram_join


def brute(texts, width=4, percent=85):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    n = len(texts)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in linked[i]:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), top(i), len(linked[i])) for i in range(n)}


def families(seed, sizes=(60, 25, 9, 2, 1), words=120):
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([words, words * 3]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(own[: len(own) - rng.randrange(3)]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("grams", "paired"), [(400, 1000), (1500, 4), (200, 1)])
def test_links_do_not_depend_on_blocks(spark, monkeypatch, grams, paired):
    texts = families(grams)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert got == brute(texts)


def test_memory_of_a_product():
    """Two blocks of as many n-grams as a block may hold."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    sets = []
    for _ in range(2 * ngram_join.BLOCK_GRAMS // 20_000):
        own = base.copy()
        own[rng.integers(0, 20_000, 300)] = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        sets.append(np.unique(own))
    half = len(sets) // 2
    tracemalloc.start()
    both = ngram_join.overlap(sets[:half], sets[half:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert both[0, 0] == len(np.intersect1d(sets[0], sets[half]))
    assert peak < 300 << 20
