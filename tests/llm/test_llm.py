"""The training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graticule.llm")

from graticule.llm import ann, components, fingerprint, langid, licenses, mixing, ngram_join, packing, quality, sharding, textkernel, tokencount
from graticule.llm import queries as registered
from graticule.llm.common import table, tokenizer_path, word_count
from graticule.llm.textkernel import blocks, shingle_hashes

DDL = "doc_id long, text string, lang string, source string, n_chars long, _bucket string, size string"
LONG = "word " * 30_000
#: Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and columns with clashing names.
EDGE = [
    (1, "a b c d e f", "en", "s", 11, "x", "y"),
    (1, "a b c d e f", "en", "s", 11, "x", "y"),
    (2, None, None, None, None, None, None),
    (None, "a b c d e f", "en", None, 11, None, None),
    (3, "", "fr", "s", 0, "x", "y"),
    (4, " \n\t ", "fr", "t", 4, "x", "y"),
    (5, LONG, "en", "s", len(LONG), "x", "y"),
    (6, "Émile était là, 日本語! <|endoftext|> it's 42", "fr", "t", 40, "x", "y"),
    (-(2**62), "x", "en", "s", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def words_of(text, lower=False):
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_shingles():
    given = ["a  bb\nccc", None, "", " ", "x", "é日 y\x0bz q", "w w w w w"]
    for limit in (1, 1 << 20):
        got, runs = [], []
        for _, block in blocks(pa.array(given), limit):
            starts, ends, doc = block.words()
            hashes = block.hashes(starts, ends)
            values, first = shingle_hashes(hashes, doc, block.n, 2)
            for i in range(block.n):
                got.append([block.data[a:b].tobytes().decode() for a, b, d in zip(starts, ends, doc, strict=True) if d == i])
                runs.append(values[first[i] : first[i + 1]].tolist())
        assert got == [words_of(x) for x in given]
        assert [len(r) for r in runs] == [2, 0, 0, 0, 1, 3, 4]
        assert len(set(runs[6])) == 1


def test_hashes_do_not_depend_on_strides(monkeypatch):
    (_, block), = blocks(pa.array(["a bb ccc a bb", "", "Ccc a  dddd"]))
    starts, ends, _ = block.words()
    want = block.hashes(starts, ends).tolist()
    assert want[0] == want[3] == want[6] and want[2] == want[5]
    size = 4
    monkeypatch.setattr(textkernel, "STRIDE", size)
    monkeypatch.setattr(textkernel, "_STRIDE_POWER", pow(textkernel._BASE, size, 1 << 64))
    monkeypatch.setattr(textkernel, "_STRIDE_INVERSE", pow(textkernel._BASE_INVERSE, size, 1 << 64))
    assert block.hashes(starts, ends).tolist() == want


def test_word_count(spark, edge):
    got = edge.select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(words_of(r["text"])) for r in got)


# 1. fingerprints


def bag(text):
    return collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def likeness(a, b):
    keys = set(a) | set(b)
    most = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / most if most else 1.0


def test_fingerprints_estimate_generalised_jaccard(docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    ids = sorted(texts)
    errors, by_text = [], {}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, following = texts[i], texts[after]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row["near_edited"] - likeness(bag(text), bag(edited)), row["near_next"] - likeness(bag(text), bag(following))]
        by_text.setdefault(text, set()).add(row["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert np.sqrt(np.mean(np.square(errors))) < 0.08 and abs(np.mean(errors)) < 0.02


def test_fingerprint_edges(edge, none):
    got = fingerprint.fingerprint_documents(edge).collect()
    assert len(got) == len(EDGE)
    empty = [r for r in got if r["n_chars"] in (0, 4)]
    assert all(set(r["fingerprint"]) == {"0"} for r in empty)
    assert fingerprint.fingerprint_documents(none).count() == 0
    single = fingerprint.fingerprint_documents(edge.where("doc_id = 6")).first()
    assert single["near_next"] == 1.0


# 2. quality


def test_quality_on_held_out_rows(spark, sf_dir):
    got = registered.op2_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 5 and right >= 0.9 * len(got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got)


def test_flattened_trees_fit_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit(x, y, n_trees=30)
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.97
    one = [float(trees.score(x[i : i + 1])[0]) for i in range(20)]
    assert one == pytest.approx(trees.score(x[:20]).tolist())
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x, np.ones(2000)).score(x).min() > 0.9


def plain_statistics(text):
    """The statistics of one text, one by one."""
    raw = text.encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words, low = ([w for w in re.split(rb"[\x20\x09-\x0D]+", x) if w] for x in (raw, lower))
    lines = [x + b"\n" for x in lower.split(b"\n")]
    lines = lines[:-1] + ([lines[-1][:-1]] if lines[-1] != b"\n" else [])
    count = collections.Counter(raw)
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in count.values()) if raw else 0.0
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(len(words), 1)
    spread = math.sqrt(max(sum(n * n for n in sizes) / max(len(words), 1) - mean * mean, 0))
    runs = [tuple(low[i : i + 3]) for i in range(len(low) - 2)] if len(low) >= 3 else [tuple(low)] if low else []
    repeats = lambda xs: (len(set(xs)) / len(xs), max(collections.Counter(xs).values()) / len(xs)) if xs else (1.0, 0.0)
    per = lambda n: n / max(len(words), 1)
    marks = {c for name in ("bang", "mark") for a, b in quality._CLASSES[name] for c in range(a, b + 1)}
    return [
        *(sum(count[c] for a, b in ranges for c in range(a, b + 1)) / max(len(raw), 1) for ranges in quality._CLASSES.values()),
        *(math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), mean, spread, len(words) / max(len(lines), 1), entropy, *repeats(low)),
        *(per(sum(a == b for a, b in zip(low, low[1:], strict=False))), per(sum(len(w) > 1 and 65 <= w[0] <= 90 and 65 <= w[1] <= 90 for w in words)), per(sum(w[-1] in marks for w in words))),
        *(*repeats(runs), *repeats(lines)),
    ]


def test_statistics_equal_plain_ones(docs):
    given = ["", " \n\t ", "A", "ONE two two!! \n\nx1 é日 one TWO two\nx1 é日 one", "\n", "a\nb", "same same same same", *[r["text"] for r in docs.limit(60).collect()]]
    for limit in (1, 1 << 20):
        got = np.concatenate([quality.statistics(block) for _, block in blocks(pa.array(given), limit)])
        assert got.shape[1] == len(quality.FEATURES) == 27
        for row, text in zip(got, given, strict=True):
            assert row.tolist() == pytest.approx(plain_statistics(text), abs=1e-9), text[:40]


def test_trees_are_walked_as_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    trees = quality.fit(x, (x[:, 0] * x[:, 2] > 0).astype(float), n_trees=7)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.limit[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    assert trees.score(x).tolist() == pytest.approx([walk(row) for row in x])


def test_training_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())) or fit(x, y))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = spark.createDataFrame([(i, f"text {i} {j}" * (j + 1)) for i in ids for j in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    for parts in (1, 7):
        quality.train(rows.repartition(parts), labels, 13)
    assert len(seen[0][1]) == 13 and seen[0] == seen[1]


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 0), (None, 1, 1), (6, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}


# 3. sharding


def test_sharding_law(docs, texts):
    got = sharding.shard_documents(docs).collect()
    per = collections.defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        per[r["shard"]].append(r["slot"])
    assert set(per) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in per.values())


@pytest.mark.parametrize("n", [1, 7, 8, 24])
def test_growth_moves_rows_into_the_new_shard_only(spark, n):
    keys = spark.range(3000).select("id", sharding.assign(F.col("id"), sharding.default_tree(n)).alias("a"), sharding.assign(F.col("id"), sharding.default_tree(n + 1)).alias("b")).collect()
    assert all(r["b"] in (r["a"], n) for r in keys)
    moved = sum(r["b"] == n for r in keys)
    assert 0.7 < moved / (3000 / (n + 1)) < 1.3


def test_weights_decide_shares(spark):
    tree = [sharding.Leaf(0, 0, 0, 3.0), sharding.Leaf(1, 0, 1, 1.0), sharding.Leaf(2, 1, 0, 0.0)]
    got = collections.Counter(r["s"] for r in spark.range(4000).select(sharding.assign(F.col("id"), tree).alias("s")).collect())
    assert set(got) == {0, 1} and 2.5 < got[0] / got[1] < 3.6


def plain_descent(key, leaves):
    """The tree's rule for one key, in Python integers."""
    wide = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & wide
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & wide
        return x ^ x >> 31

    def draw(node, nth):
        return ((mix((mix(key ^ sharding.salt(node)) + nth * 0x9E3779B97F4A7C15) & wide) >> 11) + 0.5) / 2**53

    def least(nodes, nth):
        return min(nodes, key=lambda n: -math.log(draw(n[0], nth)) / n[1])[2]

    found = []
    for region in sorted({x.region for x in leaves}):
        mine = [x for x in leaves if x.region == region]
        if not any(x.weight for x in mine):
            continue
        time = 0.0
        for nth in range(10_000):
            time -= math.log(draw(f"region-{region}", nth)) / sum(x.room for x in mine)
            racks = sorted({x.rack for x in mine})
            rack = least([(f"region-{region}-rack-{r}", sum(x.room for x in mine if x.rack == r), r) for r in racks], nth)
            leaf = least([(f"shard-{x.shard}", x.room, x) for x in sorted(mine, key=lambda x: x.shard) if x.rack == rack], nth)
            if draw(f"region-{region}-rack-{rack}-taken", nth) < leaf.weight / leaf.room:
                found.append((time, leaf.shard))
                break
    return min(found)[1]


def test_descent_is_that_of_the_plain_tree():
    keys = np.random.default_rng(1).integers(0, 2**64, size=300, dtype=np.uint64)
    for leaves in (sharding.default_tree(24), sharding.default_tree(9), [sharding.Leaf(5, 2, 1, 0.25), sharding.Leaf(1, 2, 0, 3.0), sharding.Leaf(9, 0, 0, 0.5, 2.0)]):
        assert sharding.Tree(leaves).descend(keys).tolist() == [plain_descent(int(k), leaves) for k in keys]


def test_a_weight_moves_keys_to_and_from_its_shard_only():
    keys = np.random.default_rng(2).integers(0, 2**64, size=20_000, dtype=np.uint64)
    tree = sharding.default_tree(24)
    before = sharding.Tree(tree).descend(keys)
    less = [dataclasses.replace(x, weight=0.25) if x.shard == 13 else x for x in tree]
    after = sharding.Tree(less).descend(keys)
    moved = before != after
    assert set(before[moved]) == {13} and 0.2 < (after == 13).sum() / (before == 13).sum() < 0.3
    # within a rack: only that rack gives or takes
    other = [dataclasses.replace(x, weight=0.5) if x.shard in (12, 14) else x for x in tree]
    again = sharding.Tree(other).descend(keys)
    assert set(before[before != again]) == {12, 14}
    shares = np.bincount(before, minlength=24) / len(keys)
    assert shares.min() > 0.03 and shares.max() < 0.055
    with pytest.raises(ValueError):
        sharding.Tree([sharding.Leaf(0, 0, 0, 0.0)])


def test_equal_rows_are_numbered_as_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = spark.createDataFrame([(None, "")] * 40 + [(i, "x") for i in range(30)] + [(3, "x")] * 9, "doc_id long, text string").repartition(4)
    per = collections.defaultdict(list)
    for r in sharding.shard_documents(rows, 3).collect():
        per[r["shard"]].append(r["slot"])
    assert sum(map(len, per.values())) == 79 and all(sorted(s) == list(range(len(s))) for s in per.values())


def test_sharding_edges(edge, none):
    got = sharding.shard_documents(edge).collect()
    assert len(got) == len(EDGE) and len({(r["shard"], r["slot"]) for r in got}) == len(EDGE)
    assert sharding.shard_documents(none).count() == 0


# 4. packing


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    got = packing.pack_documents(docs, tokenizer_path(packing.VOCABULARY)).collect()
    pieces, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], dtype="<u4")
            row = pieces[i].pop(p)
            assert (row["start"], row["length"], row["ids_crc32"]) == (a, len(part), zlib.crc32(part.tobytes()))
        assert not pieces[i]
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(sequences) <= math.ceil(total / 2048) * 1.05 + 1


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_never_worse_than_first_fit_by_much(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 100) for _ in range(r.choice([1, 2, 50, 400]))])
    bins, offsets = packing.best_two_fit(lengths, 100)
    held = collections.defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        held[b].append((o, n))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 100
    free = []
    for n in sorted(lengths, reverse=True):
        place = next((i for i, f in enumerate(free) if f >= n), None)
        if place is None:
            free.append(100 - n)
        else:
            free[place] -= n
    assert len(held) <= len(free)


def test_packing_edges(edge, none):
    got = packing.pack_documents(edge, tokenizer_path(packing.VOCABULARY)).collect()
    assert sum(r["piece"] == 0 for r in got) == len(EDGE)
    assert {r["length"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert packing.pack_documents(none, tokenizer_path(packing.VOCABULARY)).count() == 0


def test_equal_pieces_are_dealt_to_all_groups(spark, monkeypatch):
    rows = [(None, 0, 0, 1, 9)] * 300 + [(i, 0, 0, 5, i) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(6)
    got = packing.pack_pieces(frame, 16, 20).collect()
    assert len(got) == 400
    per = collections.Counter(r["sequence_id"] % 20 for r in got if r["doc_id"] is None)
    assert len(per) == 20 and max(per.values()) < 40
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16


def plain_best_two_fit(lengths, capacity):
    """Bins as lists of lengths: greedily by the largest that fits, then exchanges of the smallest for the tightest two."""
    left, out = sorted(lengths), []
    while left:
        inside, gap = [], capacity
        while fitting := [x for x in left if x <= gap]:
            inside.append(fitting[-1])
            left.remove(fitting[-1])
            gap -= inside[-1]
        while gap and left:
            low = min(inside)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if low < a + b <= gap + low]
            if not pairs:
                break
            total, a, b = max(pairs)
            for x in (a, b):
                left.remove(x)
                inside.append(x)
            inside.remove(low)
            left = sorted([*left, low])
            gap += low - total
        out.append(sorted(inside))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_is_the_plain_one(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 60), r.randint(20, 40), 7]) for _ in range(60)]
    bins, _ = packing.best_two_fit(np.array(lengths), 60)
    held = collections.defaultdict(list)
    for b, n in zip(bins.tolist(), lengths, strict=True):
        held[b].append(n)
    want = plain_best_two_fit(lengths, 60)
    assert sorted(map(sum, held.values())) == sorted(map(sum, want)) and len(held) == len(want)


def test_long_texts_are_tokenised_in_slices(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    encoder = packing.Encoder.of(tokenizer_path(packing.VOCABULARY))
    r = random.Random(6)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 50)
    monkeypatch.setattr(packing, "slices", lambda block: textkernel.slices(block, 50))
    for pool in ("aZ0 9\t\n!?.é Éß", "aΣ 'sé日e\u0301 \u2003<|x", "ab"):
        text = "".join(r.choice(pool) for _ in range(900))
        (_, block), = blocks(pa.array([text]))
        assert sum(len(x.data) for x in textkernel.slices(block, 50)) == len(block.data)
        assert encoder.encode(block)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_are_the_tokenizers_own(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    encoder = packing.Encoder.of(tokenizer_path(packing.VOCABULARY))
    r = random.Random(1)
    pool = "aZ0 9\t\n!?.é ÉßÿŸ×÷ñ'<|>\x85\xa0ſİ日\x1c_"
    given = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "it's we'll", "<|endoftext|>"]
    for limit, memory in ((1 << 20, 1 << 20), (300, 40)):  # all at once, and in small blocks with a short memory
        monkeypatch.setattr(packing, "MEMORY", memory)
        for at, block in blocks(pa.array(given), limit):
            ids, first = encoder.encode(block)
            for i in range(block.n):
                assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(given[at + i] or "", add_special_tokens=False).ids


# 5. n-gram join


def brute_join(texts, width, percent):
    sets = {}
    for i, text in texts.items():
        w = words_of(text, lower=True)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i), links[i]) for i in ids}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(docs, texts, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs, ngram_join.Rule(width, percent)).collect()}
    assert got == brute_join(texts, width, percent)


def test_join_of_families_and_shared_passages(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = make(30), []
    for _ in range(3):
        base = make(r.choice([8, 60, 200]))
        for _ in range(30):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 12))):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join(make(40) + passage + make(5)) for _ in range(40)] + ["A b", "a B", "", "same same same same same same"]
    texts = dict(enumerate(rows))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)  # several blocks per group
    monkeypatch.setattr(ngram_join, "FAMILY_ROWS", 8)
    for paired in (16, 2):  # groups whose blocks all meet, and groups whose blocks meet where they share an n-gram
        monkeypatch.setattr(ngram_join, "PAIRED", paired)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in ngram_join.join(frame).collect()}
        assert got == brute_join(texts, 4, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in ngram_join.join(frame).collect()}
    assert got == brute_join(texts, 4, 85)


def test_a_chain_of_families_costs_in_proportion(spark, monkeypatch):
    """Families that share a passage with the next one only: one group, of which few pairs of blocks are multiplied."""
    r = random.Random(9)
    make = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    rows, families, each = [], 40, 12
    seam = make(14)
    for _ in range(families):
        body, after = make(40), make(14)
        for k in range(each):
            copy = [*(seam if k % 2 else make(14)), *body, *(after if k % 3 else make(14))]
            copy[r.randrange(len(copy))] = f"e{r.randrange(10**7)}"
            rows.append(" ".join(copy))
        seam = after
    texts = dict(enumerate(rows))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "FAMILY_ROWS", 8)
    monkeypatch.setattr(ngram_join, "PAIRED", 1)  # no group but the smallest meets in full
    made = []
    pairs = ngram_join.block_pairs
    monkeypatch.setattr(ngram_join, "block_pairs", lambda members, packed: made.append(pairs(members, packed)) or made[-1])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in ngram_join.join(frame).collect()}
    assert got == brute_join(texts, 4, 85)
    blocks_of, found = made[0]
    n_blocks = blocks_of.select("block").distinct().count()
    assert n_blocks >= 30 and found.count() < 12 * n_blocks < n_blocks * n_blocks / 2


def test_size_classes_beyond_a_byte(spark):
    r = random.Random(11)
    rows = {}
    for i, n in enumerate((1000, 5000, 9000)):
        base = [f"w{i}_{k}" for k in range(n)]
        rows[10 * i], rows[10 * i + 1] = " ".join(base), " ".join([*base, "more"])
        base[r.randrange(n)] = "other"
        rows[10 * i + 2] = " ".join(base)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in ngram_join.join(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), ngram_join.Rule(4, 97)).collect()}
    assert got == brute_join(rows, 4, 97) and all(x[2] for x in got.values())


def test_overlap_is_the_product(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    sets = [np.unique(rng.integers(0, 60, size=n)).astype(np.uint64) for n in (5, 40, 1, 30, 22)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.overlap(sets).tolist() == want
    assert ngram_join.overlap(sets[:2], sets[2:]).tolist() == [row[2:] for row in want[:2]]


def test_join_edges(edge, none):
    got = sorted(ngram_join.join(edge).collect(), key=str)
    assert len(got) == len(EDGE)
    same = [r for r in got if r["n_shingles"] == 3]
    assert len(same) == 3 and {r["component_id"] for r in same} == {1} and {r["n_links"] for r in same} == {2}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert ngram_join.join(none).count() == 0


def near_copies(n=34):
    """Three texts, of which the first and the last are linked only through the second."""
    base = [f"w{i}" for i in range(n)]
    return " ".join(base), " ".join([*base[2:], "x1", "x2"]), " ".join([*base[4:], "x1", "x2", "x3", "x4"])


def test_join_links_near_copies_without_a_doc_id(spark):
    one, bridge, two = near_copies()
    alone = " ".join(f"v{i}" for i in range(30))
    rows = [(1, one), (2, two), *[(None, bridge)] * 5, (7, alone), (7, alone), (8, alone + " y"), (None, "p q r s t"), (None, "P q r s t"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.join(frame).select("doc_id", "component_id", "n_links").collect()]
    want = [(1, 1, 5), (2, 1, 5), *[(None, 1, 6)] * 5, (7, 7, 2), (7, 7, 2), (8, 7, 2), (None, None, 1), (None, None, 1), (None, None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == got[1000] == 1000


def test_components_of_a_large_star(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 50)] + [(5000 + i, 9000) for i in range(200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[b] == got[a] for a, b in edges) and got[299] == got[1049] == 0 and got[9000] == 5000


# 6. token counts


def test_token_counts_equal_an_unshared_search(docs, texts):
    path = tokenizer_path(tokencount.VOCABULARY)
    scores = {k: v for k, v in tokencount.pieces_of(path).items() if v is not None}
    known = {}

    def count(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                best.append(max((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores))
            known[word] = -best[-1][1]
        return known[word]

    for r in tokencount.count_tokens(docs, path).collect():
        words = words_of(texts[r["doc_id"]])
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(count(b" " + w.encode()) for w in words))


def test_forgetting_counts_changes_nothing(docs, monkeypatch):
    path = tokenizer_path(tokencount.VOCABULARY)
    given = pa.array([r["text"] for r in docs.limit(40).collect()])
    count = lambda limit: [x for _, b in blocks(given, limit) for x in tokencount.count_block(b, path)["n_tokens"].tolist()]
    want = count(1 << 20)
    for name, value in (("MEMORY", 50), ("TRIE_WORDS", 7), ("WORDS_AT_ONCE", 11), ("TRIE_BYTES", 5), ("SLICE", 3)):
        monkeypatch.setattr(tokencount, name, value)
        tokencount.Counter.of(path).forget()
        assert count(1000) == want


def test_unbroken_words_are_counted_in_bounded_memory():
    path = tokenizer_path(tokencount.VOCABULARY)
    scores = {k: v for k, v in tokencount.pieces_of(path).items() if v is not None}
    r = random.Random(3)
    word = "".join(r.choice("abcde日é") for _ in range(70_000))
    raw = b" " + word.encode()
    best = [(0.0, 0)]
    for end in range(1, len(raw) + 1):
        best.append(max((best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(max(0, end - 128), end) if raw[s:end] in scores))
    (_, block), = blocks(pa.array([word]))
    assert tokencount.count_block(block, path)["n_tokens"].tolist() == [-best[-1][1]]
    (_, block), = blocks(pa.array(["x" * 10_000_000]))
    tracemalloc.start()
    tokencount.count_block(block, path)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_token_count_edges(edge, none):
    path = tokenizer_path(tokencount.VOCABULARY)
    got = tokencount.count_tokens(edge, path).collect()
    assert len(got) == len(EDGE) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert tokencount.count_tokens(none, path).count() == 0


# 7. mixing


def test_mix_meets_its_targets(docs):
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    largest = collections.Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(size[s] == r["source_size"] for r in got for s in [r["source"]])
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in size)
    assert sum(taken.values()) <= 1.5 * sum(size.values())


def test_mix_is_the_same_again_and_over_other_partitions(docs):
    key = lambda df: sorted(map(tuple, mixing.mix(df).select("doc_id", "taken").collect()))
    assert key(docs) == key(docs.repartition(7))


def test_mix_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall())
    assert sorted(map(tuple, registered.op7_mixing(spark, sf_dir).collect())) == want


def test_mix_edges(edge, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(none).count() == 0
    assert {r["taken"] for r in mixing.mix(edge.where("doc_id in (2, 3)")).collect()} == {0}


def test_equal_rows_queue_as_runs(spark, monkeypatch):
    rows = [(None, "same words here", "a")] * 70 + [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)] + [(None, f"other {i}", None) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    monkeypatch.setattr(mixing, "RUN", 8)
    got = sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    assert got == want and len(got) == len(rows)
    taken = collections.Counter(tuple(r) for r in mixing.take(frame).select("doc_id", "text").collect())
    assert sum(len(t.split()) * n for (_, t), n in taken.items()) == sum(r[4] for r in got)
    assert taken[(None, "same words here")] == sum(r[4] for r in got if r[0] is None and r[1] == 3) / 3


# 8. licences


def test_license_lines_are_found(docs, texts):
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "all-rights-reserved"}
    lines["This work is licensed under the GNU General Public License, version 3."] = "GPL-3.0-only"
    for r in licenses.scan_documents(docs).collect():
        assert set(r["licenses"]) == {name for line, name in lines.items() if line in texts[r["doc_id"]]}


def test_rules_need_their_sentences_in_order():
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES)
    say = lambda *names: "\n".join(licenses.SENTENCES[n] for n in names).encode()
    find = lambda text: scanner.match(scanner.identify(text))
    assert find(say("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")) == ["BSD-3-Clause"]
    assert find(say("bsd-redistribution", "bsd-source", "bsd-binary")) == ["BSD-2-Clause"]
    assert find(say("bsd-binary", "bsd-source", "bsd-redistribution")) == []
    assert find(say("mit-grant", "all-rights", "mit-notice")) == ["MIT"]
    wrapped = licenses.SENTENCES["mit-grant"].replace(" copy", "\n *  copy").upper().encode()
    assert find(wrapped) == ["MIT"]
    assert find(b"The MIT License was discussed. Permission is granted.") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("This file is licensed under the MIT License.", ["MIT"]),
        ("Distributed under the MIT licence, see LICENSE.", ["MIT"]),
        ("This code is available under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("Released under the GPL-2.0 or later.", ["GPL-2.0-or-later"]),
        ("This program is licensed under the GNU GPL v2.", ["GPL-2.0-only"]),
        ("This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("# SPDX-License-Identifier: (Apache-2.0 OR MIT)", ["Apache-2.0", "MIT"]),
        ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nint x;", ["GPL-2.0-only"]),
        ("It was not released under the MIT License.", []),
    ],
)
def test_license_notices_beyond_the_tables(text, want):
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES)
    assert scanner.match(scanner.identify(text.encode())) == want


def test_named_organisation_is_bsd_3():
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES)
    head = "\n".join(f"{i}. {licenses.SENTENCES[n]}" for i, n in enumerate(["bsd-redistribution", "bsd-source", "bsd-binary"]))
    text = head + "\n3. Neither the name of Example, Inc. nor the names of its contributors may be used to\n endorse or promote products derived from this software without specific prior written permission."
    assert scanner.match(scanner.identify(text.encode())) == ["BSD-3-Clause"]


def test_license_edges(edge, none):
    got = licenses.scan_documents(edge).collect()
    assert len(got) == len(EDGE) and all(r["licenses"] == [] for r in got)
    assert licenses.scan_documents(none).count() == 0


# 9. language


def test_language_on_held_out_rows(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in got)


def test_filters_hold_what_they_were_given():
    (_, block), = blocks(pa.array(["Über den Fluss", "", "a1b", "12 !?"]))
    (code, doc), = langid.grams(block)
    low = [bytes([c & 255, c >> 8 & 255, c >> 16 & 255, c >> 24]).decode("utf-8", "replace") for c, d in zip(code.tolist(), doc.tolist(), strict=True) if d == 0]
    assert " den" in low and "den " in low and "luss" in low and not any("n f" in g for g in low)
    assert set(doc.tolist()) <= {0, 2}
    assert langid.has_letter(block).tolist() == [True, False, True, False]


def brute_grams(text):
    """The n-grams of an ASCII text: four bytes, the second no blank, the third no blank before a letter."""
    low = "  " + "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in text) + "  "
    return [low[i : i + 4] for i in range(len(low) - 3) if low[i + 1] != " " and (low[i + 2] != " " or low[i + 3] == " ")]


def test_slices_change_no_counts(monkeypatch):
    given = ["The cat  sat, on a MAT", "", "x", "one two three"]
    whole, = langid.grams(next(blocks(pa.array(given)))[1])
    say = lambda code: bytes([code & 255, code >> 8 & 255, code >> 16 & 255, code >> 24]).decode()
    for i, text in enumerate(given):
        assert collections.Counter(say(c) for c, d in zip(*map(np.ndarray.tolist, whole), strict=True) if d == i) == collections.Counter(brute_grams(text))
    monkeypatch.setattr(langid, "SLICE", 5)
    parts = list(langid.grams(next(blocks(pa.array(given)))[1]))
    assert np.concatenate([c for c, _ in parts]).tolist() == whole[0].tolist() and np.concatenate([d for _, d in parts]).tolist() == whole[1].tolist()


def test_filters_equal_sets_of_ngrams(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdefgh"[k : k + 6]) for _ in range(r.randint(1, 7))) for _ in range(40)), f"l{k}") for i in range(90) for k in [i % 3]]
    rows += [(1000 + i, rows[0][1], "l0") for i in range(50)] + [(2000, None, "l1"), (None, "gggg", "l2"), (2001, "zz zz", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.train(frame)
    learned = [(i, t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(str("" if i is None else i).encode()) % 3 != 1]
    held = {x: collections.Counter() for x in found.languages}
    for text, lang in {(t, x) for _, t, x in learned}:
        held[lang].update(brute_grams(text))
    assert found.languages == ["l0", "l1", "l2"]
    assert found.coverage.tolist() == pytest.approx([1 - sum(n == 1 for n in held[x].values()) / sum(held[x].values()) for x in found.languages])
    asked = [t for _, t, _ in rows[:90]]
    total, hits = found.counts(next(blocks(pa.array(asked)))[1])
    for i, text in enumerate(asked):
        own = brute_grams(text)
        assert total[i] == len(own)
        for j, lang in enumerate(found.languages):
            real = sum(g in held[lang] for g in own)
            assert real <= hits[i, j] <= real + 0.05 * len(own) + 3  # all that are there, and few that are not


def test_languages_of_few_documents_keep_theirs(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    words = ["".join(r.choice("kqxzwjyv") + r.choice("aou") for _ in range(r.randint(1, 3))) for _ in range(400)]
    text = lambda: " ".join(r.choice(words) for _ in range(250))
    ids = [i for i in range(10**6, 10**6 + 40) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    others = [i for i in range(2 * 10**6, 2 * 10**6 + 60) if zlib.crc32(str(i).encode()) % 3 == 1][:10]
    few = [(i, text(), "qq", "s", 1) for i in [*ids, *others]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    both = docs.select(*pipeline.COLUMNS).unionByName(spark.createDataFrame(few, schema).select(*[F.col(f).cast(docs.schema[f].dataType) for f in pipeline.COLUMNS]))
    kept = {x["doc_id"] for x in pipeline.language_stage(spark, both, "").collect()}
    assert set(ids) | set(others) <= kept
    named = {x["doc_id"]: x["lang_pred"] for x in langid.identify(both).collect()}
    assert all(named[i] == "qq" for i in others)


def test_more_than_eight_languages(spark):
    rows = [(i, f"{chr(97 + i % 11) * 3}{chr(97 + i % 11)}o{chr(97 + i % 11)}el " * 9, f"l{i % 11:02d}") for i in range(220)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 11:02d}" for r in got)


def test_language_edges(edge, none):
    got = langid.identify(edge).collect()
    assert len(got) == len(EDGE)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 10. neighbours


def brute_neighbours(rows, k, asks):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, v)
    out = []
    for q in sorted(i for i in ok if asks(i)):
        scored = []
        for c, v in ok.items():
            if c != q and len(v) == len(ok[q]):
                total = 0.0
                for a, b in zip(ok[q], v, strict=True):
                    total += a * b
                scored.append((-total, c))
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_neighbours_equal_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf_dir, "embeddings").collect()]
    got = sorted(map(tuple, registered.op10_nearest(spark, sf_dir).collect()))
    assert got == brute_neighbours(rows, 20, lambda i: i % 20 == 0)


def test_neighbour_edges(spark, monkeypatch):
    r = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [nan] * 4), (305, [inf, 0.0, 0.0, 0.0])]
    rows += [(400, [1.0, 1.0]), (420, [2.0, 1.0]), (None, [1.0] * 4), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("dim", F.lit("clash"))
    for sizes in ((1024, 4096), (3, 20)):
        monkeypatch.setattr(ann, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(ann, "CANDIDATE_BLOCK", sizes[1])
        got = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, 7).collect()))
        assert got == brute_neighbours(rows, 7, lambda i: i % 20 == 0)
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


@pytest.mark.parametrize("dim", [1536, 4096])
def test_neighbours_at_many_dimensions(dim):
    rng = np.random.default_rng(dim)
    codes = rng.integers(-127, 128, size=(40, dim)).astype(np.int8)
    codes[:8] = 127
    assert (ann.whole_product(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    # all but equal candidates of large codes, told apart by their last components only
    c = np.tile(np.sign(rng.normal(size=dim)) * rng.integers(100, 128, size=dim), (400, 1)).astype(np.float64)
    c[:, 0] = 127
    c[np.arange(400), rng.integers(1, dim, 400)] -= rng.integers(1, 3, 400)
    q = c[:10] + rng.normal(size=(10, dim)) * 1e-3
    got = ann.tile_top(np.arange(1000, 1010), q, np.arange(400), c, 20)
    for i in range(10):
        score = ann.exact(np.repeat(q[i : i + 1], 400, axis=0), c)
        want = sorted(zip((-score).tolist(), range(400), strict=True))[:20]
        assert got[i] == want


# the pipeline and the registry


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    seen = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    gone = seen[0] - seen[1]
    assert gone and sum(labels.get(i, 0) == 1 for i in gone) <= 0.02 * len(seen[0])
    assert seen[1] == seen[2] and len(seen[3]) < len(seen[2])


def test_near_duplicate_stage_keeps_one_of_each_group(spark, edge, texts, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r["doc_id"] for r in pipeline.near_duplicate_stage(spark, docs, "").collect()}
    want = brute_join(texts, 5, 80)
    assert kept == {i for i, (_, component, _) in want.items() if i == component}
    left = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, edge, "").collect()]
    assert sorted(i for i in left if i is not None) == sorted({1, 2, 3, 4, 5, 6, -(2**62)})


def test_near_duplicate_stage_decides_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, bridge, two = near_copies()
    say = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(None, say("a")), (None, say("b")), (None, say("b")), (None, None), (None, None), (None, ""), (3, say("c")), (3, say("d")), (3, say("d"))]
    rows += [(5, say("c")), (3, say("e")), (2, say("e")), (9, one), (None, bridge), (10, two), (11, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = pipeline.near_duplicate_stage(spark, frame, "")
    assert got.columns == pipeline.COLUMNS
    want = [(None, say("a")), (None, say("b")), (None, None), (None, ""), (3, say("c")), (3, say("d")), (2, say("e")), (9, one), (11, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_every_operator_has_a_query():
    names = list(registered.queries())
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in names] == list(range(1, 14))
    assert set(registered.oracle_sql()) <= set(names)
