"""N-gram Jaccard self-join of documents by blocked sparse products.

Each document is a row of a sparse incidence matrix, documents by distinct word n-grams. The product of the matrix with
its transpose holds the overlap of every pair, and the pairs whose overlap reaches the bound that follows from the two
sizes are linked. Only blocks of the product that can hold a link are formed:

1. Rows with equal n-gram sets have one content key; the key stands for all of them from here on.
2. In a global order of n-grams, two linked sets share one of the first n - ceil(t n) + 1 n-grams of either (a bound
   that follows from the sizes alone). Any order will do; here rare n-grams come first, so that passages which some
   documents share don't bring them together. Frequencies are counted over all documents for a fixed part of all
   n-grams (the lowest `COUNTED` by hash), which comes before the rest and holds the first n-grams of nearly every set.
3. Documents that share one of those n-grams are joined to groups (connected components of stars, not of pairs).
4. A group is cut into blocks: a small one is one block; one of a few blocks is cut by hash, and all its blocks meet, which
   bounds the work of a row; a large one is cut by size class and by the n-gram that a row shares most, so that families
   stay together, and two blocks of one or of neighbouring size classes are multiplied where one of the first n-grams of
   step 2 is in both (where such an n-gram is in a good part of a group's blocks, all of them are). So a group that grows as
   a chain of families costs in proportion to its rows, and one that is a single family its pairs. A block holds `BLOCK_GRAMS`
   n-grams at most, about, so that long documents make blocks of fewer rows.
   Each pair of blocks is one task, which multiplies the two blocks of the incidence matrix, a chunk of n-grams at a time,
   and drops the pairs below the bound.
5. A task returns a spanning forest of the links it found and the number of links of each row. The components of these
   forests are the result.

Words are hashed to 64 bits, as are n-grams and n-gram sets; texts are read in full in every pass.

Edge cases: a text without words (null, empty, blank) has an empty set, is linked with nothing and is its own component;
a text of fewer words than an n-gram has its whole word sequence as one n-gram; rows without a doc_id are linked by
their text like all others (exactly, nearly, and as a bridge between others), but don't name a component, so theirs is
null where no row of it has a doc_id; rows that repeat a doc_id are rows of their own. A very long text is read whole, in
some 12 bytes of memory a byte. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import bound_batches, cut, map_texts, maybe_broadcast
from graticule.llm.components import components, join_back
from graticule.llm.textkernel import LOWER, Block, blocks, mix64, shingle_hashes

#: Share of all possible n-grams, the lowest by hash, whose frequency is counted and that come first in the order.
COUNTED = 0.4
#: From so many documents of a gathering on, an n-gram is sent to be counted once for all of them.
OFTEN = 16
#: N-grams that a task gathers before it passes them on.
GATHERED = 1_000_000
#: Rows of a block of the product, about, and n-grams that are multiplied at once.
BLOCK_ROWS = 512
#: Rows of a block of a large group, and n-grams of a block of any group, about (a longer document is a block by itself).
FAMILY_ROWS = 1024
BLOCK_GRAMS = 2_000_000
#: Blocks of a group that all meet. In a larger one, an n-gram in more blocks than this, and in more than one in `DENSE` of
#: them, pairs all blocks of the group.
PAIRED, DENSE = 16, 4
CHUNK = 2048

U = np.uint64


@dataclass(frozen=True)
class Rule:
    """N-grams of `width` words; linked where percent / 100 * union <= overlap."""

    width: int = 4
    percent: int = 85

    def least(self, n: np.ndarray) -> np.ndarray:
        """Overlap that any partner of a set of n must reach."""
        return -(-(self.percent * n) // 100)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.least(n) + 1

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Sizes of linked sets are in the same or in neighbouring classes."""
        return np.floor(np.log(np.maximum(n, 1)) / -np.log(self.percent / 100 - 1e-9)).astype(np.int64)


def sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, each text's sorted, and where each text's begin (one entry more)."""
    starts, ends, doc = block.words()
    values, first = shingle_hashes(block.hashes(starts, ends, LOWER), doc, block.n, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < len(values)]] = True
    upto = np.r_[0, np.cumsum(new)]
    return values[new], upto[first]


def content_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set."""
    with np.errstate(over="ignore"):
        total = np.r_[U(0), np.cumsum(mix64(values ^ U(0xA5A5A5A5A5A5A5A5)))]
        return mix64((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(U)).astype(np.int64)


def _describe(width: int):
    def run(block: Block) -> dict[str, object]:
        values, first = sets(block, width)
        return {"n_shingles": np.diff(first), "node": content_keys(values, first)}

    return run


def _order(values: np.ndarray) -> np.ndarray:
    return mix64(values + U(0x632BE59BD9B4E019))


def _lowest(key: np.ndarray, first: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of the `take` lowest keys of each text."""
    parts = []
    for a, b, k in zip(first[:-1], first[1:], take, strict=True):
        if k >= b - a:
            parts.append(np.arange(a, b))
        elif k > 0:
            parts.append(a + np.argpartition(key[a:b], k - 1)[:k])
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _split(order_by: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if not len(order_by):
        return
    at = np.flatnonzero(np.r_[True, order_by[1:] != order_by[:-1]])
    for a, b in zip(at, np.r_[at[1:], len(order_by)], strict=True):
        yield int(order_by[a]), slice(int(a), int(b))


def stars(gram: np.ndarray, size: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (two columns) that join all rows of one n-gram in the same or neighbouring size classes, and the places of
    the rows that stand for an n-gram and class."""
    order = np.lexsort((node, size, gram))
    g, s, v = gram[order], size[order], node[order]
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), order
    head = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]
    at = np.flatnonzero(head)
    of = np.repeat(v[at], np.diff(np.r_[at, len(g)]))
    own = v != of
    next_to = (g[at[1:]] == g[at[:-1]]) & (s[at[1:]] == s[at[:-1]] + 1)
    a, b = np.r_[v[own], v[at[1:]][next_to]], np.r_[of[own], v[at[:-1]][next_to]]
    differ = a != b
    if differ.any():
        edges = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
        a, b = edges[:, 0], edges[:, 1]
    else:
        a = b = np.zeros(0, np.int64)
    return a, b, order[at]


def candidates(docs: DataFrame, rule: Rule, bits: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between content keys, by which all sets that may be linked are connected; and the first n-grams of the
    sets as packed arrays: two sets that may be linked have one in common.

    N-grams travel as numbers in packed arrays: from gatherings of documents to buckets of n-grams, which count them;
    back to the gatherings, which choose each document's first n-grams; and to the buckets again, which join the
    documents that share one. N-grams that only one document holds don't travel back.
    """
    packed = ["flush", "bucket", "grams", "docs", "levels", "many", "table"]
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
    ddl = "flush long, bucket long, grams binary, docs binary, levels binary, many binary, table binary"
    starred = ["bucket", "grams", "sizes", "nodes", "a", "b", "first_grams", "first_nodes"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, ...]] = []  # (n-gram, document) of the counted ones, of the others that are chosen anyway
        docs_of: list[tuple[np.ndarray, ...]] = []  # (content key, size, counted n-grams) of the documents
        n_docs = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, n_docs
            gram, doc, other, other_doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order].astype(np.uint32)
            at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
            count = np.diff(np.r_[at, len(gram)])[: len(at)]
            often = count >= OFTEN
            own = np.repeat(often, count)
            heads, head_counts = gram[at][often], count[often].astype(np.uint32)
            rows = {b: [number, b, gram[~own][x].astype(np.uint32).tobytes(), doc[~own][x].tobytes(), b"", b"", b""] for b, x in _split(gram[~own] >> U(32))}
            for b, x in _split(heads >> U(32)):
                row = rows.setdefault(b, [number, b, b"", b"", b"", b"", b""])
                row[4], row[5] = heads[x].astype(np.uint32).tobytes(), head_counts[x].tobytes()
            table = (*(np.concatenate(x) for x in zip(*docs_of, strict=True)), gram[own], doc[own], other, other_doc)
            home = int(mix64(np.array([number], dtype=U))[0] >> U(64 - bits))
            rows.setdefault(home, [number, home, b"", b"", b"", b"", b""])[6] = pickle.dumps(table)
            held.clear()
            docs_of.clear()
            number, n_docs = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows.values(), strict=True), kinds, strict=True)], packed)

        for batch in batches:
            for _, block in blocks(batch.column(0)):
                values, first = sets(block, rule.width)
                n = np.diff(first)
                brief = values >> U(32 - bits)
                order = _order(brief)
                inside = order < U(int(COUNTED * 2**64))
                doc = np.repeat(np.arange(block.n), n)
                counted = np.bincount(doc[inside], minlength=block.n)
                short = np.where(n > 0, np.maximum(rule.prefix(n) - counted, 0), 0)
                rest = np.where(inside, U(2**64 - 1), order)  # the counted n-grams come first, then these by hash
                chosen = _lowest(rest, first, short)
                held.append((brief[inside], doc[inside] + n_docs, brief[chosen], doc[chosen] + n_docs))
                docs_of.append((content_keys(values, first), n, counted))
                n_docs += block.n
                if sum(len(x[0]) for x in held) >= GATHERED:
                    yield flush()
        if held:
            yield flush()

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint32) for x in frame["grams"]]
        heads = [np.frombuffer(x, np.uint32) for x in frame["levels"]]
        many = [np.frombuffer(x, np.uint32).astype(np.float64) for x in frame["many"]]
        weights = np.concatenate([*(np.ones(len(x)) for x in own), *many])
        distinct, which = np.unique(np.concatenate([*own, *heads]), return_inverse=True)
        level = np.log2(np.bincount(which, weights, len(distinct)))[which].astype(np.uint8) if len(which) else np.zeros(0, np.uint8)
        out = []
        at, head_at = 0, sum(map(len, own))
        for row, gram, head in zip(frame.itertuples(index=False), own, heads, strict=True):
            part, head_level = level[at : at + len(gram)], level[head_at : head_at + len(head)]
            at, head_at = at + len(gram), head_at + len(head)
            shared = part > 0
            doc = np.frombuffer(row.docs, np.uint32)
            if shared.any() or len(head) or row.table:
                # `many` now holds the levels of the n-grams of which the gathering has the documents
                packed_heads = head.tobytes() + head_level.tobytes()
                out.append((row.flush, row.bucket, gram[shared].tobytes(), doc[shared].tobytes(), part[shared].tobytes(), packed_heads, row.table))
        return pd.DataFrame(out, columns=packed)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, n, counted, held_gram, held_doc, other, other_doc = pickle.loads(next(x for x in frame["table"] if x))
        gram, doc, level, head, head_level = [], [], [], [], []
        for row in frame.itertuples(index=False):
            high = U(row.bucket) << U(32)
            gram.append(np.frombuffer(row.grams, np.uint32).astype(U) | high)
            doc.append(np.frombuffer(row.docs, np.uint32).astype(np.int64))
            level.append(np.frombuffer(row.levels, np.uint8))
            k = len(row.many) // 5
            head.append(np.frombuffer(row.many[: 4 * k], np.uint32).astype(U) | high)
            head_level.append(np.frombuffer(row.many[4 * k :], np.uint8))
        head, head_level = np.concatenate(head), np.concatenate(head_level)
        if len(held_gram):
            order = np.argsort(head)
            gram.append(held_gram)
            doc.append(held_doc.astype(np.int64))
            level.append(head_level[order][np.searchsorted(head[order], held_gram)])
        gram, doc, level = np.concatenate(gram), np.concatenate(doc), np.concatenate(level)
        shared = np.bincount(doc, minlength=len(n))
        take = np.clip(rule.prefix(n) - (counted - shared), 0, shared)
        order = np.lexsort((_order(gram), level, doc))
        gram, doc = gram[order], doc[order]
        rank = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(shared)[:-1]], shared)
        chosen = rank < take[doc]
        gram, doc = np.r_[gram[chosen], other], np.r_[doc[chosen], other_doc]
        size, node = rule.size_class(n)[doc], nodes[doc]
        a, b, stand = stars(gram, size, node)
        order = np.lexsort((gram, node))
        once = order[np.r_[True, (np.diff(gram[order]) != 0) | (np.diff(node[order]) != 0)][: len(order)]]  # copies need not be told twice
        own = [gram[once].tobytes(), node[once].tobytes()]
        gram, size, node = gram[stand], size[stand], node[stand]
        rows = {k: [k, gram[x].astype(np.uint32).tobytes(), size[x].astype(np.int32).tobytes(), node[x].tobytes(), *[b""] * 4] for k, x in _split(gram >> U(32))}
        to = mix64(a.astype(U)) >> U(64 - bits)
        order = np.argsort(to, kind="stable")
        for k, x in _split(to[order]):
            rows.setdefault(k, [k, *[b""] * 7])[4:6] = [a[order][x].tobytes(), b[order][x].tobytes()]
        if rows:
            next(iter(rows.values()))[6:] = own
        return pd.DataFrame(list(rows.values()), columns=starred)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        gram, size, node, a, b = (np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("grams", np.uint32), ("sizes", np.int32), ("nodes", np.int64), ("a", np.int64), ("b", np.int64)))
        more_a, more_b, _ = stars(gram, size.astype(np.int64), node)
        return pd.DataFrame({"a": np.r_[a, more_a], "b": np.r_[b, more_b]}).drop_duplicates()

    bound_batches(docs.sparkSession)
    gathered = docs.select("text").mapInArrow(spread, ddl)
    weighed = gathered.groupBy("bucket").applyInPandas(weigh, ddl)
    chosen = cut(weighed.groupBy("flush").applyInPandas(choose, "bucket long, grams binary, sizes binary, nodes binary, a binary, b binary, first_grams binary, first_nodes binary"))
    return chosen.select(*starred[:6]).groupBy("bucket").applyInPandas(join, "a long, b long"), chosen.select(*starred[6:]).where(F.length("first_grams") > 0)


def first_ngrams(packed: DataFrame) -> DataFrame:
    """(gram, node) from the packed arrays of `candidates`."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, nodes in zip(*batch.to_pydict().values(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(grams, np.int64)), pa.array(np.frombuffer(nodes, np.int64))], ["gram", "node"])

    return packed.mapInArrow(unpack, "gram long, node long")


def _blocks(rows: Column, grams: Column) -> Column:
    """Blocks that so many rows and n-grams make."""
    return F.greatest(F.lit(1), F.ceil(rows / FAMILY_ROWS), F.ceil(grams / BLOCK_GRAMS))


def block_pairs(members: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of large groups as (node, block), and the pairs of blocks to multiply as (root, x, y), x <= y.

    members: (node, root, class, size) of the groups of more than `PAIRED` blocks.
    """
    held = cut(first_ngrams(packed).join(members.drop("size"), "node").select("root", "class", "node", "gram").distinct())
    often = held.groupBy("root", "gram").agg(F.countDistinct("node").alias("_shared"))
    hubs = held.join(often, ["root", "gram"]).groupBy("root", "class", "node").agg(F.max(F.struct("_shared", "gram")).alias("_hub"))
    hubs = members.join(hubs.select("node", F.col("_hub.gram").alias("hub")), "node", "left").select("root", "class", "node", "size", F.coalesce("hub", F.lit(0)).alias("hub"))
    families = hubs.groupBy("root", "class", "hub").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_grams"))
    alone = _blocks(F.col("_rows") * 2, F.col("_grams") * 2) > 1
    loose = families.where(~alone).groupBy("root", "class").agg(_blocks(F.sum("_rows"), F.sum("_grams")).alias("_loose"))
    families = families.join(loose, ["root", "class"], "left")
    family = F.when(alone, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.col("_loose")))
    parts = F.when(alone, _blocks(F.col("_rows"), F.col("_grams"))).otherwise(F.lit(1))
    families = families.select("root", "class", "hub", F.xxhash64("class", alone, family).alias("_family"), parts.cast("long").alias("_parts"))
    blocks = cut(hubs.join(families, ["root", "class", "hub"]).select("root", "class", "node", F.xxhash64("_family", F.pmod(F.xxhash64("node"), F.col("_parts"))).alias("block")))

    whole = blocks.select("root", "class", "block").distinct()
    cells = held.join(blocks.select("node", "block"), "node").select("root", "gram", "class", "block").distinct()
    counts = cells.groupBy("root", "gram").agg(F.count(F.lit(1)).alias("_in")).join(whole.groupBy("root").agg(F.count(F.lit(1)).alias("_of")), "root")
    is_dense = (F.col("_in") > PAIRED) & (F.col("_in") * DENSE > F.col("_of"))
    counts = cut(counts.where("_in > 1").select("root", "gram", is_dense.alias("_dense")))
    dense = counts.where("_dense").select("root").distinct()

    def pairs(cells: DataFrame, on: list[str]) -> DataFrame:
        other = cells.select(*on, F.col("class").alias("_class"), F.col("block").alias("_block"))
        near = cells.join(other, on).where((F.abs(F.col("class") - F.col("_class")) <= 1) & (F.col("block") < F.col("_block")))
        return near.select("root", F.col("block").alias("x"), F.col("_block").alias("y"))

    sparse = cells.join(counts.where("not _dense").select("root", "gram"), ["root", "gram"]).join(dense, "root", "left_anti")
    found = pairs(sparse, ["root", "gram"]).union(pairs(whole.join(dense, "root", "left_semi"), ["root"])).union(whole.select("root", F.col("block").alias("x"), F.col("block").alias("y")))
    return blocks.select("node", "block"), cut(found.distinct())


def overlap(one: list[np.ndarray], two: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: the product of two blocks of the incidence matrix (or of one
    with itself), added up over chunks of the n-grams that more than one row holds."""
    own = two is None
    two = one if own else two
    grams_a, grams_b = np.concatenate(one), np.concatenate(two)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two))
    if own:
        distinct, many = np.unique(grams_a, return_counts=True)
        common = distinct[many > 1]
    else:
        common = np.intersect1d(np.unique(grams_a), np.unique(grams_b), assume_unique=True)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    if len(common):
        sides = []
        for grams, row in ((grams_a, row_a), (grams_b, row_b)):
            column = np.minimum(np.searchsorted(common, grams), len(common) - 1)
            real = common[column] == grams
            column, row = column[real], row[real]
            order = np.argsort(column, kind="stable")
            sides.append((column[order], row[order]))
        for at in range(0, len(common), CHUNK):
            dense = []
            for (column, row), n in zip(sides, (len(one), len(two)), strict=True):
                part = slice(*np.searchsorted(column, (at, at + CHUNK)))
                tile = np.zeros((n, min(CHUNK, len(common) - at)), dtype=np.float32)
                tile[row[part], column[part] - at] = 1
                dense.append(tile)
            out += dense[0] @ dense[1].T
    if own:
        np.fill_diagonal(out, [len(s) for s in one])
    return out.astype(np.int64)


def forest(rows: np.ndarray, columns: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph of n nodes."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _multiply(rule: Rule):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []  # (node, other node, 0) for an edge, (node, 0, links) for a count
        for _, part in frame.drop_duplicates(["root", "x", "y", "node"]).groupby(["root", "x", "y"], sort=False):
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            held = [np.frombuffer(g, U) for g in part["grams"]]
            size = np.array([len(h) for h in held])
            x = part["x"].iloc[0]
            side = part["block"].to_numpy() == x
            first = np.flatnonzero(side)
            second = first if x == part["y"].iloc[0] else np.flatnonzero(~side)
            if not len(first) or not len(second):  # a block that no row was dealt to
                continue
            same = second is first
            both = overlap([held[i] for i in first], None if same else [held[i] for i in second])
            union = size[first][:, None] + size[second][None, :] - both
            linked = (both > 0) & (100 * both >= rule.percent * union)
            if same:
                np.fill_diagonal(linked, False)
            for at, links in ((first, linked @ copies[second]), *(() if same else ((second, linked.T @ copies[first]),))):
                out += [(int(nodes[i]), 0, int(k)) for i, k in zip(at, links, strict=True) if k]
            i, j = np.nonzero(np.triu(linked) if same else linked)
            out += [(int(nodes[a]), int(nodes[b]), 0) for a, b in forest(first[i], second[j], len(nodes))]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return run


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (linked other documents, copies counted) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described, labels = link(docs, rule)
    out = described.withColumn("_key", F.when(F.col("n_shingles") > 0, F.col("node"))).join(labels, F.col("_key") == F.col("_node"), "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def link(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The rows as doc_id, body (a hash of the text), n_shingles and node (the content key); and the content keys as
    _node, root (the component's least content key), component (its least doc_id) and n_links.

    docs: (doc_id long, text).
    """
    docs = docs.withColumn("body", F.xxhash64("text"))
    described = cut(map_texts(docs, _describe(rule.width), [("n_shingles", "long"), ("node", "long")], ["doc_id", "body"]))
    rows = described.where("n_shingles > 0").groupBy("node", "doc_id", "body").agg(F.count(F.lit(1)).alias("same"), F.first("n_shingles").alias("size"))
    # the row whose text stands for its content key: `same` rows are equal to it
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "body", "same")).alias("pick")
    classes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.sum("same").alias("copies"), F.min("size").alias("size"), pick))
    n = classes.count()
    bits = min(28, max(6, int(n // 4096).bit_length()))

    edges, packed = candidates(docs, rule, bits)
    groups = cut(components(edges))

    members = groups.join(classes, "node")
    near = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(-np.log(rule.percent / 100 - 1e-9)))).cast("int")
    members = members.select("node", "root", "pick", "copies", "size", near.alias("class"))
    whole = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_grams")).select("root", "_n", F.col("_n").alias("_all"), "_grams")
    members = cut(join_back(members, whole, "root", groups.count()))
    small = (F.col("_all") <= BLOCK_ROWS) & (F.col("_grams") <= BLOCK_GRAMS)
    n_blocks = F.when(small, F.lit(1)).otherwise(_blocks(F.col("_all"), F.col("_grams"))).cast("long")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("long")
    meets = F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    placed = members.where(n_blocks <= PAIRED).select("node", "root", "pick", "copies", own.alias("block"), meets.alias("tasks"))
    several = members.where((n_blocks > 1) & (n_blocks <= PAIRED)).groupBy("root").agg(F.first(n_blocks).alias("_b"))
    n_pairs = several.agg(F.sum(F.expr("_b * (_b + 1) div 2"))).first()[0] or 0
    large = members.where(n_blocks > PAIRED)
    if large.limit(1).count():
        block_of, pairs = block_pairs(large.select("node", "root", "class", "size"), packed)
        n_pairs += pairs.count()
        ends = pairs.select("root", F.col("x").alias("block"), "x", "y").union(pairs.where("x <> y").select("root", F.col("y").alias("block"), "x", "y"))
        ends = ends.groupBy("root", "block").agg(F.collect_list(F.struct("x", "y")).alias("tasks"))  # as many as a block has others to meet
        placed = placed.unionByName(large.join(block_of, "node").join(ends, ["root", "block"]).select("node", "root", "pick", "copies", "block", "tasks"))
    placed = cut(placed)
    n_members = placed.count()

    wanted = placed.select("node", F.col("pick.doc_id").alias("_id"), F.col("pick.body").alias("_body"), F.col("pick.same").alias("_same"))
    meet = docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["body"] == F.col("_body"))
    texts = docs.join(maybe_broadcast(wanted.where("_same = 1"), n_members), meet).select("node", "text")
    if wanted.where("_same > 1").limit(1).count():  # one text of equal rows; a task passes on one of each
        equal = docs.join(maybe_broadcast(wanted.where("_same > 1"), n_members), meet)
        texts = texts.union(equal.groupBy("node").agg(F.first("text").alias("text")))

    def hold(block: Block) -> dict[str, object]:
        values, first = sets(block, rule.width)
        keys = content_keys(values, first)
        return {"key": keys, "grams": [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]}

    held = map_texts(texts, hold, [("key", "long"), ("grams", "binary")], ["node"]).where("key = node")
    spread = max(1, n_members // 256 + n_pairs)  # about one pair of blocks, or some small groups, to a task's turn
    shares = maybe_broadcast(placed.select("node", "root", "copies", "block", "tasks"), n_members)
    tasked = held.select("node", "grams").join(shares, "node").select("node", "grams", "root", "copies", "block", F.explode("tasks").alias("t"))
    tasked = tasked.select(F.pmod(F.xxhash64("root", "t.x", "t.y"), F.lit(spread)).alias("task"), "root", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "node", "copies", "block", "grams")
    found = cut(tasked.groupBy("task").applyInPandas(_multiply(rule), "a long, b long, links long"))

    joined = components(found.where("links = 0").select("a", "b"))
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    rooted = cut(joined.join(classes.select("node", "first"), "node"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("_n"))
    named = join_back(rooted, lowest, "root", rooted.count()).select("node", "root", "component")
    labels = classes.join(named, "node", "left").join(links, "node", "left")
    labels = cut(labels.select(F.col("node").alias("_node"), F.coalesce("root", "node").alias("root"), F.coalesce("component", "first").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    return described, labels
