"""Nearest neighbours by a block matrix join.

The candidates stay where they are, a block of them at a time; the queries are sent to their tasks in blocks, in waves of a
bounded size. A tile is a query block against a candidate block. Its vectors are
quantised to int8, one scale per vector, and the integer product of the tile gives every inner product up to an error
bound that follows from the norms of the quantisation residuals. Candidates whose upper bound falls below the k-th best
lower bound (or the k-th best exact score found so far) are dropped; the survivors are recomputed in double precision on
the original vectors and kept in a heap per query, which goes on from tile to tile. The tasks' heaps are merged per query. The search is exact: bounds
decide only what need not be recomputed.

Among equal vectors only the k+1 rows of smallest id can be in any answer (one more than k, as a query leaves itself
out), so the rest is set aside first; this keeps copies of one vector from filling the tiles.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components take no part, neither as
queries nor as candidates; nor do rows without an id. Vectors meet only vectors of the same dimension. Equal scores are
ordered by the smaller id. Rows that repeat an id and a vector count once; rows with one id and different vectors are
candidates of their own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import bound_batches, cut

#: Vectors in a query block and in a candidate block, about; both bound the memory of a tile.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Components of all queries that are sent to the tasks at once.
WAVE = 4_000_000
#: Tasks whose answers are merged at once.
MERGE_FAN = 64
#: Components that are multiplied at once: 127 * 127 * 1024 is below 2**24, so that a float32 product is the whole number.
SLICE = 1024


def usable(vec: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    return F.coalesce(
        vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the vectors, of their quantised forms and of the residuals."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return codes, scale, norm(x), norm(near), norm(x - near)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in component order, so equal vectors give equal scores."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def whole_product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of all pairs of int8 rows, exactly, in double precision: float32 products of slices are added up."""
    out = np.zeros((len(one), len(two)))
    for a in range(0, one.shape[1], SLICE):
        out += one[:, a : a + SLICE].astype(np.float32) @ two[:, a : a + SLICE].astype(np.float32).T
    return out


def tile_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, width: int = 1024, heaps: list[list[tuple[float, int]]] | None = None) -> list[list[tuple[float, int]]]:
    """For each query the k best (-score, id) of one tile and of the `heaps` so far, best first."""
    heaps = [[] for _ in qid] if heaps is None else heaps
    q8, qs, qn, qq, qe = quantise(q)
    floor = np.array([-h[-1][0] if len(h) == k else -np.inf for h in heaps])  # exact score that a candidate must reach
    for at in range(0, len(cid), width):
        ids, part = cid[at : at + width], c[at : at + width]
        c8, cs, cn, cq, ce = quantise(part)
        near = whole_product(q8, c8) * qs[:, None] * cs[None, :]
        slack = (qe[:, None] * cn[None, :] + qq[:, None] * ce[None, :]) * (1 + 1e-9) + (1e-12 + 1e-15 * q.shape[1]) * (1 + qn[:, None] * cn[None, :])
        low = near - slack
        low[qid[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            fence = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        else:
            fence = floor
        rows, cols = np.nonzero((near + slack >= fence[:, None]) & (qid[:, None] != ids[None, :]))
        if not len(rows):
            continue
        score = np.concatenate([exact(q[rows[i : i + 65536]], part[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)])
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(rows)], strict=True):
            r = rows[a]
            fresh = [(-s, i) for s, i in zip(score[a : min(b, a + k)].tolist(), ids[cols[a : min(b, a + k)]].tolist(), strict=True)]
            heaps[r] = heapq.nsmallest(k, heaps[r] + fresh)
            if len(heaps[r]) == k:
                floor[r] = -heaps[r][-1][0]
    return heaps


TOP_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))
TOP_DDL = "array<struct<score:double,id:long>>"


def _as_rows(keys: list, tops: list[list[tuple[float, int]]], parts: list[int], name: str = "query_id") -> pa.RecordBatch:
    items = [[{"score": -s, "id": i} for s, i in top] for top in tops]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(items, TOP_TYPE)], [name, "part", "top"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k nearest other rows by largest inner product."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))
    queries = rows.where("is_query").select("id", "vec", "dim").distinct()
    schema = f"query_id long, part int, top {TOP_DDL}"
    alike = Window.partitionBy("dim", "mark", "vec").orderBy("id")
    candidates = rows.select("id", "vec", "dim", F.xxhash64("vec").alias("mark")).distinct().withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1)

    bound_batches(vectors.sparkSession)
    held = cut(candidates.select("dim", "id", "vec"))
    total = queries.agg(F.sum("dim")).first()[0] or 0
    waves = max(1, -(-total // wave))

    def against(asked: list) -> DataFrame:
        by_dim: dict[int, list] = {}
        for row in asked:
            by_dim.setdefault(row["dim"], []).append(row)
        blocks = {d: [(np.array([r["id"] for r in x[i : i + QUERY_BLOCK]]), np.array([r["vec"] for r in x[i : i + QUERY_BLOCK]])) for i in range(0, len(x), QUERY_BLOCK)] for d, x in by_dim.items()}

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps: dict[tuple[int, int], list[list[tuple[float, int]]]] = {}
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in blocks:
                        continue
                    mine = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
                    c = mine.column(2).flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, dim)
                    for at in range(0, len(c), CANDIDATE_BLOCK):
                        cid = mine.column(1).slice(at, CANDIDATE_BLOCK).to_numpy()
                        for n, (qid, q) in enumerate(blocks[dim]):
                            heaps[dim, n] = tile_top(qid, q, cid, c[at : at + CANDIDATE_BLOCK], k, heaps=heaps.get((dim, n)))
            part = TaskContext.get().partitionId() // MERGE_FAN
            for (dim, n), tops_of in heaps.items():
                qid = blocks[dim][n][0]
                yield _as_rows(qid.tolist(), tops_of, [part] * len(qid))

        return held.mapInArrow(tops, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for tops_of in batch.column(2).to_pylist():
                best = heapq.merge(*[[(-x["score"], x["id"]) for x in top] for top in tops_of])
                out: list[tuple[float, int]] = []
                for item in best:
                    if not out or out[-1] != item:
                        out.append(item)
                    if len(out) == k:
                        break
                merged.append(out)
            yield _as_rows(batch.column(0).to_pylist(), merged, [0] * batch.num_rows)

    gather = lambda df: df.groupBy("query_id", "part").agg(F.collect_list("top").alias("tops")).select("query_id", "part", "tops").mapInArrow(merge, schema)
    if waves == 1:
        found = against(queries.collect())  # bounded by the size of a wave
    else:
        place = F.pmod(F.xxhash64("id"), F.lit(waves))
        found = reduce(DataFrame.unionByName, [cut(against(queries.where(place == w).collect())) for w in range(waves)])
    found = gather(gather(found))  # the tasks' answers, some at once, then all of a query
    ranked = found.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


ORACLE = """
with ok as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from ok q join ok c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""
