"""Connected components of an edge table, by alternating star operations.

A large-star step links every larger neighbour of a node to the least node of its neighbourhood; a small-star step does
the same for the smaller neighbours. Alternating both ends with one star per component, centred on its least node, after
a number of rounds that grows with the logarithm of the longest path. Every step is a grouped minimum and a join on the
node; each round's edges are written to the shared checkpoint folder. The centre of a large star is a node of very many
rows: such nodes, a few hundred at most, meet their minimum by broadcast, so that no task gets all rows of one.

Edge cases: edges of a node to itself, repeated edges and an empty table are fine; nodes without an edge are not returned;
null nodes are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import cut

#: Rows that any task may get. In a larger table, a key of more than one in `SHARE` of the rows is met by broadcast (there are
#: less than `SHARE` of them).
HOT, SHARE = 1 << 20, 500


def join_back(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` (`total` of them) with the facts of their key. `facts` has one row for each key, and in `_n` the key's rows."""
    plain = facts.drop("_n")
    if total <= HOT:
        return rows.join(plain, key)
    hot = cut(facts.where(F.col("_n") > max(1, total // SHARE)).drop("_n"))
    if not hot.limit(1).count():
        return rows.join(plain, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(plain, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge: `edges` has the long columns a and b, root is the least node reachable."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = join_back(both, least, "u", 2 * mark[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = join_back(large, lowest, "a", mark[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and hash of an edge table, which stay the same only when the edges do."""
    folded = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(folded)).first())
