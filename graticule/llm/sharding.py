"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. It is laid out by capacity, which stays, and used by weight, which may change (a
shard that isn't in service has weight 0). A region draws from the key a series of times, exponential variates over the
region's capacity. At each of its times the key descends: the racks of the region make weighted hash draws by their
capacity and the least wins, then so do the shards of that rack; the shard is taken if a last draw falls within the share of its
capacity that its weight fills, else the region's next time follows. The region whose key is taken at the earliest time
holds the key. So a shard gets a share in proportion to its weight, one path is looked at for each time, and a draw depends on
nothing but key, node and the number of the time: a change of a shard's weight moves keys only to or from that shard, a
change within a rack only to or from that rack. A region that is added takes keys only into itself.

The work of a key grows with the number of regions and the fan-out, and with capacity over weight in a region.

Edge cases: a null key is a key like any other (all null keys share one shard); repeated rows and equal keys go to the
same shard and get slots of their own, equal rows next to each other; ties of times go to the region first in order, those
of draws to the node first in order; null and empty texts have size 8, a very long text is only measured and hashed; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import repeated
from graticule.llm.textkernel import mix64

#: Buckets that split a shard while slots are numbered: each is numbered by itself, then moved by the buckets before it.
SLOT_BUCKETS = 1024
#: Equal rows that are written from one row at once; more of them are dealt to several tasks.
RUN = 1 << 16

U = np.uint64


@dataclass(frozen=True)
class Leaf:
    """A shard's place in the tree, its weight, and its capacity (the least power of two that holds the weight, if not given)."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    capacity: float | None = None

    @property
    def room(self) -> float:
        return self.capacity if self.capacity is not None else 2.0 ** np.ceil(np.log2(max(self.weight, 1.0)))


def default_tree(n_shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Regions of two racks of four shards each, laid out in full; the first n shards are in service."""
    region = per_rack * racks
    return [Leaf(s, s // region, s // per_rack % racks, float(s < n_shards), 1.0) for s in range(-(-n_shards // region) * region)]


def salt(name: str) -> int:
    """A node's number in hashes."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def uniform(key: np.ndarray, node: str, nth: int) -> np.ndarray:
    """A number between 0 and 1 for each key, of a node and the number of the time."""
    with np.errstate(over="ignore"):
        bits = mix64(mix64(key ^ U(salt(node))) + U(nth) * U(0x9E3779B97F4A7C15)) >> U(11)
    return (bits.astype(np.float64) + 0.5) / 2.0**53


def least_draw(key: np.ndarray, nodes: list[tuple[str, float]], nth: int) -> np.ndarray:
    """Which of the nodes (name, capacity) makes the least exponential draw over its capacity."""
    if len(nodes) == 1:
        return np.zeros(len(key), dtype=np.int64)
    return np.argmin([-np.log(uniform(key, name, nth)) / room for name, room in nodes], axis=0)


class Tree:
    """Leaves by region and rack, ready to descend."""

    def __init__(self, leaves: list[Leaf]):
        if not any(leaf.weight > 0 for leaf in leaves):
            raise ValueError("a tree needs a shard of positive weight")
        if any(not 0 <= leaf.weight <= leaf.room for leaf in leaves):
            raise ValueError("a weight is negative or above its capacity")
        regions: dict[int, dict[int, list[Leaf]]] = {}
        for leaf in sorted(leaves, key=lambda x: (x.region, x.rack, x.shard)):
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
        self.regions = {r: racks for r, racks in regions.items() if any(leaf.weight > 0 for rack in racks.values() for leaf in rack)}

    def descend(self, key: np.ndarray) -> np.ndarray:
        """Shard of each key."""
        taken_at = np.full(len(key), np.inf)
        shard = np.full(len(key), -1, dtype=np.int32)
        for region, racks in self.regions.items():
            name = f"region-{region}"
            rooms = [(f"{name}-rack-{rack}", sum(leaf.room for leaf in leaves)) for rack, leaves in racks.items()]
            whole = sum(room for _, room in rooms)
            rows, time, nth = np.arange(len(key)), np.zeros(len(key)), 0
            while len(rows):
                time = time - np.log(uniform(key[rows], name, nth)) / whole
                early = time < taken_at[rows]  # a region that has taken the key before stands
                rows, time = rows[early], time[early]
                which = least_draw(key[rows], rooms, nth)
                taken = np.zeros(len(rows), dtype=bool)
                for i, leaves in enumerate(racks.values()):
                    here = np.flatnonzero(which == i)
                    own = key[rows[here]]
                    place = least_draw(own, [(f"shard-{leaf.shard}", leaf.room) for leaf in leaves], nth)
                    filled = np.array([leaf.weight / leaf.room for leaf in leaves])[place]
                    good = uniform(own, f"{rooms[i][0]}-taken", nth) < filled
                    shard[rows[here[good]]] = np.array([leaf.shard for leaf in leaves], dtype=np.int32)[place[good]]
                    taken[here[good]] = True
                taken_at[rows[taken]] = time[taken]
                rows, time, nth = rows[~taken], time[~taken], nth + 1
        return shard


def assign(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key."""
    tree = Tree(leaves)

    @F.pandas_udf("int")
    def descend(digest: pd.Series) -> pd.Series:
        return pd.Series(tree.descend(digest.to_numpy().astype(U)))

    return descend(F.xxhash64(key))  # of null too, so that no key is lost to floats


def with_slots(rows: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Gapless slots from 0 in each shard.

    Equal rows are counted first and numbered as one run, so they may be any share of all rows. A shard's runs are numbered
    in hash buckets, so no task holds a whole shard.
    """
    columns = rows.columns
    runs = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_many")).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = runs.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_many").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    numbered = runs.withColumn("_upto", F.sum("_many").over(inside))
    joined = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    placed = joined.select(*columns, "_many", (F.col("_start") + F.col("_upto") - F.col("_many")).alias("_first"))
    both = repeated(placed, "_many", "_i", RUN)
    return both.select(*columns, (F.col("_first") + F.col("_i")).alias(slot))


def shard_documents(docs: DataFrame, n_shards: int = 24, tree: list[Leaf] | None = None, grown: list[Leaf] | None = None) -> DataFrame:
    """Shard of every document by its doc_id, with its size, the text's CRC-32, its slot and its shard in the grown tree."""
    tree = tree or default_tree(n_shards)
    grown = grown or default_tree(n_shards + 1)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        assign(F.col("doc_id"), tree).alias("shard"),
        assign(F.col("doc_id"), grown).alias("grown_shard"),
    )
    out = with_slots(rows, "shard")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
