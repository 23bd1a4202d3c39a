"""Tables that change together: snapshots by manifest, and an index that takes inserts, changes and deletes.

A store is a folder. Data goes to folders of its own that nobody reads yet; then one small manifest, numbered one above the
last, names the folders that make up the new state. A reader takes the newest manifest and stays with what it names, so it
sees all of a commit or nothing: a rebuild that is going on, or one that failed in the middle, changes nothing for it. Two
writers that start from the same state can't both commit. `vacuum` deletes what the newest manifests don't name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.operators.index import CorpusIndex, small
from graticule.operators.lineage import cut
from graticule.operators.scoring import term_counts
from graticule.sources.files import create_text, names, read_text, remove


class Conflict(RuntimeError):
    """Another writer has committed since this one read the state."""


@dataclass(frozen=True)
class Snapshot:
    """One committed state: its number, its folders in order, and facts that the writer gave it."""

    number: int
    folders: tuple[str, ...]
    facts: dict[str, object]


class Store:
    """Snapshots in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The state of a number, or the newest; number 0 is the empty one."""
        number = max(self._numbers(), default=0) if number is None else number
        if number == 0:
            return Snapshot(0, (), {})
        held = json.loads(read_text(self.spark, f"{self.root}/manifests/{number:010d}.json"))
        return Snapshot(number, tuple(held["folders"]), held["facts"])

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write tables to a new folder and give its name. They belong to no state until they are committed."""
        folder = uuid.uuid4().hex
        self.add(folder, tables)
        return folder

    def add(self, folder: str, tables: dict[str, DataFrame]) -> None:
        """Write more tables to a folder that isn't committed yet."""
        for name, frame in tables.items():
            frame.write.parquet(f"{self.root}/data/{folder}/{name}")

    def commit(self, folders: list[str], after: Snapshot, facts: dict[str, object] | None = None) -> Snapshot:
        """Make these folders the state that follows `after`."""
        number = after.number + 1
        text = json.dumps({"folders": list(folders), "facts": facts or {}})
        if max(self._numbers(), default=0) != after.number or not create_text(self.spark, f"{self.root}/manifests/{number:010d}.json", text):
            raise Conflict(f"{self.root}: a state after number {after.number} is there already")
        return Snapshot(number, tuple(folders), facts or {})

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table of a state, all its folders' rows."""
        snapshot = self.snapshot() if snapshot is None else snapshot
        if not snapshot.folders:
            raise FileNotFoundError(f"{self.root} has no state yet")
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/data/{f}/{name}") for f in snapshot.folders])

    def has(self, name: str, snapshot: Snapshot) -> bool:
        return any(name in names(self.spark, f"{self.root}/data/{f}") for f in snapshot.folders)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest `keep`, and data folders that those don't name. Not while a writer is at work."""
        numbers = sorted(self._numbers())
        for number in numbers[:-keep] if keep else numbers:
            remove(self.spark, f"{self.root}/manifests/{number:010d}.json")
        named = {f for n in numbers[-keep:] for f in self.snapshot(n).folders} if keep else set()
        for folder in names(self.spark, f"{self.root}/data"):
            if folder not in named:
                remove(self.spark, f"{self.root}/data/{folder}")


#: Chunk versions that later batches replaced, up to which they are broadcast (two ids a row).
MOST_REPLACED = 1_000_000
#: Folders of changes after which a live index is compacted.
MOST_DELTAS = 20


class LiveIndex:
    """An index under inserts, changes and deletes.

    A change (chunk_id, version, text) holds if its version is above the one held for the chunk; a null text deletes. So
    changes may come late, twice or in any order: the greatest version of each chunk decides, and of equal versions the one
    that came first (in one batch, the greatest text). A batch is a folder of its own: `heads`, one row for each chunk that it
    changes with its version, length, terms and whether it lives; the `postings` and `texts` of those that live; and `terms`,
    what the batch adds to or takes from each term's document frequency, for which the terms of the chunk before are
    known from its head. A posting counts where its batch is that of its chunk's newest head. Compaction writes what is live
    as one folder. A chunk without a token, or with a null id, is in no index; a change
    without a version doesn't hold.
    """

    def __init__(self, spark: SparkSession, root: str, most_deltas: int = MOST_DELTAS):
        self.store, self.most_deltas = Store(spark, root), most_deltas

    def _heads(self, snapshot: Snapshot, only: DataFrame | None = None, fields: tuple[str, ...] = ("version", "batch", "alive", "length", "terms")) -> DataFrame:
        """The newest head of each chunk (of `only`, where given), with these fields."""
        heads = self.store.table("heads", snapshot)
        if only is not None:
            heads = heads.join(small(only), "chunk_id", "left_semi")
        newest = heads.groupBy("chunk_id").agg(F.max_by(F.struct(*fields), "version").alias("h"))
        return newest.select("chunk_id", "h.*")

    def apply(self, changes: DataFrame) -> Snapshot:
        """Commit a batch of changes (chunk_id, version, text). A batch of which nothing holds commits nothing."""
        before = self.store.snapshot()
        newest = changes.where("chunk_id is not null and version is not null").groupBy("chunk_id").agg(F.max(F.struct("version", F.col("text").isNotNull().alias("_has"), "text")).alias("c"))
        newest = newest.select("chunk_id", F.col("c.version").alias("version"), F.col("c.text").alias("text"))
        batch = before.number + 1
        if before.number:
            held = self._heads(before, newest.select("chunk_id")).select("chunk_id", F.col("version").alias("_version"), F.when(F.col("alive"), F.col("terms")).alias("_terms"))
            newest = newest.join(held, "chunk_id", "left").where("_version is null or version > _version")
        else:
            newest = newest.withColumn("_terms", F.lit(None).cast("array<string>"))
        folder = self.store.write({"changed": newest})
        changed = self.store.spark.read.parquet(f"{self.store.root}/data/{folder}/changed")
        if not changed.limit(1).count():
            return before
        counts = term_counts(changed.select("chunk_id", "text")).withColumn("batch", F.lit(batch).cast("long"))
        self.store.add(folder, {"postings": counts})
        posted = self.store.spark.read.parquet(f"{self.store.root}/data/{folder}/postings")
        terms = posted.groupBy("chunk_id").agg(F.max("length").alias("length"), F.collect_list("term").alias("terms"))
        heads = changed.select("chunk_id", "version").join(terms, "chunk_id", "left")
        heads = heads.select("chunk_id", "version", F.lit(batch).cast("long").alias("batch"), F.col("length").isNotNull().alias("alive"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
        gone = changed.select(F.explode("_terms").alias("term"), F.lit(-1).cast("long").alias("df"))
        sums = posted.select("term", F.lit(1).cast("long").alias("df")).union(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self.store.add(folder, {"heads": heads, "terms": sums, "texts": changed.where("text is not null").select("chunk_id", F.lit(batch).cast("long").alias("batch"), "text")})
        done = self.store.commit([*before.folders, folder], before)
        return self.compact() if len(done.folders) > self.most_deltas else done

    def _replaced(self, snapshot: Snapshot) -> DataFrame:
        """(chunk_id, batch) of the heads that aren't their chunk's newest."""
        held = self.store.table("heads", snapshot).groupBy("chunk_id").agg(F.max_by("batch", "version").alias("_newest"), F.collect_set("batch").alias("_batches"))
        return held.select("chunk_id", F.explode(F.filter("_batches", lambda b: b != F.col("_newest"))).alias("batch"))

    def _live(self, name: str, snapshot: Snapshot, replaced: DataFrame | None = None) -> DataFrame:
        """Rows of a table that belong to their chunk's newest head. What was replaced goes to the rows, which stay where they are read."""
        rows = self.store.table(name, snapshot)
        if len(snapshot.folders) == 1:  # compacted, or never changed
            return rows
        return rows.join(small(self._replaced(snapshot) if replaced is None else replaced, MOST_REPLACED), ["chunk_id", "batch"], "left_anti")

    def compact(self) -> Snapshot:
        """Commit the same state as one folder. Heads of deleted chunks stay, so that late changes still count as late.

        Postings are in order of their terms within each file, so a few terms are still read by their place.
        """
        before = self.store.snapshot()
        terms = self.store.table("terms", before).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        replaced = cut(self._replaced(before))
        live = {name: self._live(name, before, replaced) for name in ("heads", "postings", "texts")}
        tables = live | {"postings": live["postings"].sortWithinPartitions("term"), "terms": terms}
        return self.store.commit([self.store.write(tables)], before)

    def read(self, snapshot: Snapshot | None = None) -> CorpusIndex:
        """The index of a state, the newest unless one is given; it stays the same whatever is committed later."""
        snapshot = self.store.snapshot() if snapshot is None else snapshot
        heads = self._heads(snapshot, fields=("alive", "length")).where("alive")
        stats = heads.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"))
        stats = stats.select("n_chunks", "total_tokens", F.round(F.col("total_tokens") / F.nullif("n_chunks", F.lit(0)), 6).alias("avgdl"))
        terms = self.store.table("terms", snapshot).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        texts = self._live("texts", snapshot).join(heads.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text")
        return CorpusIndex(texts, self._live("postings", snapshot).select("chunk_id", "term", "tf", "length"), terms, stats)
