"""Tables that are changed in place, by buckets of their key.

A row lies in the bucket that a hash of its key names. A change reads and writes only the buckets that hold a changed key, to a
folder of their own; a manifest (see `store`) then names the folder of each bucket anew, so that readers see the whole
change or none of it, and files of other buckets stay as they are. What a change does to the rows is what the operators of
`catalog` do to a whole table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators import catalog
from graticule.operators.store import Snapshot, Store

_BUCKET = "_bucket"


class KeyedTable:
    """A table with a key in a folder. Rows with a null in the key have a bucket too; equal keys may occur more than once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @staticmethod
    def create(rows: DataFrame, root: str, by: list[str], buckets: int) -> KeyedTable:
        """Write a whole table; what is there is replaced."""
        table = KeyedTable(rows.sparkSession, root)
        before = table.store.snapshot()
        folder = table._write(rows, by, buckets)
        facts = {"by": by, "buckets": buckets, "folders": {str(b): folder for b in range(buckets)}, "schema": rows.schema.json()}
        table.store.commit([folder], before, facts)
        return table

    @staticmethod
    def _place(by: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, by: list[str], buckets: int) -> str:
        folder = uuid.uuid4().hex
        placed = rows.withColumn(_BUCKET, self._place(by, buckets)).repartition(_BUCKET)
        placed.write.partitionBy(_BUCKET).parquet(f"{self.store.root}/data/{folder}/rows")
        return folder

    def _rows(self, held: Snapshot, of: set[int]) -> DataFrame:
        """The rows of some buckets; only their files are read."""
        schema = T.StructType.fromJson(json.loads(held.facts["schema"]))
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in held.facts["folders"].items():
            if int(bucket) in of:
                by_folder.setdefault(folder, []).append(int(bucket))
        stored = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        parts = [self.spark.read.schema(stored).parquet(f"{self.store.root}/data/{f}/rows").where(F.col(_BUCKET).isin(b)) for f, b in sorted(by_folder.items())]
        empty = self.spark.createDataFrame([], stored)
        return reduce(DataFrame.unionByName, parts, empty).drop(_BUCKET)

    def read(self, held: Snapshot | None = None) -> DataFrame:
        held = self.store.snapshot() if held is None else held
        return self._rows(held, set(range(held.facts["buckets"])))

    def change(self, keys: DataFrame, to: Callable[[DataFrame], DataFrame]) -> Snapshot:
        """Put `to(rows)` in the place of the rows of every bucket that one of the keys is in. `to` must leave other keys' rows as
        they are, and may add rows of these keys only."""
        held = self.store.snapshot()
        by, buckets = held.facts["by"], held.facts["buckets"]
        touched = {r[0] for r in keys.select(self._place(by, buckets)).distinct().collect()}  # as many as there are buckets at most
        if not touched:
            return held
        rows = self._rows(held, touched)
        folder = self._write(to(rows).select(*rows.columns), by, buckets)
        folders = held.facts["folders"] | {str(b): folder for b in touched}
        return self.store.commit(sorted(set(folders.values())), held, held.facts | {"folders": folders})

    def upsert(self, new: DataFrame, updated: str = "updated_at", created: str = "created_at") -> Snapshot:
        """`catalog.upsert` in place."""
        by = self.store.snapshot().facts["by"]
        return self.change(new, lambda rows: catalog.upsert(rows, new, by, updated, created))

    def update(self, changes: DataFrame, columns: list[str]) -> Snapshot:
        """`catalog.partial_update` in place."""
        by = self.store.snapshot().facts["by"]
        return self.change(changes, lambda rows: catalog.partial_update(rows, changes, by, columns))

    def delete(self, keys: DataFrame) -> Snapshot:
        """`catalog.delete_by` in place."""
        by = self.store.snapshot().facts["by"]
        return self.change(keys, lambda rows: catalog.delete_by(rows, keys, by))

    def compact(self) -> Snapshot:
        """All buckets in one folder again."""
        held = self.store.snapshot()
        folder = self._write(self.read(held), held.facts["by"], held.facts["buckets"])
        return self.store.commit([folder], held, held.facts | {"folders": dict.fromkeys(held.facts["folders"], folder)})


def cascade(parents: KeyedTable, children: KeyedTable, gone: DataFrame, key: str) -> None:
    """Delete keys and the rows of another table that name them; the children first, so that none is ever without its parent.

    The children's table is dealt by `key` too.
    """
    if children.store.snapshot().facts["by"] != [key] or parents.store.snapshot().facts["by"] != [key]:
        raise ValueError(f"both tables have to be dealt by {key}")
    children.delete(gone)
    parents.delete(gone)
