"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graticule.llm.textkernel import Block, blocks

#: Bytes of an Arrow batch, about (a longer text is a batch by itself).
BATCH_BYTES = 4 << 20
#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared checkpoint folder, as the session names it; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graticule-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written tables: where checkpoints go."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so that a lost executor loses no part of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to `BATCH_BYTES` in this session, so that a batch of long texts stays small; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; runs in the JVM without building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """A broadcast hint where the measured row count is within the limit, else the frame as it is."""
    return F.broadcast(df) if rows <= limit else df


def repeated(df: DataFrame, many: str, index: str, run: int) -> DataFrame:
    """Each row as often as its column `many` says, numbered from 0 in `index`; more than `run` copies go to several tasks."""
    columns = [c for c in df.columns if c != many]
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = df.where(F.col(many) <= run).withColumn(index, up_to(F.col(many)))
    parts = df.where(F.col(many) > run).withColumn("_part", up_to(F.ceil(F.col(many) / run)))
    parts = parts.repartition(F.xxhash64("_part", *[c for c in columns if not c.startswith("_")]))
    rows = parts.withColumn("_j", up_to(F.least(F.lit(run).cast("long"), F.col(many) - F.col("_part") * run))).withColumn(index, F.col("_part") * run + F.col("_j"))
    return few.select(*columns, index).unionByName(rows.select(*columns, index))


def map_texts(df: DataFrame, fn: Callable[[Block], dict[str, object]], fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Columns `keep` of every row with columns that `fn` computes from the column `text`, block by block.

    `fn` gets a Block of whole texts and returns for each (name, DDL type) of `fields` an array of its length; a null in
    a kept column stays. One pass over the rows in Arrow batches, without a shuffle.
    """
    bound_batches(df.sparkSession)
    columns = keep if "text" in keep else [*keep, "text"]
    kept = df.select(*columns)
    schema = T.StructType([*[kept.schema[c] for c in keep], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    types = {n: to_arrow_type(T._parse_datatype_string(t)) for n, t in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(columns.index("text"))):
                made = fn(block)
                part = batch.slice(at, block.n)
                arrays = [part.column(columns.index(c)) for c in keep]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, types[n]) for n, _ in fields for x in [made[n]]]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *types])

    return kept.mapInArrow(run, schema)
