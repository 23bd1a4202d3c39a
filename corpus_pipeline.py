"""A training-data pipeline: quality filter, language filter, near-duplicate removal, source mixing and packing.

STAGES holds (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of `documents`.

1. quality: gradient-boosted trees over document statistics, fitted on `labels`; documents that score below the
   classifier's threshold of 0.3 go.
2. language: n-gram filters learned from the documents; documents without a letter, and documents of which the predicted
   language holds less than half of the n-grams, go.
3. near_duplicates: the n-gram Jaccard join on five-word shingles at a similarity of 0.8; of each group of linked
   documents the one with the smallest doc_id stays (rows without a doc_id come last, then the hash of the text decides).
4. mixing: weighted fair queueing; a document is returned as often as the mix takes it (0 to 2 times).
5. packing: best-two-fit of the tokenised documents into sequences of at most 2048 tokens.

Edge cases, alike for every stage: an empty table gives an empty one; columns beside those of `documents` are left out,
whatever their names; rows are told apart by all their columns, so repeated rows and rows that share a doc_id or have none are
rows of their own; texts of any length are read whole. What a stage does with a null, empty or blank text, and with ties:

1. quality scores it like others, from statistics that are all zero; equal texts score alike.
2. language rejects it, as it has no letter; null languages are not learned from.
3. near_duplicates keeps it, as it is linked with nothing, but one of rows that are equal in doc_id and text; of a group's rows
   with the least doc_id, that of the least hash of the text stays.
4. mixing never takes it, as its size is 0; documents of equal finish times are taken together or not at all.
5. packing makes it one piece, the separator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import langid, mixing, ngram_join, packing, quality
from graticule.llm.common import cut, maybe_broadcast, shared_folder, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a document's n-grams that its predicted language must hold.
LANGUAGE_SHARE = 0.5
NEAR = ngram_join.Rule(width=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SHARE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows, the least by doc_id (nulls last) and hash of the text, and one of each run
    of rows without words that are equal in doc_id and text."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    described, labels = ngram_join.link(docs.select("doc_id", "text"), NEAR)
    roots = labels.select("_node", F.col("root").alias("_root"))
    # two numbers that name a row's group: the component, or what a row without words is itself
    named = described.withColumn("_key", F.when(F.col("n_shingles") > 0, F.col("node"))).join(roots, F.col("_key") == F.col("_node"), "left")
    itself = F.xxhash64("doc_id", "body", F.lit("no words"))
    group = [F.when(F.col("_key").isNull(), F.lit(1)).otherwise(0).alias("kind"), F.when(F.col("_key").isNull(), itself).otherwise(F.col("_root")).alias("group")]
    runs = named.groupBy("doc_id", "body", *group).agg(F.count(F.lit(1)).alias("same"))
    least = runs.groupBy("kind", "group").agg(F.sum("same").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "body", "same")).alias("pick"))
    least = cut(least.where("size > 1"))
    members = cut(runs.select("doc_id", "body", "kind", "group").join(maybe_broadcast(least, least.count(), 200_000), ["kind", "group"]).select("doc_id", "body", "kind", "group", "pick"))
    chosen = F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("body") == F.col("pick.body"))
    runs = members.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), (chosen & (F.col("pick.same") == 1)).alias("_keep"), (chosen & (F.col("pick.same") > 1)).alias("_one"))
    runs = cut(runs.where("not _keep"))
    n = runs.count()
    rows = docs.select(*COLUMNS).withColumn("body", F.xxhash64("text"))
    meet = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["body"] == F.col("_body"))
    kept = rows.join(maybe_broadcast(runs, n, 200_000), meet, "left_anti").select(*COLUMNS)
    repeated = runs.where("_one")
    if repeated.limit(1).count():  # the run of equal rows is the one to stay: one row of it
        equal = rows.join(maybe_broadcast(repeated, n, 200_000), meet, "left_semi")
        first = equal.groupBy("doc_id", "body").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("row"))
        kept = kept.union(first.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]]))
    return kept


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(packing.VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
