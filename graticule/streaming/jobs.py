"""Job logs, session activity and incremental ingestion, as batch operators and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators.store import LiveIndex

# What a line says about a job, in the order in which it is tried; None leaves the phase as it is.
PHASES = [
    ("contains", "Ingesting doc:", "converting_html_to_md"),
    ("contains", "Indexing from datastore", "indexing_existing_md"),
    ("bare", "Done:", None),
    ("bare", "Done.", None),
    ("starts", "Indexing ", "indexing_bm25"),
    ("starts", "Computing embeddings ", "computing_embeddings"),
    ("starts", "ERROR:", "failed"),
]


def phase_of(line: Column) -> Column:
    """Phase that a line announces, null if none."""
    bare = F.ltrim(line)
    out = F
    for kind, mark, phase in PHASES:
        test = F.contains(line, F.lit(mark)) if kind == "contains" else (bare if kind == "bare" else line).startswith(mark)
        out = out.when(test, F.lit(phase))
    return out


def job_progress(log: DataFrame, job: str, order: str, line: str) -> DataFrame:
    """Each line with the job's phase and number of finished docs so far."""
    upto = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.col(line).startswith("  ") & F.ltrim(F.col(line)).startswith("Done:")
    return log.select(
        job,
        order,
        F.coalesce(F.last(phase_of(F.col(line)), ignorenulls=True).over(upto), F.lit("queued")).alias("phase"),
        F.sum(done.cast("long")).over(upto).alias("doc_done"),
    )


def log_tail(log: DataFrame, job: str, order: str, most: int = 220) -> DataFrame:
    """The last lines of each job."""
    back = Window.partitionBy(job).orderBy(F.col(order).desc())
    return log.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most).drop("_n")


def last_seen(activity: DataFrame, user: str, at: str) -> DataFrame:
    """Latest activity of each user."""
    return activity.groupBy(user).agg(F.max(at).alias("last_seen_at"))


def expired(seen: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Users whose latest activity is older than the time to live."""
    return seen.where(F.col("last_seen_at") < now - F.expr(f"interval {days} days"))


def activity_windows(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; on a stream, windows close when the watermark has passed them."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    counted = timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def ingest_stream(chunks: DataFrame, index_path: str, checkpoint: str):
    """A stream of chunk files (chunk_id, text, and version where there is one) into a live index, one commit a micro-batch.

    A chunk that comes again replaces what it was, and one with a null text is deleted. Without a version, the number of the
    micro-batch is one. A micro-batch that is run again changes nothing, as its versions are held already.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        rows = batch if "version" in batch.columns else batch.withColumn("version", F.lit(epoch).cast("long"))
        LiveIndex(batch.sparkSession, index_path).apply(rows)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark, index_path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and document frequencies of an index that a stream has filled."""
    index = LiveIndex(spark, index_path).read()
    return index.postings, index.terms
