"""Job logs and sessions as streams with state for each key.

A job's state is its phase with the line that announced it, the number of finished docs, the last lines, and the numbers of the
lines seen lately. Lines may come in any order and more than once: of a job's phases that of the greatest line number counts,
a number that was seen counts once, and a number below the `RECENT` greatest ones that were seen is too late and changes
nothing. So the state after a log is the same in whatever micro-batches it came, and equals `job_states` of the whole log.

A session's state is its last touch. A timer at the end of its time to live reports it as expired, and its state goes; a touch
after that begins a new session. Timers follow the stream's watermark.

A key's lines of one micro-batch are folded in one task, so `maxFilesPerTrigger` (or another limit of the source) bounds what
a busy key brings at once; of a key's state, only the last lines and the recent numbers take space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graticule.streaming.jobs import phase_of

# Fixed value: lines of a log's tail.
TAIL = 220
#: Line numbers that are remembered for each job.
RECENT = 1000

_JOB = T.StructType().add("job", T.StringType()).add("phase", T.StringType()).add("doc_done", T.LongType()).add("last_line", T.LongType()).add("tail", T.ArrayType(T.StringType()))
_SESSION = T.StructType().add("user", T.StringType()).add("last_seen_at", T.TimestampType()).add("state", T.StringType())


def _with_state_store(df: DataFrame) -> DataFrame:
    """Keyed state of this kind needs the store that keeps it on disk."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def _lines(log: DataFrame, job: str, n: str, line: str) -> DataFrame:
    """(job, n, line, phase, done): what each line says. Lines without a job or a number are left out."""
    text = F.col(line)
    done = F.coalesce(text.startswith("  ") & F.ltrim(text).startswith("Done:"), F.lit(False))
    rows = log.select(F.col(job).cast("string").alias("job"), F.col(n).cast("long").alias("n"), F.coalesce(text, F.lit("")).alias("line"), phase_of(text).alias("phase"), done.alias("done"))
    return rows.where("job is not null and n is not null")


class JobLog(StatefulProcessor):
    """Folds a job's new lines into its state and returns the state, once a micro-batch."""

    def __init__(self, tail: int = TAIL, recent: int = RECENT):
        self.most, self.recent = tail, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "phase string, phase_at long, done long, seen array<long>, tail_n array<long>, tail array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = self.state.get() if self.state.exists() else ("queued", None, 0, [], [], [])
        phase, phase_at, done, seen, tail_n, tail = held
        seen, tail = set(seen or ()), dict(zip(tail_n or (), tail or (), strict=True))
        floor = min(seen) if len(seen) >= self.recent else None
        for frame in rows:
            for n, line, said, finished in frame.sort_values(["n", "line"])[["n", "line", "phase", "done"]].itertuples(index=False):
                n = int(n)
                if n in seen or floor is not None and n < floor:
                    continue
                seen.add(n)
                tail[n] = line
                done += bool(finished)
                if isinstance(said, str) and (phase_at is None or n > phase_at):
                    phase, phase_at = said, n
            if len(tail) > self.most:
                tail = dict(sorted(tail.items())[-self.most :])
        kept = sorted(seen)[-self.recent :]
        numbers = sorted(tail)
        self.state.update((phase, phase_at, int(done), kept, numbers, [tail[n] for n in numbers]))
        yield pd.DataFrame({"job": [key[0]], "phase": [phase], "doc_done": [int(done)], "last_line": [kept[-1] if kept else None], "tail": [[tail[n] for n in numbers]]})


def job_stream(log: DataFrame, job: str, n: str, line: str, tail: int = TAIL, recent: int = RECENT) -> DataFrame:
    """A stream of job states (job, phase, doc_done, last_line, tail), one for each job that a micro-batch has lines of."""
    keyed = _lines(_with_state_store(log), job, n, line).groupBy("job")
    return keyed.transformWithStateInPandas(JobLog(tail, recent), _JOB, "Update", "None")


def job_states(log: DataFrame, job: str, n: str, line: str, tail: int = TAIL) -> DataFrame:
    """The same of a whole log at once: the last state of each job. Of lines with equal numbers the least text counts."""
    rows = _lines(log, job, n, line).groupBy("job", "n").agg(F.min(F.struct("line", "phase", "done")).alias("r")).select("job", "n", "r.*")
    facts = rows.groupBy("job").agg(F.max_by("phase", F.when(F.col("phase").isNotNull(), F.col("n"))).alias("phase"), F.count_if("done").alias("doc_done"), F.max("n").alias("last_line"))
    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy("job").orderBy(F.col("n").desc()))).where(F.col("_k") <= tail)
    tails = last.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("tail"))
    return facts.join(tails, "job").select("job", F.coalesce("phase", F.lit("queued")).alias("phase"), "doc_done", "last_line", "tail")


class Session(StatefulProcessor):
    """Keeps a user's last touch; a timer reports the end of the session."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "last_ms long")

    def _row(self, key, ms: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"user": [key[0]], "last_seen_at": [pd.Timestamp(ms, unit="ms")], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = int(self.state.get()[0]) if self.state.exists() else None
        newest = max(int(frame["ms"].max()) for frame in rows)
        if held is not None and newest <= held:
            return
        if held is not None:
            self.handle.deleteTimer(held + self.ttl_ms)
        self.state.update((newest,))
        self.handle.registerTimer(newest + self.ttl_ms)
        yield self._row(key, newest, "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = int(self.state.get()[0])
        self.state.clear()
        yield self._row(key, last, "expired")


def session_stream(touches: DataFrame, user: str, at: str, ttl: str = "30 days", late: str = "1 hour") -> DataFrame:
    """A stream of (user, last_seen_at, state): `active` for a later touch, `expired` once the watermark passes the time to live.

    Times count in milliseconds. Touches older than the watermark (the latest touch less `late`) are dropped; touches without a
    user or a time are left out.
    """
    rows = _with_state_store(touches).select(F.col(user).cast("string").alias("user"), F.col(at).cast("timestamp").alias("at")).where("user is not null and at is not null")
    rows = rows.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return rows.groupBy("user").transformWithStateInPandas(Session(ttl_ms), _SESSION, "Update", "EventTime")


def into_table(stream: DataFrame, path: str, checkpoint: str, key: str, of_batch: Callable[[DataFrame], DataFrame] | None = None):
    """Write a stream of states, a folder for each micro-batch (one that runs again overwrites its own); `latest` reads the last of each key."""

    def add(batch: DataFrame, epoch: int) -> None:
        (of_batch(batch) if of_batch else batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, key: str) -> DataFrame:
    """The last state of each key that a stream has written."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "epoch").alias("_s")).select(key, "_s.*")
