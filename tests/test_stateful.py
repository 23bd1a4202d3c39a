"""Streams with state: the same result as the whole log at once, in any split into micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graticule.streaming import jobs, stateful

LOG = "job string, n long, line string"
SAID = ["Ingesting doc: a", "  Done: a", "Indexing 5 chunks", "plain", "Computing embeddings 7", "  ERROR: bad", "Done: all", "x" * 40]


def a_log(seed, jobs_=3, lines=90):
    rng = random.Random(seed)
    return [(f"j{j}", n, rng.choice(SAID)) for j in range(jobs_) for n in range(lines)]


def run(spark, folder, files, tail=stateful.TAIL, recent=stateful.RECENT, restart=()):
    """The last states after reading these files one after the other, with the stream stopped and started again in between."""
    done = []
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(f"{folder}/in")
        if i in restart or i == len(files) - 1:
            source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
            stateful.into_table(stateful.job_stream(source, "job", "n", "line", tail, recent), f"{folder}/out", f"{folder}/state", "job").awaitTermination()
            done.append(i)
    return sorted(tuple(r) for r in stateful.latest(spark, f"{folder}/out", "job").select("job", "phase", "doc_done", "last_line", "tail").collect())


@pytest.mark.parametrize("split", ["whole", "in order", "any order"])
def test_states_equal_the_whole_log(spark, tmp_path, split):
    rows = a_log(4)
    want = sorted(tuple(r) for r in stateful.job_states(spark.createDataFrame(rows, LOG), "job", "n", "line", 50).collect())
    rng = random.Random(5)
    parts = {"whole": [rows], "in order": [sorted(rows, key=lambda r: r[1])[i : i + 80] for i in range(0, 270, 80)]}
    shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, 40)  # late lines, and lines that come twice
    parts["any order"] = [shuffled[i : i + 110] for i in range(0, len(shuffled), 110)]
    assert run(spark, str(tmp_path), parts[split], tail=50, restart=(1,)) == want
    by_line = jobs.job_progress(spark.createDataFrame(rows, LOG), "job", "n", "line")
    assert {(r["job"], r["phase"], r["doc_done"]) for r in by_line.where("n = 89").collect()} == {w[:3] for w in want}
    tails = {j: [line for job, _, line in sorted(rows, key=lambda r: r[1]) if job == j][-50:] for j in ("j0", "j1", "j2")}
    assert {w[0]: w[4] for w in want} == tails


def test_lines_that_are_too_late(spark, tmp_path):
    """Numbers below the ones remembered change nothing; so do lines without a job or number."""
    first = [("a", n, "plain") for n in range(10, 40)]
    late = [("a", 5, "ERROR: late"), ("a", 30, "  Done: twice"), (None, 50, "ERROR: x"), ("a", None, "ERROR: y"), ("b", 1, None)]
    got = run(spark, str(tmp_path), [first, late], tail=4, recent=20)
    assert got == [("a", "queued", 0, 39, ["plain"] * 4), ("b", "queued", 0, 1, [""])]


def test_sessions_expire_by_timer(spark, tmp_path):
    day = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    files = [
        [("u", day(0)), ("v", day(0)), ("u", day(3))],
        [("u", day(2)), ("v", day(20)), (None, day(20)), ("u", None)],
        [("w", day(34))],  # past the end of u's session, which was last seen on day 3
        [("u", day(40)), ("w", day(41))],
        [("x", day(90))],
        [("x", day(91))],
    ]
    for rows in files:
        spark.createDataFrame(rows, "user string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("user string, at timestamp").parquet(str(tmp_path / "in"))
        stateful.into_table(stateful.session_stream(source, "user", "at"), str(tmp_path / "out"), str(tmp_path / "state"), "user").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("user", F.date_diff("last_seen_at", F.lit("2024-01-01")).alias("day"), "state").distinct().collect()
    expired = sorted((r["user"], r["day"]) for r in got if r["state"] == "expired")
    assert expired == [("u", 3), ("u", 40), ("v", 20), ("w", 41)]
    active = sorted((r["user"], r["day"]) for r in got if r["state"] == "active")
    assert active == [("u", 3), ("u", 40), ("v", 0), ("v", 20), ("w", 34), ("w", 41), ("x", 90), ("x", 91)]
    assert sorted(r["user"] for r in stateful.latest(spark, str(tmp_path / "out"), "user").where("state = 'active'").collect()) == ["x"]
