"""Snapshots by manifest, and a live index against a rebuild after any changes."""

import random

import pytest
from pyspark.sql import functions as F

from graticule.operators import retrieval
from graticule.operators.index import CorpusIndex
from graticule.operators.store import Conflict, LiveIndex, Store
from graticule.streaming import jobs

CHANGE = "chunk_id string, version long, text string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, page_id string, text string")


def facts(index):
    return (
        sorted(map(tuple, index.postings.select("chunk_id", "term", "tf", "length").collect())),
        sorted(map(tuple, index.terms.select("term", "df").collect())),
        [tuple(r) for r in index.stats.collect()],
    )


def rebuilt(spark, held):
    rows = spark.createDataFrame([(c, t) for c, (_, t) in held.items() if t is not None], "chunk_id string, text string")
    return CorpusIndex.build(rows)


def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    live, held = LiveIndex(spark, str(tmp_path / "live"), most_deltas=3), {}
    words = ["alpha", "beta", "gamma", "delta", "?!", ""]
    for step in range(6):
        batch = []
        for _ in range(12):
            chunk = f"c{rng.randrange(10)}"
            text = None if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
            batch.append((chunk, rng.randrange(1, 40), text))
        batch += [batch[0], (None, 50, "nobody"), ("c1", None, "no version")]
        newest = {}
        for c, v, t in batch:
            if c is not None and v is not None:
                newest[c] = max(newest.get(c, (0, False, "")), (v, t is not None, t or ""))
        for c, (v, has, t) in newest.items():
            if v > held.get(c, (0, None))[0]:
                held[c] = (v, t if has else None)
        live.apply(spark.createDataFrame(batch, CHANGE))
        if step == 3:
            live.compact()
    got, want = live.read(), rebuilt(spark, held)
    assert facts(got) == facts(want)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma"), (3, "none")], "qid long, text string")
    assert sorted(map(tuple, retrieval.bm25(asked, got, 4).collect())) == sorted(map(tuple, retrieval.bm25(asked, want, 4).collect()))
    assert len(live.store.snapshot().folders) <= 4
    before = live.store.snapshot()
    assert live.apply(spark.createDataFrame([("c1", 0, "too late")], CHANGE)) == before


def test_everything_deleted(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path / "live"))
    live.apply(spark.createDataFrame([("a", 1, "x y"), ("b", 1, "y")], CHANGE))
    live.apply(spark.createDataFrame([("a", 2, None), ("b", 2, None)], CHANGE))
    live.compact()
    index = live.read()
    assert facts(index)[:2] == ([], []) and index.stats.first()["n_chunks"] == 0 and not index.ready()


def test_readers_keep_their_state(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path / "live"))
    first = live.apply(spark.createDataFrame([("a", 1, "old words")], CHANGE))
    reader = live.read()
    live.apply(spark.createDataFrame([("a", 2, "new words"), ("b", 1, "more")], CHANGE))
    live.compact()
    assert [r["term"] for r in reader.terms.orderBy("term").collect()] == ["old", "words"]
    assert facts(live.read(first)) == facts(reader)
    live.store.vacuum(keep=1)
    assert sorted(r["term"] for r in live.read().terms.collect()) == ["more", "new", "words"]
    assert len(list((tmp_path / "live" / "data").iterdir())) == 1


def test_a_rebuild_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A search during a rebuild, and after one that failed in the middle, sees the old index."""
    path = str(tmp_path / "index")
    old = chunks(spark, [(1, "d", "p", "alpha beta"), (2, "d", "q", "alpha")])
    new = chunks(spark, [(3, "d", "p", "alpha gamma"), (4, "d", "q", "gamma")])
    asked = spark.createDataFrame([(1, "alpha")], "qid long, text string")
    search = lambda: sorted(r["chunk_id"] for r in retrieval.bm25(asked, CorpusIndex.load(spark, path), 9).collect())
    CorpusIndex.build(old).save(path)
    assert search() == [1, 2]
    seen = []
    real = Store.write

    def slow(self, tables):
        for i, name in enumerate(list(tables)):
            seen.append(search())
            if fail_at == i:
                raise OSError("the disk is full")
            folder = real(self, {name: tables[name]}) if i == 0 else folder
            if i:
                tables[name].write.parquet(f"{self.root}/data/{folder}/{name}")
        return folder

    monkeypatch.setattr(Store, "write", slow)
    for fail_at in (1, 3):
        with pytest.raises(OSError, match="full"):
            CorpusIndex.build(new).save(path)
        assert search() == [1, 2]
    fail_at = None
    CorpusIndex.build(new).save(path)
    assert all(s == [1, 2] for s in seen) and len(seen) == 2 + 4 + 4
    assert search() == [3]
    Store(spark, path).vacuum(1)
    assert search() == [3]


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = spark.range(2)
    start = one.snapshot()
    one.commit([one.write({"t": rows})], start, {"by": "one"})
    with pytest.raises(Conflict):
        two.commit([two.write({"t": rows.limit(1)})], start)
    held = two.snapshot()
    assert held.facts == {"by": "one"} and two.table("t", held).count() == 2
    two.commit([*held.folders, two.write({"t": rows.limit(1)})], held)
    assert one.table("t").count() == 3
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none")).table("t")


def test_a_stream_of_changes(spark, tmp_path):
    """Files that come later replace and delete; a stream that starts again goes on where it was."""
    files = [[("a", 1, "x x y"), ("b", 1, "y z")], [("a", 2, "y"), ("c", 1, "new")], [("b", 5, None), ("a", 1, "late")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        jobs.ingest_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    posted, terms = jobs.read_ingested(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, posted.select("chunk_id", "term", "tf", "length").collect())) == [("a", "y", 1, 1), ("c", "new", 1, 1)]
    assert sorted(map(tuple, terms.collect())) == [("new", 1), ("y", 1)]


def test_a_micro_batch_that_runs_again(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "x y")], "chunk_id string, text string").withColumn("version", F.lit(0).cast("long"))
    assert live.apply(rows).number == 1
    assert live.apply(rows).number == 1
    assert [r["df"] for r in live.read().terms.collect()] == [1, 1]


def test_live_rows_stay_where_they_are_read(spark, tmp_path):
    """what was replaced is sent to postings, texts and heads; none of them is exchanged to be compacted."""
    live = LiveIndex(spark, str(tmp_path / "live"))
    live.apply(spark.createDataFrame([(f"c{i}", 1, f"alpha w{i}") for i in range(20)], CHANGE))
    live.apply(spark.createDataFrame([("c1", 2, "beta"), ("c2", 2, None), ("c3", 2, "?!")], CHANGE))
    before = live.store.snapshot()
    for name in ("heads", "postings", "texts"):
        rows = live._live(name, before, live._replaced(before).localCheckpoint())
        plan = rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert "BroadcastHashJoin" in plan and "Exchange" not in plan
    want = facts(live.read())
    live.compact()
    assert facts(live.read()) == want == facts(rebuilt(spark, {f"c{i}": (1, "beta" if i == 1 else None if i in (2, 3) else f"alpha w{i}") for i in range(20)}))
    assert live.apply(spark.createDataFrame([("c2", 1, "late")], CHANGE)) == live.store.snapshot()
    assert live.read().chunks.count() == 18
