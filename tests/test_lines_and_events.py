"""Catalogue lines with their numbers, and the sink of server-sent events."""

import json
import random

import pytest

from graticule.sources import guides
from graticule.streaming import events


def test_numbers_over_blocks_and_files(spark, tmp_path):
    """Files that are read in many blocks of some hundred bytes, by any number of tasks."""
    rng = random.Random(1)
    want = set()
    for f in range(3):
        lines = [f"{f}-{i}-" + "x" * rng.randrange(0, 60) for i in range(1, 400)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n" * (f % 2))
        want |= {(f, i, text) for i, text in enumerate(lines, 1)}
    (tmp_path / "empty.txt").write_text("")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("500", "7k", held["spark.sql.files.maxPartitionBytes"]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = [(int(r["file"][-5]), r["line"], r["text"]) for r in guides.numbered_lines(spark, str(tmp_path)).collect()]
        assert len(got) == len(want) and set(got) == want
    for k, v in held.items():
        spark.conf.set(k, v)


def test_the_bad_line_is_named(spark, tmp_path):
    good = [json.dumps({"doc_id": f"d{i}", "page_id": "p", "images": [], "heading_path": ["a"]}) for i in range(30)]
    path = tmp_path / "pages.jsonl"
    path.write_text("﻿" + "\n".join([*good[:10], "", "  \t", *good[10:]]) + "\n")
    got = guides.read_catalog(spark, str(path), numbers=True).collect()
    assert [(r["doc_id"], r["line"]) for r in got][:11] == [*((f"d{i}", i + 1) for i in range(10)), ("d10", 13)] and len(got) == 30
    for broken in ("{broken", '{"doc_id": "d"', "[1, 2]x", "text"):
        path.write_text("\n".join([*good[:16], broken, *good[16:]]))
        with pytest.raises(Exception, match=r"pages.jsonl, line 17 isn't a page record"):
            guides.read_catalog(spark, str(path)).collect()
        assert guides.read_catalog(spark, str(path), strict=False).count() == 30


def stream(spark, folder):
    rows = spark.readStream.schema("id long, event string, data string").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    spark.dataSource.register(events.EventSink)
    return rows.repartition(3).writeStream.format("sse").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")


def test_events_in_order_and_once(spark, tmp_path):
    batches = [[(i, "log", f"line {i}\nand more") for i in range(20)], [(5, "done", None), (None, None, "first"), (7, "log", "a\r\nb")]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, event string, data string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream(spark, str(tmp_path)).awaitTermination()
    stream(spark, str(tmp_path)).awaitTermination()  # nothing new
    got = list(events.read_events(str(tmp_path / "out")))
    assert [t for _, t in got[:20]] == [f"event: log\ndata: line {i}\ndata: and more\n\n" for i in range(20)]
    assert [t for _, t in got[20:]] == ["event: message\ndata: first\n\n", "event: done\ndata: null\n\n", "event: log\ndata: a\ndata: b\n\n"]
    assert [t for _, t in events.read_events(str(tmp_path / "out"), after=got[0][0])] == [t for _, t in got[20:]]


def test_drafts_that_no_commit_names_are_not_read(tmp_path):
    writer = events.EventWriter(str(tmp_path))
    row = lambda i: {"id": i, "event": "e", "data": str(i)}
    lost = writer.write(iter([row(9)]))  # a task whose answer was lost, and tried again
    one, two, none = writer.write(iter([row(3), row(1)])), writer.write(iter([row(2)])), writer.write(iter([]))
    writer.commit([one, two, none, None], 0)
    failed = writer.write(iter([row(7)]))
    writer.abort([failed, None], 1)
    assert [t for _, t in events.read_events(str(tmp_path))] == [f"event: e\ndata: {i}\n\n" for i in (1, 2, 3)]
    writer.commit([one], 0)  # the micro-batch is run again
    assert [t for _, t in events.read_events(str(tmp_path))] == [f"event: e\ndata: {i}\n\n" for i in (1, 3)]
    assert sorted(p.name for p in (tmp_path / "drafts").iterdir()) == sorted([lost.name, one.name, two.name])
    with pytest.raises(ValueError):
        events.EventSink({"path": str(tmp_path)}).streamWriter(__import__("pyspark").sql.types.StructType(), False)
