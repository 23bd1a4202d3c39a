"""Server-sent events as the sink of a stream: a data source of the format `sse`.

    spark.dataSource.register(EventSink)
    events.writeStream.format("sse").option("checkpointLocation", ...).start(path)

A row has `id` (the order within its micro-batch), `event` and `data`; a micro-batch is one file of its events. A task writes its
events, in order, to a draft of its own; the commit of a micro-batch names the drafts that belong to it, and readers go by
commits alone. So a task that is tried twice, a micro-batch that fails, or one that is run again leave no event twice and none
out. Paths may be in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COMMITS, DRAFTS = "commits", "drafts"


@dataclass
class Draft(WriterCommitMessage):
    """A task's file, and how many events it holds."""

    name: str
    events: int


def event_text(event: str | None, data: str | None) -> str:
    """One event; every line of the data is a line of the event."""
    lines = "null" if data is None else data.replace("\r\n", "\n").replace("\r", "\n")
    return f"event: {event or 'message'}\n" + "".join(f"data: {line}\n" for line in lines.split("\n")) + "\n"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    found, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return found, place.rstrip("/")


def _write(fs: pafs.FileSystem, path: str, text: str) -> None:
    with fs.open_output_stream(path) as out:
        out.write(text.encode())


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path
        fs, place = _folder(path)
        for part in (COMMITS, DRAFTS):
            fs.create_dir(f"{place}/{part}", recursive=True)

    def write(self, iterator: Iterator) -> Draft:
        rows = sorted(((r["id"], i, event_text(r["event"], r["data"])) for i, r in enumerate(iterator)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        name = f"{uuid.uuid4().hex}.jsonl"
        if rows:
            fs, place = _folder(self.path)
            _write(fs, f"{place}/{DRAFTS}/{name}", "".join(json.dumps([i, text]) + "\n" for i, _, text in rows))
        return Draft(name, len(rows))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        fs, place = _folder(self.path)
        named = f"{place}/{COMMITS}/{batchId:012d}.json"
        _write(fs, f"{named}.draft", json.dumps([m.name for m in messages if m and m.events]))
        fs.move(f"{named}.draft", named)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        fs, place = _folder(self.path)
        for m in messages:
            if m and m.events:
                fs.delete_file(f"{place}/{DRAFTS}/{m.name}")


class EventSink(DataSource):
    """The format `sse`: a sink for streams of (id long, event string, data string)."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "id long, event string, data string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:  # noqa: N802
        missing = {"id", "event", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"an event needs the columns {sorted(missing)}")
        return EventWriter(self.options["path"])


def read_events(path: str, after: int = -1) -> Iterator[tuple[int, str]]:
    """(micro-batch, text) of each committed event in order, after a micro-batch: what is sent to a client that goes on from there."""
    fs, place = _folder(path)
    found = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{place}/{COMMITS}")) if f.base_name.endswith(".json"))
    for name in found:
        batch = int(name.removesuffix(".json"))
        if batch <= after:
            continue
        with fs.open_input_stream(f"{place}/{COMMITS}/{name}") as f:
            drafts = json.loads(f.read())
        streams = [fs.open_input_stream(f"{place}/{DRAFTS}/{d}") for d in drafts]
        parts = [[json.loads(line) for line in s.read().decode().splitlines()] for s in streams]
        for _, text in heapq.merge(*parts, key=lambda e: (e[0] is not None, e[0] or 0)):
            yield batch, text
