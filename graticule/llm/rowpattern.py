"""Row pattern matching: a regular expression over the consecutive rows of each key.

Rows are ordered by key, time and id. A row's letters are A (any row with a value), D and U (value below, above that of the
row before), and P (a goal row of a value at least that of the match's A); D, U and P also need the row to follow the one
before closely enough. Every row is tried as a start, so matches may overlap.

Distinct rows are range-partitioned by key, time and id, so that one key may take up many partitions. A task goes through
its range in order and cuts it into segments, runs of rows of which all but the first can be D, U or P: no match goes
beyond a segment. A segment's rows become symbols in a bytearray; the starts are processed by ascending value, and goal
symbols of lower values are switched off on the way, so that at every start a P symbol means a goal row of at least its
value. The pattern, spelled in symbol classes, is matched anchored at each start. The first and the last segment of a range
may go on in another one: they leave the task as fragments, at most two a range, are chained by a window over their key's
ranges, and matched chain by chain. Matches are numbered in the task; the count of a key's matches in earlier ranges (a row
or two for each range) is added.

Edge cases: rows without a key or a time are dropped; a null id comes first among equal times and stays null in the result;
rows that are equal in all columns count once; rows of equal key, time and id follow each other by cents (nulls first),
then by what their kind allows. A null value, one that is not finite, and one of more than 9e15 cents fit no letter. A null
kind is neither D, U nor P, but may be A. An empty table gives an empty result, and extra columns only tell rows apart. A
segment is worked on whole; a match of n rows costs n bytes of labels, so a segment of n falling and rising rows costs the
square of n by its definition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import cut

#: Greater values (in cents) count as none.
MOST_CENTS = 9e15
# Symbols: no value; none of D, U, P; D and U alone and as goal rows; goal rows alone. Switched off, a goal symbol turns
# into the symbol that it is without the goal.
NO_VALUE, NONE, FALL, RISE, GOAL, GOAL_FALL, GOAL_RISE = b"xadupDU"
_OFF = np.arange(256, dtype=np.uint8)
_OFF[[GOAL, GOAL_FALL, GOAL_RISE]] = [NONE, FALL, RISE]
_LABEL = np.full(256, ord("A"), dtype=np.uint8)
_LABEL[[FALL, GOAL_FALL]], _LABEL[[RISE, GOAL_RISE]], _LABEL[GOAL] = ord("D"), ord("U"), ord("P")
_CLASSES = {"D": "[dD]", "U": "[uU]", "P": "(?P<P>[pDU])", "A": "[^x]"}


@dataclass(frozen=True)
class Pattern:
    """A pattern of letters A, D, U, P with the operators of a regular expression; A stands first and only there.

    A possessive quantifier (`D++`) gives nothing back, which changes no match where the next letter can't be the same row.
    """

    letters: str
    gap_us: int
    #: Kinds that are neither D nor U.
    barred: tuple[str, ...]
    #: Kinds that are goal rows.
    goals: tuple[str, ...]

    def compiled(self) -> object:
        import regex

        plain = self.letters.replace(" ", "")
        if not re.fullmatch(r"A[DUP()+*?|{},0-9]*", plain):
            raise ValueError(f"not a pattern of A, then D, U and P: {self.letters}")
        return regex.compile("".join(_CLASSES.get(c, c) for c in plain).replace("(", "(?:").replace("(?:?P", "(?P").encode())


#: `A (D+ U+)+ P?`: no row is both D and U, so what D+ and U+ have taken never has to be given back.
ZIGZAG = Pattern("A (D++ U++)+ P?", 30 * 60 * 1_000_000, ("error",), ("click",))

_FIELDS = [
    ("kind", pa.int8()), ("client_id", pa.int64()), ("bucket", pa.int32()), ("pos", pa.int64()), ("part", pa.int8()), ("no", pa.int64()),
    ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("cents", pa.list_(pa.int64())), ("symbols", pa.binary()),
    ("first_ts", pa.int64()), ("last_ts", pa.int64()), ("steps", pa.bool_()), ("goal", pa.bool_()), ("fits", pa.bool_()),
]
_DDL = (
    "kind tinyint, client_id long, bucket int, pos long, part tinyint, no long, first_id long, last_id long, n_rows long, sum_cents long, "
    "labels binary, ids array<long>, cents array<long>, symbols binary, first_ts long, last_ts long, steps boolean, goal boolean, fits boolean"
)
#: Kinds of rows that a task returns: a match, a fragment, the number of a key's matches in a range.
MATCH, FRAGMENT, COUNT = 0, 1, 2
#: Parts of a range in order: what belongs to the segment that begins it, what lies within, what belongs to its last segment.
HEAD, MIDDLE, TAIL = 0, 1, 2


def _batch(n: int, **given: object) -> pa.RecordBatch:
    arrays = [a if isinstance(a := given.get(name), pa.Array) else pa.nulls(n, t) if a is None else pa.array(a, t) for name, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _FIELDS])


@dataclass
class Rows:
    """Rows in order, with their symbols; `cents` is 0 where there is no value."""

    client: np.ndarray
    ts: np.ndarray
    ids: pa.Array
    cents: np.ndarray
    steps: np.ndarray
    goal: np.ndarray
    symbols: np.ndarray

    def __getitem__(self, at: slice) -> Rows:
        return Rows(*[getattr(self, f)[at] for f in self.__dataclass_fields__])

    def __len__(self) -> int:
        return len(self.cents)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        return Rows(*[(pa.concat_arrays if f == "ids" else np.concatenate)([getattr(p, f) for p in parts]) for f in Rows.__dataclass_fields__])


def with_symbols(batch: pa.RecordBatch, before: Rows | None, gap_us: int) -> tuple[Rows, np.ndarray]:
    """The batch's rows with their symbols, and which of them begin a segment. `before`: the row before the batch."""
    client, ts = batch.column(0).to_numpy(), batch.column(1).cast(pa.int64()).to_numpy()
    has = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    cents = batch.column(3).fill_null(0).to_numpy()
    steps, goal = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
    n = len(client)
    close, fall, rise = (np.zeros(n, dtype=bool) for _ in range(3))
    if before is not None:
        had = before.symbols[0] != NO_VALUE
        close[:1] = (client[:1] == before.client[0]) & (ts[:1] - before.ts[0] <= gap_us)
        fall[:1], rise[:1] = had & (cents[:1] < before.cents[0]), had & (cents[:1] > before.cents[0])
    close[1:] = (client[1:] == client[:-1]) & (ts[1:] - ts[:-1] <= gap_us)
    fall[1:], rise[1:] = has[:-1] & (cents[1:] < cents[:-1]), has[:-1] & (cents[1:] > cents[:-1])
    close &= has
    fall, rise, aim = fall & close & steps, rise & close & steps, goal & close
    symbols = np.select([~has, fall & aim, rise & aim, fall, rise, aim], [NO_VALUE, GOAL_FALL, GOAL_RISE, FALL, RISE, GOAL], NONE).astype(np.uint8)
    return Rows(client, ts, batch.column(2), cents, steps, goal, symbols), ~(fall | rise | aim)


def matches(symbols: np.ndarray, cents: np.ndarray, pattern: object) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Start, end and labels of the match at each start that has one, by ascending start."""
    live = bytearray(symbols.tobytes())
    labels = _LABEL[symbols].tobytes()
    off = _OFF[symbols]
    starts = np.flatnonzero(symbols != NO_VALUE)
    starts = starts[np.argsort(cents[starts], kind="stable")]
    goals = np.flatnonzero(off != symbols)
    goals = goals[np.argsort(cents[goals], kind="stable")]
    too_low = np.searchsorted(cents[goals], cents[starts])
    places, without = goals.tolist(), off[goals].tolist()
    found, switched, match = [], 0, pattern.match
    for start, upto in zip(starts.tolist(), too_low.tolist(), strict=True):
        while switched < upto:
            live[places[switched]] = without[switched]
            switched += 1
        m = match(live, start)
        if m:
            said = bytearray(labels[start : m.end()])
            said[0] = 65
            for at, _ in m.spans("P") if "P" in m.re.groupindex else ():
                said[at - start] = 80
            found.append((start, m.end(), bytes(said)))
    found.sort()
    begin, end, said = zip(*found, strict=True) if found else ((), (), ())
    return np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64), list(said)


def found_in(rows: Rows, pattern: object) -> tuple[np.ndarray, dict[str, object]]:
    """Starts of the matches in some whole segments, and the columns of the matches."""
    begin, end, labels = matches(rows.symbols, rows.cents, pattern)
    upto = np.r_[0, np.cumsum(rows.cents)]
    return begin, {
        "first_id": rows.ids.take(pa.array(begin)), "last_id": rows.ids.take(pa.array(end - 1)), "n_rows": end - begin, "sum_cents": upto[end] - upto[begin], "labels": pa.array(labels, pa.binary()),
    }


def scan(batches: Iterator[pa.RecordBatch], pattern: Pattern) -> Iterator[pa.RecordBatch]:
    """One range of rows in order: its matches, its open segments as fragments, and counts of its first and last key."""
    compiled, bucket = pattern.compiled(), TaskContext.get().partitionId()
    held: list[Rows] = []  # the last segment so far
    head_open, done, last = True, 0, (None, 0)  # whether that is still the first one; rows before it; last key with a match, its matches
    ends: dict[int, int] = {}

    def fragment(rows: Rows, part: int) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), x) for x in (rows.ids, pa.array(rows.cents))]
        one = {"ts": rows.ts[[0]], "end": rows.ts[[-1]]}
        return _batch(1, kind=[FRAGMENT], client_id=rows.client[[0]], bucket=[bucket], pos=[done], part=[part], ids=lists[0], cents=lists[1], symbols=[rows.symbols.tobytes()], first_ts=one["ts"], last_ts=one["end"], steps=rows.steps[[0]], goal=rows.goal[[0]])

    def whole(rows: Rows) -> Iterator[pa.RecordBatch]:
        nonlocal last
        begin, columns = found_in(rows, compiled)
        if len(begin):
            client = rows.client[begin]
            new = np.r_[True, client[1:] != client[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(begin)), 0))
            no = np.arange(len(begin)) - first + 1
            if client[0] == last[0]:
                no[first == 0] += last[1]
            last = (int(client[-1]), int(no[-1]))
            if first_client in client:
                ends[first_client] = int(no[client == first_client][-1])
            yield _batch(len(begin), kind=np.full(len(begin), MATCH), client_id=client, bucket=np.full(len(begin), bucket), pos=done + begin, part=np.where(client == first_client, MIDDLE, TAIL + 1), no=no, **columns)

    first_client = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, begins = with_symbols(batch, held[-1][-1:] if held else None, pattern.gap_us)
        if first_client is None:
            first_client = int(rows.client[0])
            begins[0] = False
        cuts = np.flatnonzero(begins)
        if not len(cuts):
            held.append(rows)
            continue
        before = Rows.joined([*held, rows[: cuts[0]]])
        if head_open:
            yield fragment(before, HEAD)
            head_open = False
        else:
            yield from whole(before)
        done += len(before)
        yield from whole(rows[cuts[0] : cuts[-1]])
        done += int(cuts[-1] - cuts[0])
        held = [rows[cuts[-1] :]]
    if held:
        rest = Rows.joined(held)
        yield fragment(rest, HEAD if head_open else TAIL)
        client = int(rest.client[-1])
        if client != first_client and client == last[0]:
            ends[client] = last[1]
        if ends:
            yield _batch(len(ends), kind=[COUNT] * len(ends), client_id=list(ends), bucket=[bucket] * len(ends), part=[MIDDLE] * len(ends), no=list(ends.values()))


def chained(pieces: pa.Table, pattern: Pattern) -> pa.Table:
    """Matches of one segment that goes over several ranges, from its fragments."""
    pieces = pieces.sort_by([("bucket", "ascending"), ("part", "ascending")])
    sizes = np.array([len(x) for x in pieces["symbols"].to_pylist()])
    symbols = np.frombuffer(b"".join(pieces["symbols"].to_pylist()), dtype=np.uint8).copy()
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    joint = np.array([ord(x) if x else 0 for x in pieces["first_symbol"].to_pylist()], dtype=np.uint8)
    symbols[at[joint > 0]] = joint[joint > 0]
    flat = lambda name: pa.concat_arrays([c.flatten() for c in pieces[name].chunks])
    cents = flat("cents").to_numpy()
    begin, columns = found_in(Rows(cents, cents, flat("ids"), cents, cents, cents, symbols), pattern.compiled())
    of = np.searchsorted(at, begin, side="right") - 1
    no = np.arange(len(begin)) - np.searchsorted(of, of) + 1
    take = lambda name: pieces[name].combine_chunks().take(pa.array(of))
    names = ["client_id", "bucket", "part", "no", "first_id", "last_id", "n_rows", "sum_cents", "labels"]
    return pa.table([take("client_id"), take("bucket"), take("part"), pa.array(no), *columns.values()], names=names) if len(begin) else pa.table([pa.array([], t) for n, t in _FIELDS if n in names], names=names)


def cents_of(value: Column) -> Column:
    """floor(100 * value + 0.5), null for values that aren't finite or too great."""
    scaled = 100.0 * value.cast("double") + 0.5
    return F.when(F.abs(scaled) <= MOST_CENTS, F.floor(scaled).cast("long"))


def find(clicks: DataFrame, pattern: Pattern = ZIGZAG) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents and the labels (a letter for each row) of every match."""
    kind = F.col("kind")
    is_any = lambda kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    distinct = clicks.where("client_id is not null and ts is not null").distinct()
    rows = distinct.select(
        F.col("client_id").cast("long").alias("client_id"), "ts", F.col("click_id").cast("long").alias("click_id"), cents_of(F.col("value")).alias("cents"),
        (kind.isNotNull() & ~is_any(pattern.barred)).alias("steps"), is_any(pattern.goals).alias("goal"),
    )
    order = ["client_id", "ts", "click_id", "cents", "steps", "goal"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = cut(ranged.mapInArrow(lambda batches: scan(batches, pattern), _DDL))

    # fragments, chained where one's first row goes on from the last row of the one before
    pieces = seen.where(F.col("kind") == FRAGMENT).withColumn("cents_0", F.get("cents", F.lit(0))).withColumn("cents_n", F.element_at("cents", -1))
    pieces = pieces.withColumn("has_0", F.substring("symbols", 1, 1) != F.lit(b"x")).withColumn("has_n", F.substring("symbols", -1, 1) != F.lit(b"x"))
    by_client = Window.partitionBy("client_id").orderBy("bucket", "part")
    before = {c: F.lag(c).over(by_client).alias(f"_{c}") for c in ("last_ts", "cents_n", "has_n")}
    pieces = pieces.select("client_id", "bucket", "part", "ids", "cents", "symbols", "first_ts", "cents_0", "has_0", "steps", "goal", *before.values())
    close = F.col("has_0") & (F.col("first_ts") - F.col("_last_ts") <= pattern.gap_us)
    fall, rise = (close & F.col("steps") & F.col("_has_n") & step for step in (F.col("cents_0") < F.col("_cents_n"), F.col("cents_0") > F.col("_cents_n")))
    goal = close & F.col("goal")
    letter = F.when(fall & goal, "D").when(rise & goal, "U").when(fall, "d").when(rise, "u").when(goal, "p")
    heads = F.when(F.col("part") == HEAD, letter)  # a tail begins at a break
    pieces = pieces.select("client_id", "bucket", "part", "ids", "cents", "symbols", heads.alias("first_symbol"))
    pieces = pieces.withColumn("chain", F.sum(F.col("first_symbol").isNull().cast("long")).over(by_client))
    across = "client_id long, bucket int, part tinyint, no long, first_id long, last_id long, n_rows long, sum_cents long, labels binary"
    across = cut(pieces.groupBy("client_id", "chain").applyInArrow(lambda t: chained(t, pattern), across))

    # how many matches of a key lie before a part of a range: a few rows for each range
    counts = seen.where(F.col("kind") == COUNT).select("client_id", "bucket", "part", "no").union(across.groupBy("client_id", "bucket", "part").agg(F.max("no").alias("no")))
    earlier = Window.partitionBy("client_id").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("client_id", "bucket", "part", F.coalesce(F.sum("no").over(earlier), F.lit(0)).alias("offset"))
    columns = ["client_id", "bucket", "part", "no", "first_id", "last_id", "n_rows", "sum_cents", "labels"]
    inside = seen.where(F.col("kind") == MATCH).select(*columns)
    numbered = inside.where(F.col("part") != MIDDLE).withColumn("offset", F.lit(0).cast("long"))  # keys that begin in the range
    numbered = numbered.unionByName(inside.where(F.col("part") == MIDDLE).unionByName(across).join(offsets, ["client_id", "bucket", "part"]))
    return numbered.select("client_id", (F.col("no") + F.col("offset")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", F.col("labels").cast("string").alias("labels"))


def match_digests(clicks: DataFrame, pattern: Pattern = ZIGZAG) -> DataFrame:
    """The matches with the hash of their labels in place of these."""
    return find(clicks, pattern).withColumn("labels_sha256", F.sha2(F.col("labels").cast("binary"), 256)).drop("labels")


#: The same rows by windows: no row is both D and U, so a match ends with the last U of the unbroken run of D and U rows
#: that follows its start, or with the goal row after that.
ORACLE = """
WITH distinct_rows AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
valued AS (SELECT client_id, ts, click_id, kind, CASE WHEN abs(100 * value + 0.5) <= 9e15 THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents FROM distinct_rows),
placed AS (SELECT *, row_number() OVER w AS rn, lag(cents) OVER w AS before, epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 AS close FROM valued
  WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, cents NULLS FIRST, kind)),
lettered AS (SELECT *, CASE WHEN close AND kind <> 'error' AND cents < before THEN 'D' WHEN close AND kind <> 'error' AND cents > before THEN 'U' END AS letter,
  coalesce(close AND kind = 'click', false) AS goal FROM placed),
runs AS (SELECT *, sum(CASE WHEN letter IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run,
  coalesce(sum(cents) OVER (PARTITION BY client_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS upto FROM lettered),
spelled AS (SELECT client_id, run, min(rn) AS from_rn, max(CASE WHEN letter = 'U' THEN rn END) AS last_u, string_agg(letter, '' ORDER BY rn) AS letters FROM runs WHERE letter IS NOT NULL GROUP BY client_id, run),
cored AS (SELECT a.client_id, a.rn, a.click_id AS first_id, a.cents, a.upto, s.last_u, substr(s.letters, a.rn + 1 - s.from_rn + 1, s.last_u - a.rn) AS middle
  FROM runs a JOIN runs b ON b.client_id = a.client_id AND b.rn = a.rn + 1 AND b.letter = 'D' JOIN spelled s ON s.client_id = b.client_id AND s.run = b.run WHERE a.cents IS NOT NULL AND s.last_u > a.rn),
ended AS (SELECT c.*, l.click_id AS core_id, l.upto AS core_upto, p.click_id AS goal_id, p.upto AS goal_upto, p.rn IS NOT NULL AS with_goal
  FROM cored c JOIN runs l ON l.client_id = c.client_id AND l.rn = c.last_u LEFT JOIN runs p ON p.client_id = c.client_id AND p.rn = c.last_u + 1 AND p.goal AND p.cents >= c.cents)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY rn) AS match_no, first_id, CASE WHEN with_goal THEN goal_id ELSE core_id END AS last_id,
  last_u - rn + 1 + CASE WHEN with_goal THEN 1 ELSE 0 END AS n_rows, CAST(CASE WHEN with_goal THEN goal_upto ELSE core_upto END - upto + cents AS BIGINT) AS sum_cents,
  sha256('A' || middle || CASE WHEN with_goal THEN 'P' ELSE '' END) AS labels_sha256
FROM ended
"""
