"""Row pattern matching against a regular expression at every start of every client, and its edge cases."""

import collections
import datetime as dt
import hashlib
import math
import random
import re

import pytest

pytest.importorskip("graticule.llm")

from graticule.llm import rowpattern
from graticule.llm.common import table

DDL = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, bucket int, part string, no long"
T0 = dt.datetime(2024, 3, 1)


def brute(rows, letters="A(D+U+)+P?", gap=dt.timedelta(minutes=30)):
    """Every start by itself: each row gets a symbol for the letters it can be at this start."""
    by_client = collections.defaultdict(list)
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            v = r[5]
            cents = math.floor(100 * v + 0.5) if v is not None and math.isfinite(v) and abs(100 * v + 0.5) <= 9e15 else None
            steps, goal = r[4] is not None and r[4] != "error", r[4] == "click"
            by_client[r[3]].append((r[1], (r[0] is not None, r[0] or 0), (cents is not None, cents or 0), steps, goal, r[0], cents))
    out = []
    for client, own in by_client.items():
        own.sort(key=lambda x: x[:5])
        no = 0
        for s, (*_, cents_a) in enumerate(own):
            if cents_a is None:
                continue
            word = ["A"]
            for before, now in zip(own[s:], own[s + 1 :], strict=False):
                close = now[0] - before[0] <= gap and now[6] is not None
                fall = close and now[3] and before[6] is not None and now[6] < before[6]
                rise = close and now[3] and before[6] is not None and now[6] > before[6]
                goal = close and now[4] and now[6] >= cents_a
                word.append({(1, 0, 0): "d", (0, 1, 0): "u", (0, 0, 1): "p", (1, 0, 1): "D", (0, 1, 1): "U"}.get((fall, rise, goal), "-"))
            spelled = letters.replace("D", "[dD]").replace("U", "[uU]").replace("P?", "([pDU]?)").replace("P", "([pDU])")
            m = re.match(spelled.replace("[[dD]", "[d").replace("[d[uU]]", "[dDuU]").replace("[p[dD][uU]]", "[pDU]"), "".join(word))
            if m:
                no += 1
                said = m[0].upper()
                if m.lastindex and m.start(m.lastindex) >= 0 and m.re.groups > 1 and m[m.re.groups]:
                    said = said[: m.start(m.re.groups)] + "P"
                part = own[s : s + m.end()]
                out.append((client, no, part[0][5], part[-1][5], len(part), sum(x[6] for x in part), said))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def some(n, seed, clients=3, kinds=("click", "view", "error", None), step=12, tops=8):
    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, step, 30, 31] if rng.random() < 0.1 else [0, 1, 2]), microseconds=rng.choice([0, 0, 1]))
        value = rng.choice([None, math.nan, -math.inf, 1e300]) if rng.random() < 0.02 else round(rng.uniform(-1, tops), 2)
        rows.append((i if rng.random() > 0.02 else None, at, at, rng.choice([*range(clients)] * 20 + [None]), rng.choice(kinds), value, "{}", 1, "x", 2))
    return rows + rng.sample(rows, min(n, 5))


@pytest.fixture
def many_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_start(spark, many_ranges, seed):
    rows = some(700, seed)
    got = rowpattern.find(spark.createDataFrame(rows, DDL)).collect()
    want = brute(rows)
    assert len(want) > 30
    same(got, want)


def test_one_client_over_many_ranges(spark, many_ranges):
    """Segments that go through several ranges: each range holds some 7 rows of one client."""
    rng = random.Random(5)
    rows = [(i, T0 + dt.timedelta(minutes=i), None, 9, "click" if i % 7 else "view", float(rng.randrange(50) + (i % 2) * 60 * (i % 90 > 2)), None, 0, "", 0) for i in range(200)]
    got = rowpattern.find(spark.createDataFrame(rows, DDL)).collect()
    assert max(r["n_rows"] for r in got) > 60
    same(got, brute(rows))


def test_falling_and_unbroken(spark, many_ranges):
    falling = [(i, T0 + dt.timedelta(minutes=i), None, 1, "view", float(1000 - i), None, 0, "", 0) for i in range(300)]
    assert rowpattern.find(spark.createDataFrame(falling, DDL)).count() == 0
    rows = [*falling, (300, T0 + dt.timedelta(minutes=300), None, 1, "view", 5000.0, None, 0, "", 0)]
    got = rowpattern.find(spark.createDataFrame(rows, DDL)).collect()
    assert [r["n_rows"] for r in sorted(got, key=lambda r: r["match_no"])] == list(range(301, 2, -1))


def test_other_patterns(spark, many_ranges):
    rows = some(400, 3)
    for letters in ("A D+ P", "A U D U?"):
        pattern = rowpattern.Pattern(letters, 30 * 60 * 1_000_000, ("error",), ("click",))
        got = rowpattern.find(spark.createDataFrame(rows, DDL), pattern).collect()
        want = brute(rows, letters.replace(" ", ""))
        if letters == "A D+ P":  # the goal row is the last
            want = [(*w[:6], w[6][:-1] + "P") for w in want]
        assert want
        same(got, want)
    with pytest.raises(ValueError, match="not a pattern"):
        rowpattern.Pattern("D A", 1, (), ()).compiled()


def test_goal_against_its_start():
    """Goal symbols are switched off only for starts of greater values, whatever the order of the rows."""
    import numpy as np

    symbols = np.frombuffer(b"aduDaduDadup", dtype=np.uint8)
    cents = np.array([500, 100, 600, 450, 300, 100, 600, 310, 200, 100, 900, 199])
    begin, end, labels = rowpattern.matches(symbols, cents, rowpattern.ZIGZAG.compiled())
    assert begin.tolist() == [0, 4, 8]
    assert end.tolist() == [3, 8, 11]
    assert labels == [b"ADU", b"ADUP", b"ADU"]


def test_empty_and_broken(spark):
    assert rowpattern.match_digests(spark.createDataFrame([], DDL)).count() == 0
    rows = [(None, None, None, None, None, None, None, None, None, None), (1, T0, None, None, "click", 1.0, None, 0, "", 0), (1, None, None, 1, "click", 1.0, None, 0, "", 0), (None, T0, None, 1, None, None, None, 0, "", 0)]
    assert rowpattern.match_digests(spark.createDataFrame(rows, DDL)).count() == 0
    ties = [(None, T0, None, 1, None, 3.0, None, 0, "", 0), (1, T0, None, 1, "view", 2.0, None, 0, "", 0), (1, T0, None, 1, "view", 2.0, None, 0, "", 0), (2, T0 + dt.timedelta(minutes=30), None, 1, "view", 2.5, None, 0, "", 0)]
    assert [tuple(r) for r in rowpattern.find(spark.createDataFrame(ties, DDL)).collect()] == [(1, 1, None, 2, 3, 750, "ADU")]
    late = [*ties[:3], (2, T0 + dt.timedelta(minutes=30, microseconds=1), None, 1, "view", 2.5, None, 0, "", 0)]
    assert rowpattern.find(spark.createDataFrame(late, DDL)).count() == 0


def test_digests_and_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    got = rowpattern.match_digests(table(spark, sf_dir, "clicks")).collect()
    con = duckdb.connect()
    con.execute(f"create view clicks as select * from '{sf_dir}/clicks.parquet'")
    want = con.execute(rowpattern.ORACLE).fetchall()
    assert len(want) > 100
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    said = rowpattern.find(table(spark, sf_dir, "clicks")).limit(20).collect()
    hashes = {(r["client_id"], r["match_no"]): r["labels_sha256"] for r in got}
    assert all(hashlib.sha256(r["labels"].encode()).hexdigest() == hashes[r["client_id"], r["match_no"]] for r in said)
