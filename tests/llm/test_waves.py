"""Nearest neighbours with the queries in several waves, of several dimensions, and candidates that are not exchanged again."""

import random

import pytest

pytest.importorskip("graticule.llm")

from pyspark.sql import functions as F

from graticule.llm import ann


def test_waves_and_dimensions(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-4, 4) or 1) for _ in range(3 if i % 3 else 5)]) for i in range(150)]
    rows += [(500 + i, [1.0, 2.0, 3.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = []
    for q, v in rows:
        if q % 10 == 0:
            near = sorted((-dot(v, w), c) for c, w in rows if c != q and len(w) == len(v))[:4]
            want += [(q, i, c, -s) for i, (s, c) in enumerate(near, 1)]
    for wave in (ann.WAVE, 20):
        assert sorted(map(tuple, ann.search(frame, F.col("vec_id") % 10 == 0, 4, wave=wave).collect())) == sorted(want)
