"""Tables changed in place: equal to the whole-table operators, and files of untouched buckets stay."""

import random

import pytest

from graticule.operators import catalog
from graticule.operators.keyed import KeyedTable, cascade

DDL = "id long, name string, n int, created_at long, updated_at long"


def rows(df):
    return sorted(map(str, df.collect()))


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_changes_equal_those_of_whole_tables(spark, tmp_path):
    rng = random.Random(4)
    whole = spark.createDataFrame([(i, f"n{i}", i % 5, i, i) for i in range(60)] + [(None, None, None, None, None)], DDL).cache()
    table = KeyedTable.create(whole, str(tmp_path / "t"), ["id"], 8)
    assert rows(table.read()) == rows(whole)
    first = table.store.snapshot()
    for step in range(3):
        ids = rng.sample(range(80), 4)
        new = spark.createDataFrame([(i, f"new {step}", step, 1000 + step, rng.choice([-1, 2000 + step])) for i in ids], DDL).cache()
        table.upsert(new)
        whole = spark.createDataFrame(catalog.upsert(whole, new, ["id"]).collect(), DDL)
        assert rows(table.read()) == rows(whole)
    changes = spark.createDataFrame([(3, "set", True, None, True), (5, None, False, 9, True), (999, "no", True, 1, True)], "id long, name string, set_name boolean, n int, set_n boolean")
    table.update(changes, ["name", "n"])
    whole = catalog.partial_update(whole, changes, ["id"], ["name", "n"])
    assert rows(table.read()) == rows(whole)
    gone = spark.createDataFrame([(3,), (4,), (777,)], "id long")
    table.delete(gone)
    whole = catalog.delete_by(whole, gone, ["id"])
    assert rows(table.read()) == rows(whole)
    table.compact()
    assert rows(table.read()) == rows(whole)
    assert table.read(first).count() == 61
    table.store.vacuum(1)
    assert rows(table.read()) == rows(whole)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    whole = spark.createDataFrame([(i, f"n{i}", 0, i, i) for i in range(200)], DDL)
    table = KeyedTable.create(whole, str(tmp_path), ["id"], 16)
    before, held = files(tmp_path), table.store.snapshot()
    table.delete(spark.createDataFrame([(7,)], "id long"))
    after, now = files(tmp_path), table.store.snapshot()
    assert {k: v for k, v in after.items() if k in before} == before
    changed = {b for b, f in now.facts["folders"].items() if f != held.facts["folders"][b]}
    assert len(changed) == 1
    written = [k for k in after if k not in before]
    assert written and all(f"_bucket={next(iter(changed))}/" in k for k in written)
    plan = table._rows(now, {int(next(iter(changed)))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 1 and f"_bucket" in plan
    assert table.delete(spark.createDataFrame([], "id long")) == now


def test_a_bucket_that_is_emptied_and_filled_again(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a", 0, 1, 1)], DDL), str(tmp_path), ["id"], 2)
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "b", 0, 2, 2), (2, "c", 0, 2, 2)], DDL))
    assert sorted(r["name"] for r in table.read().collect()) == ["b", "c"]


def test_cascade(spark, tmp_path):
    parents = KeyedTable.create(spark.createDataFrame([(i,) for i in range(10)], "id long"), str(tmp_path / "p"), ["id"], 4)
    children = KeyedTable.create(spark.createDataFrame([(i % 10, i) for i in range(30)], "id long, line int"), str(tmp_path / "c"), ["id"], 4)
    cascade(parents, children, spark.createDataFrame([(2,), (3,)], "id long"), "id")
    assert sorted(r["id"] for r in parents.read().collect()) == [0, 1, *range(4, 10)]
    assert children.read().count() == 24
    with pytest.raises(ValueError):
        cascade(parents, children, spark.createDataFrame([(2,)], "id long"), "line")
