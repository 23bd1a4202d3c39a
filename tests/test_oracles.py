"""Every registered query of the engine's own operators against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from graticule.plans import registry

registry.load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return str(x)


def rows(found, columns):
    return sorted([[plain(r[columns.index(c)]) for c in sorted(columns)] for r in found], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
