"""Every measurement query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from marlstone import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(map(plain, r)) for r in out.select(*columns).collect()), key=str)
    assert name in catalog.oracle_sql(), "a query without SQL needs a brute-force test of its own"
    want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=str)
