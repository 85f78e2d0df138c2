"""Each query against its SQL over the smallest tables."""

import datetime

import duckdb
import pytest

from tests.conftest import SF
from voxelry.plans.files import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: Queries that take long; their SQL is compared in the driver's run.
SLOW = {"topology_rows", "eps_sweep", "ibi_k4", "ibi_wide", "ibi_eps", "ibi_one_plane", "slab_table", "li_cube_ibi", "immersion_blocks", "seeded_blocks", "round0_deltas"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return round(float(v), 6) if v is not None and not isinstance(v, (str, bool)) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(rounded(v) for v in r) for r in got.select(columns).collect()), key=str)
    if name not in SQL:
        assert rows
        return
    want = sorted((tuple(rounded(v) for v in r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()), key=str)
    assert rows == want


def test_entry():
    import __spark_entry__ as entry

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
