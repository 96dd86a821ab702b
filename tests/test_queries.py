"""Every registered query of the core engine against its oracle in DuckDB; without an oracle, it has to run."""

import math
import os

import pytest

from plumbline.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("PLUMBLINE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DATA}/orders.parquet"), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, bool | str) else round(float(v), 6)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert bag(df.columns, rows) == bag(rel.columns, rel.fetchall())
    else:
        assert rows
