"""Every core query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import catalog
from sparkloom.plans.programs import BASE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir_module}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "as_tuple") else v


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


_OWN = [k for k, v in catalog.ALL.items() if v[1] and (k in BASE or all(v is not x for x in BASE.values()))]


@pytest.mark.parametrize("name", _OWN)
def test_against_sql(spark, duck, sf_dir_module, name):
    run, sql = catalog.ALL[name]
    same(run(spark, sf_dir_module), duck.sql(sql))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
