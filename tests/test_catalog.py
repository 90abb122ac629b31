"""Every registered query against its SQL twin in DuckDB, value by value."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    if name not in catalog.ORACLE_SQL:
        assert frame.columns
        return
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in result.fetchall())
    assert sorted(names) == sorted(frame.columns)
    assert got == want
