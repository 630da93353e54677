import decimal
from pathlib import Path

import duckdb
import pytest

from quarry.plans import catalog, evidence

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


QUERIES, SQL = catalog.QUERIES | evidence.QUERIES, catalog.ORACLE_SQL | evidence.ORACLE_SQL


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, name):
    own = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(own.columns)
    want = sorted(([plain(v) for v in r] for r in cursor.fetchall()), key=repr)
    assert sorted(([plain(v) for v in r] for r in own.select(*columns).collect()), key=repr) == want
