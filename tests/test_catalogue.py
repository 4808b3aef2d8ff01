import duckdb
import pytest

from chronoweave.plans import closing, corpus, features, reports, selections, texts  # noqa: F401  they add their queries
from chronoweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents labels conversations part".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) > 0
    assert a == b
