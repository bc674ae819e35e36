import duckdb
import pandas as pd
import pytest

from lodestone.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events pages documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, name):
    got = queries()[name](spark, SF).toPandas()
    want = db.execute(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda d: pd.DataFrame(sorted(map(tuple, d[cols].astype(str).itertuples(index=False)))) if len(d) else d
    pd.testing.assert_frame_equal(norm(got), norm(want))
