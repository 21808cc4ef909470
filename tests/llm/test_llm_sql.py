import glob
import os

import pytest

from vecloom.llm import checks, queries  # noqa: F401 - the first adds queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(None if v is None or v != v else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = rows(queries.QUERIES[name](spark, SF).toPandas()), rows(con.sql(queries.ORACLE[name]).df())
    assert a[0] == b[0] and [str(x) for x in a[1]] == [str(x) for x in b[1]]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
