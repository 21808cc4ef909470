import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(df):
    cols = sorted(df.columns)
    cell = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(cell(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=str)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in entry.core.QUERIES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())
