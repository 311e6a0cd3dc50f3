import glob
from pathlib import Path

import duckdb
import pytest

from keyfathom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    if not Path(DATA).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(ORACLE_SQL[name]).columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) == set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
