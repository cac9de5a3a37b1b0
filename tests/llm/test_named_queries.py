"""The named queries of the subpackage against SQL over whole small tables."""

from pathlib import Path

import pytest

from chainlake.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name]).df()
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.toPandas()[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, str(FOLDER)).count() > 0
