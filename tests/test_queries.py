"""Every named core query against its SQL in DuckDB, over whole small tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from chainlake.plans import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, int | float) and not isinstance(v, bool):
        return float(v)
    return v if isinstance(v, bool | str) else str(v)


def _rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    rows = [tuple(_plain(v) for v in r) for r in df[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def _same(a: list[tuple], b: list[tuple]) -> bool:
    return len(a) == len(b) and all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)
    )


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(FOLDER)).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _same(_rows(got, columns), _rows(want, columns))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_llm(monkeypatch):
    find = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda n: None if ".llm" in n else find(n))
    assert "agg_2_nmer_ppi" in entry.queries()
    assert not any(q.startswith(("p1_", "p7_")) for q in entry.queries())
