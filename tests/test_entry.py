"""Every query against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        at = {c[0]: i for i, c in enumerate(r.description)}
        assert sorted(at) == columns
        want = sorted((tuple(plain(x[at[c]]) for c in columns) for x in r.fetchall()), key=str)
        assert list(map(str, got)) == list(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo", "operation_key", "file_path"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib

    for f in pathlib.Path(entry.__file__).parent.joinpath("factweave").rglob("*.py"):
        if "llm" not in f.parts:
            assert "factweave.llm" not in f.read_text()
