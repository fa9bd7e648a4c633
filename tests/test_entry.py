import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "suggest_prefix" in q


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_oracles(spark):
    """Every core query against its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    q = entry.queries()

    def plain(v):
        return round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) else v

    for name, sql in entry.oracle_sql().items():
        a, b = q[name](spark, str(SF)).toPandas(), con.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        rows = lambda x: sorted((tuple(plain(v) for v in r) for r in x[cols].astype(object).where(x[cols].notna(), None).values.tolist()), key=str)  # noqa: E731, B023
        assert rows(a) == rows(b), name
