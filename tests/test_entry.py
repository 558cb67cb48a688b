"""The driver contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_flagship_and_duckdb(spark):
    import duckdb

    got = [tuple(r) for r in entry.entry(spark).collect()]
    assert len(got) == 10
    con = duckdb.connect()
    for table in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    want = con.execute(entry.oracle_sql()["top_performers"]).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
