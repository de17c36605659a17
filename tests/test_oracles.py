"""Every registered query over security events against its SQL oracle."""

import duckdb
import pytest

from threatlake import registry

SF = "/root/testdata/sf0.01"
TABLES = "events documents embeddings labels conversations benchmark".split()


def rows(frame):
    return sorted(map(repr, ([None if v is None else (round(v, 6) if isinstance(v, float) else v) for v in r] for r in frame)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = [tuple(r) for r in got.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert found
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(f"select {', '.join(columns)} from ({sql}) q").fetchall()
    assert rows(found) == rows(want)
