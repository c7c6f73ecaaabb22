"""Registered queries with SQL, against that SQL on the smallest tables."""

import duckdb
import pytest

from tracewell.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sql, name, tmp_path):
    out = str(tmp_path / "out")
    QUERIES[name](spark, SF).write.parquet(out)
    got = sql.execute(f"select * from '{out}/*.parquet'")
    order = sorted(x[0] for x in got.description)
    cols = ", ".join(f'"{c}"' for c in order)
    a = sql.execute(f"select {cols} from '{out}/*.parquet' order by all").fetchall()
    b = sql.execute(f"select {cols} from ({ORACLE[name]}) order by all").fetchall()
    assert len(a) == len(b) and a == b
