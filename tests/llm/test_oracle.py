"""The operator queries that SQL can express, against DuckDB."""
import duckdb
import pytest

from tessera.llm.oracle import LLM_ORACLE
from tessera.llm.queries import LLM_QUERIES
from tessera.plans.oracle_check import rows_key

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(LLM_ORACLE[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_key(df.columns, got) == rows_key(columns, res.fetchall())
