"""Every registered query against its DuckDB SQL on the smallest tables."""
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tessera.plans.catalog import QUERIES
from tessera.plans.oracle_check import TABLES, rows_key

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(queries())
    missing = set(QUERIES) - set(oracle_sql())
    assert missing == set(), missing


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["source", "n_chunks", "avg_chunk_chars", "min_chunk_chars", "max_chunk_chars"]
    assert df.count() > 0


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(f"SELECT * FROM ({oracle_sql()[name]}) LIMIT 0")
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(dcols) == sorted(df.columns)
    assert len(srows) == len(drows)
    assert rows_key(df.columns, srows) == rows_key(dcols, drows)
