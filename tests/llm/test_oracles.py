"""The queries that SQL can express against DuckDB."""

import os

import duckdb
import pytest

from chromaflow.llm.queries import ORACLES, QUERIES


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_that_of_sql(spark, sf_dir, name):
    own = QUERIES[name](spark, sf_dir)
    with duckdb.connect() as db:
        for file in os.listdir(sf_dir):
            if file.endswith(".parquet"):
                db.execute(f"create view {file[:-8]} as select * from read_parquet('{sf_dir}/{file}')")
        want = db.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        want = want.fetchall()
    assert sorted(columns) == sorted(own.columns)
    assert rows(own.columns, own.collect()) == rows(columns, want)
