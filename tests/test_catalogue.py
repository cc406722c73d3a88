"""Every query with SQL gives the rows that DuckDB gives, and the entry point works without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from chromaflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    own.execute("set timezone = 'UTC'")
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return own


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, (str, bool)) else float(v) if isinstance(v, (int, float, np.number)) else v
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_subpackage(tmp_path):
    """The entry still imports and lists the engine's own queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path / "e.py")
    shutil.copytree(f"{root}/chromaflow", tmp_path / "chromaflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import e; q = e.queries(); assert 'histogram_posterized' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0
