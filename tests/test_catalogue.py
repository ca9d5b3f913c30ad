"""Every relational query against DuckDB on the same tables, and the entry module without the llm folders."""

import datetime
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cairn.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value.replace(microsecond=0)) if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df, found = QUERIES[name](spark, tiny), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60; assert not [q for q in e.queries() if q.startswith('op1_')]; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
