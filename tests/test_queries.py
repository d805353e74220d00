"""Every query with SQL gives the rows of its SQL; every other one runs."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from strataform.plans import registry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Checked against true or brute-force results in tests of their own.
OWN = {n for n in QUERIES if n not in SQL}


def plain(rows):
    def one(v):
        if v is None:
            return "-"
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, db, name):
    got = QUERIES[name](spark, data)
    want = db.execute(SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert plain(got.select(*[f"`{c}`" for c in cols]).collect()) == plain(want.fetchall())


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES) and all(n.startswith("p") for n in OWN)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_text_operators():
    """Nothing outside the folder imports it."""
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/strataform/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "strataform.llm" not in open(f).read(), f


def test_the_rest_stands_with_the_text_folders_deleted(tmp_path):
    """A copy without both folders imports, keeps all other queries and has none of theirs."""
    root = os.path.dirname(entry.__file__)
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; from strataform.plans import registry as r; assert set(e.queries()) == set(r.queries()) and set(e.oracle_sql()) == set(r.oracle_sql()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(set(QUERIES) & set(registry.queries()))
