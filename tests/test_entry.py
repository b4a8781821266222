"""The entry point: with and without its optional parts, and its SQL against DuckDB."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cleanloom import queries

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "cleanloom"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "cleanloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(set(e.oracle_sql()) < set(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "False"]


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "cleanloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "cleanloom.llm" not in path.read_text()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in ("orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, views, name):
    run, sql = queries.QUERIES[name]
    got, want = run(spark, SF), views.sql(sql)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    left = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert left == right
