"""Every query with SQL of its own gives the same rows in DuckDB."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from watchshelf.queries import ORACLES, QUERIES

from conftest import DATA, ROOT, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert rows_of(QUERIES[name](spark, str(DATA))) == rows_of_sql(ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["season_key", "n"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "watchshelf", tmp_path / "watchshelf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.strip() == str(len(QUERIES)), said.stderr
