"""One small session for all tests, and the driver's tables in DuckDB beside it."""

from __future__ import annotations

import decimal
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as text, numbers to six places."""
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(df):
    """(columns, sorted rows) of a Spark DataFrame, columns by name."""
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sql: str, folder=DATA):
    import duckdb

    with duckdb.connect() as con:
        for name in TABLES:
            if (path := Path(folder) / f"{name}.parquet").exists():
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        columns = sorted(names)
        at = [names.index(c) for c in columns]
        return columns, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
