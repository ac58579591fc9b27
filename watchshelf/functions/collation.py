"""Strings that compare as the catalog's database compares them: without regard to case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of Spark's collations the one that ignores case and still takes LIKE.
IGNORING_CASE = "UTF8_LCASE"


def ignoring_case(df: DataFrame, *columns: str) -> DataFrame:
    """df in which =, IN, LIKE, contains, GROUP BY, DISTINCT, sorts and joins on these columns (all strings unless named) ignore case; values stay as they are.

    Groups keep one of their spellings; fold it with lower() where it must be the same each time. Filters on such columns
    are not pushed into files, whose statistics are binary.
    """
    wanted = columns or tuple(name for name, kind in df.dtypes if kind == "string")
    return df.withColumns({c: F.collate(c, IGNORING_CASE) for c in wanted})


def binary(df: DataFrame) -> DataFrame:
    """df with plain strings again, as files want them."""
    return df.withColumns({f.name: F.collate(f.name, "UTF8_BINARY") for f in df.schema if f.dataType.typeName().startswith("string")})
