"""Copy and scatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy(df: DataFrame) -> DataFrame:
    return df.select("*")


def scatter(df: DataFrame, value: str, position: Column) -> DataFrame:
    """(idx, v) with v at its position. A relation has no physical order, so the target index is the result; nothing moves."""
    return df.select(position.cast("bigint").alias("idx"), F.col(value).alias("v"))
