"""Reductions by function id, as partial and final hash aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function ids: 1 minimum, 2 maximum, 3 sum.
FUNCTIONS = {1: F.min, 2: F.max, 3: F.sum}


def aggregate(df: DataFrame, value: str, func_id: int, out: str = "res") -> DataFrame:
    if func_id not in FUNCTIONS:
        raise ValueError(f"function id {func_id}: one of {sorted(FUNCTIONS)} is expected")
    return df.agg(FUNCTIONS[func_id](F.col(value).cast("bigint")).alias(out))


def aggregate_all(df: DataFrame, value: str) -> DataFrame:
    """One row for each function id, in a single pass over df."""
    one = df.agg(*(f(F.col(value).cast("bigint")).alias(f"f{i}") for i, f in FUNCTIONS.items()))
    pairs = F.array(*(F.struct(F.lit(i).alias("func_id"), F.col(f"f{i}").alias("res")) for i in FUNCTIONS))
    return one.select(F.explode(pairs).alias("p")).select("p.func_id", "p.res")
