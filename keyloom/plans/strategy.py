"""Choice of a join strategy and proof of what ran."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a side may have before the in-memory strategy gives way, as in the reference's defaults.
IN_MEMORY_ROWS = 128_000_001
#: Bytes that a side may have to be broadcast, by Catalyst's estimate and by its counted rows.
BROADCAST_BYTES = 64 << 20
#: Types that take no more than their 8 bytes in a row.
FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}

NODES = {"broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "merge": "SortMergeJoin", "shuffle_replicate_nl": "CartesianProduct"}


def choose_strategy(n_build: int, n_probe: int, limit: int = IN_MEMORY_ROWS) -> str:
    """in_memory if both sides are below the limit, streaming_probe if only the build side is, co_processing otherwise."""
    if n_build >= limit:
        return "co_processing"
    return "in_memory" if n_probe < limit else "streaming_probe"


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, from statistics and file sizes; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows as Spark holds them in memory: 8 a column, 8 of null bits for 64 columns, and the text of columns of no fixed width. Counted, in one aggregate."""
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c, kind in df.dtypes if kind not in FIXED]
    n, *held = df.agg(F.count("*"), *texts).first()
    return n * 8 * (len(df.columns) + -(-len(df.columns) // 64)) + sum(held)


def checked_hint(build: DataFrame, hint: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """build with the hint; a broadcast of a side not known to be small becomes a shuffled sort-merge join, which spills.

    Catalyst's estimate follows the compressed files, and a broadcast is held uncompressed by the driver: a side that is small by the
    estimate is counted.
    """
    if hint == "broadcast" and (size_bytes(build) > limit or row_bytes(build) > limit):
        hint = "merge"
    return build.hint(hint)


def executed(df: DataFrame) -> str:
    """The physical plan's text; the final one if df has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> dict[str, int]:
    """How often each join and exchange occurs in the plan."""
    found: dict[str, int] = {}
    text = executed(df).split("== Initial Plan ==")[0]
    for name in re.findall(r"\b(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|CartesianProduct|BroadcastNestedLoopJoin|BroadcastExchange|Exchange|HashAggregate)\b", text):
        found[name] = found.get(name, 0) + 1
    return found
