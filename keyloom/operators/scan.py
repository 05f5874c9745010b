"""Prefix sums. None of them collapses the rows into a single partition.

Rows are cut into blocks by position, each block is scanned by its own window,
and the block totals are scanned the same way, level by level, until few
enough are left for one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows that a window without a partition key is given.
ONE_WINDOW_ROWS = 100_000
BLOCK = 1024


def _window(*by: str, reverse: bool = False):
    w = Window.partitionBy(*by).orderBy(F.col("pos").desc() if reverse else F.col("pos"))
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _before(value: str, *by: str, reverse: bool = False) -> Column:
    return F.coalesce(F.sum(value).over(_window(*by, reverse=reverse)), F.lit(0)).cast("bigint")


def exclusive_scan(df: DataFrame, pos: str, value: str, block: int = BLOCK, suffix: bool = False) -> DataFrame:
    """(pos, v, scan): the sum of v over all smaller (suffix: larger) positions. Positions are distinct integers."""
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("bigint").alias("v"))
    lo, hi = rows.agg(F.min("pos"), F.max("pos")).first()
    if lo is None:
        return rows.withColumn("scan", F.lit(0).cast("bigint"))
    return _levels(rows, lo, hi, block, suffix)


def _levels(rows: DataFrame, lo: int, hi: int, block: int, suffix: bool) -> DataFrame:
    if hi - lo < block:
        return rows.withColumn("scan", _before("v", reverse=suffix))
    cut = rows.withColumn("__block", F.floor(F.col("pos") / block))
    sums = cut.groupBy("__block").agg(F.sum("v").alias("v")).select(F.col("__block").alias("pos"), "v")
    lo, hi = lo // block, hi // block
    above = sums.withColumn("scan", _before("v", reverse=suffix)) if hi - lo < ONE_WINDOW_ROWS else _levels(sums, lo, hi, block, suffix)
    base = above.select(F.col("pos").alias("__block"), F.col("scan").alias("__base"))
    inner = cut.withColumn("__in", _before("v", "__block", reverse=suffix))
    return inner.join(base, "__block").select("pos", "v", (F.col("__base") + F.col("__in")).alias("scan"))


def segmented_scan(df: DataFrame, pos: str, value: str, segment: Column) -> DataFrame:
    """(segment, pos, scan): an exclusive scan that begins anew in each segment; segments are contiguous ranges of positions.

    The whole is scanned level by level and a segment's base, the scan at its first position, taken off: a
    segment that holds most rows is no window of its own.
    """
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("bigint").alias("v"), segment.cast("bigint").alias("segment"))
    return _rebased(exclusive_scan(rows, "pos", "v").join(rows.select("pos", "segment"), "pos"))


def _rebased(scanned: DataFrame) -> DataFrame:
    """(segment, pos, scan) from (segment, pos, scan) of the whole."""
    base = scanned.groupBy("segment").agg(F.min_by("scan", "pos").alias("__base"))
    return scanned.join(base, "segment").select("segment", "pos", (F.col("scan") - F.col("__base")).alias("scan"))


def bordered_scan(df: DataFrame, pos: str, value: str, borders: DataFrame) -> DataFrame:
    """(segment, pos, scan) by a table of borders (border BIGINT): a segment begins at each, and its number is the number of borders up to it.

    Borders are scanned with the rows, as rows that count one and come before the row at their position, so no range join is needed.
    """
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("bigint").alias("v"))
    marks = borders.select((F.col("border") * 2).alias("at"), F.lit(1).cast("bigint").alias("one")).distinct()
    both = marks.unionAll(rows.select((F.col("pos") * 2 + 1).alias("at"), F.lit(0).cast("bigint").alias("one")))
    number = exclusive_scan(both, "at", "one").where(F.pmod("pos", F.lit(2)) == 1).select(F.expr("(pos - 1) div 2").alias("pos"), F.col("scan").alias("segment"))
    return _rebased(exclusive_scan(rows, "pos", "v").join(number, "pos"))


def interleaved_scan(df: DataFrame, pos: str, value: str, ranges: int, block: int = BLOCK) -> DataFrame:
    """(block, range, pos, scan): within each block of positions, `ranges` interleaved exclusive scans; range is the position modulo their number."""
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("bigint").alias("v"))
    cut = rows.withColumn("block", F.floor(F.col("pos") / block)).withColumn("range", F.pmod("pos", F.lit(ranges)))
    return cut.select("block", "range", "pos", _before("v", "block", "range").alias("scan"))


def block_bases(df: DataFrame, pos: str, value: str, block: int = BLOCK) -> DataFrame:
    """(block, total, base): the upper level of the two-level scan."""
    sums = df.groupBy(F.floor(F.col(pos) / block).alias("block")).agg(F.sum(value).cast("bigint").alias("total"))
    return exclusive_scan(sums, "block", "total").select(F.col("pos").alias("block"), F.col("v").alias("total"), F.col("scan").alias("base"))


def row_ids(df: DataFrame, order: str, width: int = BLOCK, descending: bool = False) -> DataFrame:
    """df with row_id 0..n-1 in the order of a distinct integer column: rank within ranges of the key plus a scan of range counts."""
    key = F.col(order)
    cut = df.withColumn("__r", F.floor(key / width))
    n = cut.groupBy("__r").agg(F.count("*").alias("__n"))
    base = exclusive_scan(n, "__r", "__n", suffix=descending).select(F.col("pos").alias("__r"), F.col("scan").alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy(key.desc() if descending else key))
    return cut.withColumn("__k", rank.cast("bigint")).join(base, "__r").withColumn("row_id", F.col("__base") + F.col("__k") - 1).drop("__r", "__k", "__base")
