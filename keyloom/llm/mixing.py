"""Mixing of sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key from its doc_id. The keys of a source are cut
into equal ranges, sizes are summed by range, prefix sums over the ranges find the one
in which the source's budget ends, and a second prefix sum over that range's keys
finds the document. What comes of it is one row for each source: how many whole epochs,
the key at which the last epoch is cut, and the words left for the document there.
A document then knows by its own key what the mix takes of it, so texts are never
shuffled and no window sees more than about the square root of the rows.

Null texts have size 0, a null source is a source of its own, weighed last. Rows that
share a doc_id share a key; if the cut falls on them, they share what is left by size. A
source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.session import fresh, remove, written

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Sources up to which the table of cuts is broadcast; beyond, it is joined with a salt.
BROADCAST_SOURCES = 50_000
SALTS = 64
KEY_BITS = 60
_SPACE = "[\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, _SPACE, -1), lambda w: w != "")), F.lit(0)).cast("bigint")


def key_of(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    target = min(epochs * size, level * weight): the level at which the targets sum to the
    share. With sources ordered by their bound over weight, those below the level are a prefix.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("bound", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("bound") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c, win: F.coalesce(F.sum(c).over(win), F.lit(0.0))
    s = s.withColumn("total", over(F.col("source_size").cast("double"), every) * share).withColumn("w_all", over(F.col("w"), every))
    s = s.withColumn("level_here", (F.col("total") - over(F.col("bound"), before)) / (F.col("w_all") - over(F.col("w"), before)))
    level = F.coalesce(F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(every)["level_here"], F.max("ratio").over(every))
    return s.select("source", "source_size", F.least(F.col("bound"), level * F.col("w")).alias("target"))


def cuts(rows: DataFrame, n: int, **how) -> DataFrame:
    """(source, source_size, target, epochs, rest, cut, here, unit) from rows (source, size, key).

    epochs whole passes are taken, then all documents with a key below cut; the documents at the cut share `here` of their `unit` words.
    """
    spark = rows.sparkSession
    ranges = max(1, math.isqrt(n))
    width = ((1 << KEY_BITS) - 1) // ranges + 1
    cell = F.expr(f"`key` div {width}L")
    sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("b"))
    by_source = sums.groupBy("source").agg(F.sum("b").cast("bigint").alias("source_size"))
    whole, rest = F.floor(F.col("target")).cast("bigint"), F.col("source_size")
    goal = targets(by_source, **how).withColumn("epochs", F.when(rest > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("int"))
    goal = goal.withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    small, path = written(goal, "mix_targets")
    up_to = lambda *order: Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, *order: F.coalesce(F.sum(c).over(up_to(*order)), F.lit(0)).cast("bigint")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    lined = sums.withColumn("before_cell", before("b", "cell"))
    a, g = lined.alias("a"), small.select("source", "rest").alias("g")
    at = a.join(g, F.col("a.source").eqNullSafe(F.col("g.source"))).where("before_cell <= rest AND rest < before_cell + b").select(F.col("a.source").alias("source"), "cell", "before_cell", "rest")
    r = rows.withColumn("cell", cell).alias("r")
    c = at.alias("c")
    inside = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell"))).select(F.col("r.source").alias("source"), "key", "size", "before_cell", "rest")
    unit = inside.groupBy("source", "key", "before_cell", "rest").agg(F.sum("size").cast("bigint").alias("unit"))
    unit = unit.withColumn("ahead", F.col("before_cell") + before("unit", "key")).where("ahead <= rest AND rest < ahead + unit")
    found = unit.select(F.col("source"), F.col("key").alias("cut"), (F.col("rest") - F.col("ahead")).alias("here"), "unit")
    x, y = small.alias("x"), found.alias("y")
    out = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")), "left").select("x.*", "cut", "here", "unit")
    out, _ = written(out, "mix_cuts")
    remove(spark, path)
    return out


def with_cuts(rows: DataFrame, cut: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with the given columns of their source's cut. The few cuts are broadcast, if counted to be few."""
    names = {c: fresh(rows.columns, f"__{c}") for c in ("source", *columns)}
    c = cut.select(*(F.col(k).alias(v) for k, v in names.items()))
    if cut.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(c), rows["source"].eqNullSafe(c[names["source"]]), "left").drop(names["source"])
    salt = fresh(rows.columns, "__salt")
    a = rows.withColumn(salt, F.floor(F.rand(7) * SALTS).cast("int"))
    b = c.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, (a["source"].eqNullSafe(b[names["source"]])) & (a[salt] == b["__at"]), "left").drop(salt, "__at", names["source"])


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))


def plan(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row of docs."""
    rows, _ = written(sized(docs, seed), "mix_sizes")
    cut = cuts(rows.drop("doc_id"), rows.count(), **how)
    j = with_cuts(rows, cut, ("source_size", "target", "epochs", "cut", "here", "unit"))
    last = F.when(F.col("key") < F.col("__cut"), F.col("size")).when(F.col("key") == F.col("__cut"), F.expr("__here * size div __unit")).otherwise(F.lit(0))
    return j.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__epochs") * F.col("size") + last).cast("bigint").alias("taken"), "source"
    )


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mixed documents, columns as in docs: a row for each time a document is taken, the one at the cut shortened to its share. Documents without words aren't taken."""
    rows, path = written(sized(docs, seed), "mix_sizes")
    cut = cuts(rows.drop("doc_id"), rows.count(), **how)
    remove(docs.sparkSession, path)
    k, e, c, h, u = (fresh(docs.columns, f"__{x}") for x in ("key", "epochs", "cut", "here", "unit"))
    n, part, copy = (fresh(docs.columns, f"__{x}") for x in ("n", "part", "copy"))
    j = with_cuts(docs.withColumn(k, key_of(F.col("doc_id"), seed)), cut, ("epochs", "cut", "here", "unit"))
    j = j.withColumn(part, F.when(F.col(k) == F.col(c), F.expr(f"`{h}` * {_size_sql()} div `{u}`")).otherwise(F.lit(0)))
    has = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    j = j.where(has).withColumn(n, F.col(e) + (F.coalesce(F.col(k) < F.col(c), F.lit(False)) | (F.col(part) > 0)).cast("int")).where(F.col(n) > 0)
    j = j.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    text = F.when((F.col(part) > 0) & (F.col(copy) == F.col(n)), first_words(F.col("text"), F.col(part))).otherwise(F.col("text"))
    return j.withColumn("text", text).select(*(F.col(f"`{x}`") for x in docs.columns))


def _size_sql() -> str:
    return "coalesce(size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')), 0)"


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w FROM s),
b AS (SELECT *, source_size * 2.0::DOUBLE AS bound, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 FROM w) - coalesce(sum(bound) OVER o, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0)) AS here
      FROM b WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(bound, w * coalesce((SELECT arg_min(here, ratio) FROM l WHERE here <= ratio), (SELECT max(ratio) FROM l))) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM e),
u AS (SELECT source, key, sum(size) AS unit, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d GROUP BY 1, 2)
SELECT doc_id, d.size, source_size, target, CAST(epochs * d.size + CASE WHEN unit = 0 THEN 0 ELSE least(greatest(rest - ahead, 0), unit) * d.size // unit END AS BIGINT) AS taken, d.source
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.key = d.key
"""
