"""Deterministic workload generators; every one takes its parameters and a seed, none keeps state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.bits import murmur32
from keyloom.operators.scan import exclusive_scan

LCG_MUL, LCG_MOD = 48271, 2147483647


def _pay(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("int").alias("key"), F.lit(1).alias("payload"))


def _draw(pos: Column, seed: int) -> Column:
    """Reproducible pseudo-random BIGINT in [0, 2^31-1); the same arithmetic in any engine."""
    return (F.pmod(pos, F.lit(LCG_MOD)) * F.lit(LCG_MUL) + F.lit(seed)) % F.lit(LCG_MOD)


def unique(spark: SparkSession, n: int, maxid: int) -> DataFrame:
    """0, 1..maxid, 1..maxid, ... until n keys. Row order carries no meaning, so nothing is shuffled."""
    i = F.col("id")
    return _pay(spark.range(n).select(F.when(i == 0, 0).otherwise((i - 1) % maxid + 1).alias("key")))


def nonunique(spark: SparkSession, n: int, maxid: int, seed: int = 11) -> DataFrame:
    """n keys, uniform on [0, maxid), duplicates likely."""
    return _pay(spark.range(n).select((_draw(F.col("id"), seed) % maxid).alias("key")))


def fk_from_pk(pk: DataFrame, nfk: int, pos: str, key: str) -> DataFrame:
    """nfk foreign keys that repeat the primary keys in whole copies and a remainder; pos is pk's dense position."""
    npk = pk.count()
    if not npk:
        raise ValueError("the primary-key relation is empty")
    whole, rest = divmod(nfk, npk)
    copies = F.lit(whole) + (F.col(pos) < rest).cast("int")
    out = pk.where(copies > 0).select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return out.select(F.col("key"), F.lit(1).alias("payload"))


def replicate(df: DataFrame, k: int) -> DataFrame:
    """k copies of df, made in place: no join, no shuffle."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("__copy")


def initialise(spark: SparkSession, n: int, kind: str, maxid: int = 1, seed: int = 11) -> DataFrame:
    """(pos, v): kind is seq, uniform, zero, int100 (1..100) or float256 (0..255 tenths)."""
    i = F.col("id")
    v = {
        "seq": i,
        "uniform": _draw(i, seed) % maxid,
        "zero": F.lit(0).cast("bigint"),
        "int100": _draw(i, seed) % 100 + 1,
        "float256": (_draw(i, seed) % 256) / 10.0,
    }[kind]
    return spark.range(n).select(i.alias("pos"), v.alias("v"))


def zipf_weight(k: Column, scale: int, theta: float) -> Column:
    """The whole weight scale / k^theta of a rank; theta is any number from 0 on. A rank whose weight would be below one gets one: none is lost."""
    share = F.lit(float(scale)) / F.pow(k.cast("double"), F.lit(float(theta)))
    return F.greatest(F.floor(share).cast("bigint"), F.lit(1).cast("bigint"))


def zipf_total(ranks: DataFrame, scale: int = 1_000_000, theta: float = 1.0) -> int:
    """The sum of all weights, in one aggregate."""
    return ranks.agg(F.sum(zipf_weight(F.col("k"), scale, theta))).first()[0] or 0


def zipf_cdf(ranks: DataFrame, scale: int = 1_000_000, theta: float = 1.0) -> DataFrame:
    """(k, lo, hi) of the weights of ranks (k BIGINT from 1). The scale sets how finely weights are told apart."""
    w = ranks.select(F.col("k"), zipf_weight(F.col("k"), scale, theta).alias("w"))
    return exclusive_scan(w, "k", "w").select(F.col("pos").alias("k"), F.col("scan").alias("lo"), (F.col("scan") + F.col("v")).alias("hi"))


def spread(pos: Column, total: int, seed: int = 11) -> Column:
    """A draw for each position, uniform on 0..total-1 however large total is: the finalizer's 32 bits, scaled."""
    h = murmur32(pos + seed)
    return F.floor(h.cast("double") / F.lit(4294967296.0) * F.lit(float(total))).cast("bigint")


def permutation(spark: SparkSession, n: int, seed: int = 11) -> DataFrame:
    """(id, place): 0..n-1 and their places in a pseudo-random order, the rank by a 32-bit finalizer. Ranks are counted by ranges of it, never in one window."""
    h = spark.range(n).select("id", murmur32(F.col("id") + seed).alias("h"))
    # 2^32 values in ranges of about 1,024 rows each; ties go by id
    width = max(1, (1 << 42) // max(n, 1))
    cut = h.withColumn("__r", F.expr(f"h div {width}L"))
    base = exclusive_scan(cut.groupBy("__r").agg(F.count("*").alias("c")), "__r", "c").select(F.col("pos").alias("__r"), F.col("scan").alias("base"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy("h", "id"))
    return cut.withColumn("k", rank.cast("bigint")).join(base, "__r").select("id", (F.col("base") + F.col("k") - 1).alias("place"))


def zipf(draws: DataFrame, cdf: DataFrame, total: int, cells: int = 4096) -> DataFrame:
    """draws (id, u) mapped to the rank k whose [lo, hi) holds u; total: the sum of all weights, the greatest hi.

    A range join: the value axis is cut into equal cells, each interval is listed
    under the cells it touches (at most ranks + cells rows) and the draws meet it
    by an equi-join on the cell.
    """
    width = max(1, -(-total // cells))
    spread_ = cdf.select("k", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    d = draws.withColumn("cell", F.expr(f"u div {width}"))
    return d.join(spread_, "cell").where("u >= lo AND u < hi").select("id", "k")


#: The forms of file names.
FILE_NAMES = {"unique": "unique_{n}.bin", "pk": "pk_R{n}.bin", "fk": "fk_S{n}_pk_R{m}.bin", "nonunique_r": "nonUnique_R{n}.bin", "nonunique_s": "nonUnique_S{n}.bin"}


def file_name(kind: str, n: int, other: int | None = None) -> str:
    """The name under which a generated relation is kept: it tells kind and sizes, so that another size is another file."""
    if kind not in FILE_NAMES or (kind == "fk" and other is None):
        raise ValueError(f"{kind} {n} {other}: no such relation")
    return FILE_NAMES[kind].format(n=n, m=other)
