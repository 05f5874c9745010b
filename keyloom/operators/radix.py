"""Radix partitioning: digits, histograms, fixed-size buckets and sub-chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.bits import digit
from keyloom.operators.scan import exclusive_scan

#: Default bits of the first and second pass, rows of a bucket, buckets of a sub-chain.
RADIX_BITS, BUCKET_ROWS, CHAIN_BUCKETS = (8, 5), 4096, 2
#: Rows of a table of hot keys up to which it is broadcast.
BROADCAST_KEYS = 1_000_000


def pass_one(key: Column, bits: tuple[int, int] = RADIX_BITS) -> Column:
    return digit(key, bits[1], bits[0])


def pass_two(key: Column, bits: tuple[int, int] = RADIX_BITS) -> Column:
    """The final partition id: the first pass's digit, refined by the low bits."""
    return F.shiftleft(pass_one(key, bits), bits[1]).bitwiseOR(digit(key, 0, bits[1]))


def radix_partition(df: DataFrame, key: str = "key", bits: tuple[int, int] = RADIX_BITS) -> DataFrame:
    """df with its partition id pid, dealt by it; a later join on (pid, key) needs no further exchange."""
    return df.withColumn("pid", pass_two(F.col(key), bits)).repartition(1 << sum(bits), "pid")


def histogram(df: DataFrame, part: Column, name: str = "part", count: str = "cnt") -> DataFrame:
    """Rows of each partition: combined before the shuffle, so a hot digit costs one row a task."""
    return df.groupBy(part.alias(name)).agg(F.count("*").alias(count))


def bucket_info(df: DataFrame, part: Column, bucket_rows: int = BUCKET_ROWS, number: str = "bucket_no", rows: str = "rows") -> DataFrame:
    """(part, number, rows) of the fixed-size buckets that hold each partition.

    Worked out from the histogram: which row lies in which bucket has no meaning,
    so no window over the rows is needed and a hot partition costs nothing.
    """
    h = histogram(df, part, count="n")
    last = F.expr(f"(n - 1) div {bucket_rows}")
    cut = h.select("part", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(number))
    return cut.select("part", number, F.least(F.lit(bucket_rows).cast("bigint"), F.col("n") - F.col(number) * bucket_rows).alias(rows))


def decompose_chains(df: DataFrame, part: Column, bucket_rows: int = BUCKET_ROWS, buckets: int = CHAIN_BUCKETS) -> DataFrame:
    """Sub-chains of at most `buckets` buckets: the unit that a skewed partition is split into."""
    return bucket_info(df, part, bucket_rows * buckets, "chain_no", "len")


def histogram_offsets(df: DataFrame, part: Column, align: int = 32) -> DataFrame:
    """(digit, cnt, start_off, start_aligned): exclusive prefixes of the counts, plain and rounded up to `align` rows."""
    h = histogram(df, part, "digit")
    a = exclusive_scan(h, "digit", "cnt")
    up = F.expr(f"((cnt + {align - 1}) div {align}) * {align}")
    b = exclusive_scan(h.withColumn("up", up), "digit", "up")
    return a.select(F.col("pos").alias("digit"), F.col("v").alias("cnt"), F.col("scan").alias("start_off")).join(
        b.select(F.col("pos").alias("digit"), F.col("scan").alias("start_aligned")), "digit"
    )


def salted(big: DataFrame, small: DataFrame, key: str, salts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt: a hot key of `big` is spread over `salts` tasks, `small` is repeated for each. Returns the join columns too."""
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a, b, [key, "__salt"]


def chained(big: DataFrame, small: DataFrame, key: str = "key", rows: int = BUCKET_ROWS * CHAIN_BUCKETS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides cut by sub-chains: a key with more than `rows` rows in `big` goes to as many tasks as it has sub-chains, and its rows
    of `small` are repeated for each. Other keys have one sub-chain and are not repeated. Returns the join columns too.

    Keys of several sub-chains are fewer than the rows of `big` by the factor `rows`; their table is broadcast if its
    size allows, counted, and joined by sorting beyond that.
    """
    info = histogram(big, F.col(key), "__key", "__n").where(F.col("__n") > rows)
    chains = info.select("__key", F.expr(f"cast((__n + {rows - 1}) div {rows} as int)").alias("__chains")).persist()
    few = F.broadcast(chains) if chains.count() <= BROADCAST_KEYS else chains.hint("merge")
    n = F.coalesce("__chains", F.lit(1))
    # by a hash of the whole row, which a task that runs again finds the same
    a = big.join(few, F.col(key) == F.col("__key"), "left").withColumn("__chain", F.pmod(F.xxhash64(*big.columns), n).cast("int")).drop("__key", "__chains")
    b = small.join(few, F.col(key) == F.col("__key"), "left").withColumn("__chain", F.explode(F.sequence(F.lit(0), n - 1))).drop("__key", "__chains")
    return a, b, [key, "__chain"]
