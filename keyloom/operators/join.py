"""The inner equi-join of two relations and its result modes.

Every strategy gives the same rows; it only decides the physical plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.bits import MASK32, wrap32
from keyloom.operators.radix import BUCKET_ROWS, CHAIN_BUCKETS, histogram, radix_partition
from keyloom.operators.radix import chained as cut_chains
from keyloom.plans.schedule import batches_for
from keyloom.plans.strategy import checked_hint, choose_strategy

Joined = Callable[[DataFrame, DataFrame], DataFrame]


def _sides(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = r.select("key", *(F.col(c).alias(f"r_{c}") for c in r.columns if c != "key"))
    b = s.select("key", *(F.col(c).alias(f"s_{c}") for c in s.columns if c != "key"))
    return a, b


def hinted(hint: str) -> Joined:
    def run(r: DataFrame, s: DataFrame) -> DataFrame:
        a, b = _sides(r, s)
        return b.join(checked_hint(a, hint), "key")

    return run


def auto(r: DataFrame, s: DataFrame) -> DataFrame:
    """Left to Catalyst and adaptive execution."""
    a, b = _sides(r, s)
    return b.join(a, "key")


def nested_loop(r: DataFrame, s: DataFrame) -> DataFrame:
    """Cartesian product and filter; for sides that are small by their nature only."""
    a, b = _sides(r, s)
    return b.hint("shuffle_replicate_nl").join(a.hint("shuffle_replicate_nl"), "key")


def persisted(level: StorageLevel) -> Joined:
    """Both sides kept at a storage level first. The caller unpersists, or the cleaner does once they are unreachable."""

    def run(r: DataFrame, s: DataFrame) -> DataFrame:
        return auto(r.persist(level), s.persist(level))

    return run


def radix_joined(bits: tuple[int, int] = (3, 3)) -> Joined:
    """Both sides dealt by the radix digits of the key, joined on (pid, key) without a further exchange."""

    def run(r: DataFrame, s: DataFrame) -> DataFrame:
        a, b = (radix_partition(x, "key", bits) for x in _sides(r, s))
        return b.join(a.hint("shuffle_hash"), ["pid", "key"]).drop("pid")

    return run


def csr(r: DataFrame, s: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """Build side gathered into lists for each hash, probe side scanning them: the histogram-and-offset table.

    A bucket's list is cut into up to 64 by a hash of the row.
    """
    a, b = _sides(r, s)
    h = lambda c: F.pmod(F.hash(c), F.lit(buckets))
    cols = [c for c in a.columns]
    table = a.groupBy(h(F.col("key")).alias("__h"), F.pmod(F.xxhash64(*cols), F.lit(64)).alias("__slice")).agg(F.collect_list(F.struct(*cols)).alias("__list"))
    hit = b.withColumn("__h", h(F.col("key"))).join(table, "__h").select(*b.columns, F.explode("__list").alias("__e"))
    return hit.where(F.col("__e.key") == F.col("key")).select(*b.columns, *(F.col(f"__e.{c}") for c in cols if c != "key"))


STRATEGIES: dict[str, Joined] = {
    "auto": auto,
    "broadcast": hinted("broadcast"),
    "shuffle_hash": hinted("shuffle_hash"),
    "merge": hinted("merge"),
    "nested_loop": nested_loop,
    "persisted_memory": persisted(StorageLevel.MEMORY_AND_DISK),
    "persisted_disk": persisted(StorageLevel.DISK_ONLY),
    "radix": radix_joined(),
    "csr": csr,
}

#: Strategies of the size-based chooser.
BY_SIZE = {"in_memory": "shuffle_hash", "streaming_probe": "auto", "co_processing": "merge"}


def join(r: DataFrame, s: DataFrame, strategy: str = "auto") -> DataFrame:
    """(key, s_*, r_*) of all matching pairs; bag semantics."""
    return STRATEGIES[strategy](r, s)


def join_by_size(r: DataFrame, s: DataFrame) -> DataFrame:
    """The strategy picked by the counted sizes of both sides."""
    return join(r, s, BY_SIZE[choose_strategy(r.count(), s.count())])


def product() -> Column:
    return F.col("r_payload").cast("bigint") * F.col("s_payload").cast("bigint")


def match_count(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("matches"))


def sum_product(joined: DataFrame, wrap: bool = False) -> DataFrame:
    """The sum of payload products: BIGINT, or wrapped to 32 bits."""
    total = F.coalesce(F.sum(product()), F.lit(0)).cast("bigint")
    return joined.agg((wrap32(total) if wrap else total).alias("agg"))


def materialize(joined: DataFrame) -> DataFrame:
    return joined.select("r_payload", "s_payload")


def wide_sum(joined: DataFrame, columns: list[str]) -> DataFrame:
    """The sum of wide payload columns of both sides over all matches."""
    one = sum((F.col(c).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return joined.agg(F.coalesce(F.sum(one), F.lit(0)).cast("bigint").alias("agg"))


def late_materialized(r: DataFrame, s: DataFrame, r_id: str, s_id: list[str]) -> DataFrame:
    """Join on the narrow (key, id) columns, then fetch each side's wide columns by its row id. Ids must be distinct on each side."""
    narrow = r.select("key", r_id).join(s.select("key", *s_id), "key").select(r_id, *s_id)
    return narrow.join(r.drop("key"), r_id).join(s.drop("key"), s_id)


def perfect(r: DataFrame, s: DataFrame) -> DataFrame:
    """The dense-key join. Keys of r must be unique and not negative; checked first, in one aggregate.

    A build side within the broadcast bound is sent as a long-key table, which Spark keeps as an array for compact keys.
    """
    n, distinct, low = r.agg(F.count("key"), F.countDistinct("key"), F.min("key")).first()
    if n != distinct or (low is not None and low < 0):
        raise ValueError("the build side's keys are not unique and non-negative")
    return hinted("broadcast")(r, s)


def count_and_key_sum(joined: DataFrame) -> DataFrame:
    """(s, g): matches and the sum of their keys modulo 2^32."""
    g = F.coalesce(F.sum(F.col("key").cast("bigint")), F.lit(0)).cast("bigint").bitwiseAND(F.lit(MASK32))
    return joined.agg(F.count("*").alias("s"), g.alias("g"))


def partitioned_aggregate(joined: DataFrame, part: Column) -> DataFrame:
    return joined.groupBy(part.alias("part")).agg(F.count("*").alias("matches"), F.sum(product()).cast("bigint").alias("agg"))


def coprocess_counters(r: DataFrame, s: DataFrame, host_bits: int = 4, segments: int = 4) -> DataFrame:
    """(host_part, segment, matches); s has a dense position pos, a segment is |r| / segments positions long."""
    length = max(1, r.count() // segments)
    j = join(r, s, "merge")
    host = F.col("key").bitwiseAND(F.lit((1 << host_bits) - 1))
    return j.groupBy(host.alias("host_part"), F.expr(f"s_pos div {length}").alias("segment")).agg(F.count("*").alias("matches"))


def coprocess_batches(r: DataFrame, s: DataFrame, folder: str, host_bits: int = 4) -> DataFrame:
    """(batch, host_part, r_payload, s_payload): both sides are dealt to host partitions on storage, the partitions of r packed into resident batches, and batch by
    batch is joined and written. A batch reads its own partitions only; what is in memory at a time is a batch, however large the sides are.
    """
    spark = r.sparkSession
    host = F.col("key").bitwiseAND(F.lit((1 << host_bits) - 1))
    for name, side in (("r", r), ("s", s)):
        side.withColumn("host_part", host.cast("int")).write.partitionBy("host_part").parquet(f"{folder}/{name}")
    counts = {x["part"]: x["cnt"] for x in histogram(r, host).collect()}  # a row for each host partition
    unit = max(1, 1 + sum(counts.values()) // max(1, len(counts)))
    a, b = (spark.read.schema(f"{_schema(x)}, host_part INT").parquet(f"{folder}/{n}") for n, x in (("r", r), ("s", s)))
    for k, batch in enumerate(batches_for(counts, unit)):
        mine = F.col("host_part").isin([i.id for i in batch])
        left = a.where(mine).select("host_part", "key", F.col("payload").alias("r_payload"))
        right = b.where(mine).select("host_part", "key", F.col("payload").alias("s_payload"))
        right.join(left.hint("merge"), ["host_part", "key"]).select("host_part", "r_payload", "s_payload").write.parquet(f"{folder}/out/batch={k}")
    if not counts:
        return r.limit(0).select(F.lit(0).alias("batch"), host.cast("int").alias("host_part"), F.col("payload").alias("r_payload"), F.col("payload").alias("s_payload"))
    return spark.read.parquet(f"{folder}/out")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def chained(r: DataFrame, s: DataFrame, rows: int = BUCKET_ROWS * CHAIN_BUCKETS) -> DataFrame:
    """The join of a skewed probe side s: keys of more than `rows` rows are cut into sub-chains, and each is a task's work of its own."""
    a, b = _sides(r, s)
    big, small, on = cut_chains(b, a, "key", rows)
    return big.join(small.hint("merge"), on).drop("__chain")


def counter_totals(counters: DataFrame) -> DataFrame:
    m = F.col("matches")
    return counters.agg(F.sum(m).cast("bigint").alias("total"), F.min(m).alias("least"), F.max(m).alias("most"))


def segment_counters(r: DataFrame, s: DataFrame, segments: int = 4) -> DataFrame:
    """(segment, matches, slots): the probe side in segments against a resident build side; a match fills two output slots."""
    length = max(1, r.count() // segments)
    j = join(r, s, "shuffle_hash")
    n = F.count("*")
    return j.groupBy(F.expr(f"s_pos div {length}").alias("segment")).agg(n.alias("matches"), (n * 2).alias("slots"))


def empty_relation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key INT, payload INT")
