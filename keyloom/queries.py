"""The query catalogue: each entry has a Spark plan here and an SQL text for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import bits
from keyloom.operators import join as J
from keyloom.operators import movement, radix, reduce, scan
from keyloom.plans import schedule
from keyloom.sources import generators as G
from keyloom.sources.relations import read_raw, relation, table, write_raw
from keyloom.streaming.probe import shared_folder, stream_materialize, stream_probe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

OL = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
SUM_PRODUCT = f"SELECT CAST(sum(o_custkey * l_suppkey) AS BIGINT) AS agg {OL}"


def _wrap(x: str) -> str:
    return f"CAST(((({x} + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 AS INTEGER)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _o(spark, d):
    return relation(table(spark, d, "orders"), "o_orderkey", "o_custkey")


def _l(spark, d):
    return relation(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def _lp(spark, d):
    return relation(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


def _cust_orders(spark, d):
    c = relation(table(spark, d, "customer"), "c_custkey")
    return c, relation(table(spark, d, "orders"), "o_custkey", pos="o_orderkey")


@query("q01_join_count", f"SELECT count(*) AS matches {OL}")
def q01(spark, d):
    return J.match_count(J.join(_o(spark, d), _l(spark, d)))


@query("q02_join_sum_product", SUM_PRODUCT)
def q02(spark, d):
    return J.sum_product(J.join(_o(spark, d), _l(spark, d)))


@query("q03_join_sum_product_wrap32", f"SELECT {_wrap('CAST(sum(o_custkey * l_suppkey) AS BIGINT)')} AS agg {OL}")
def q03(spark, d):
    return J.sum_product(J.join(_o(spark, d), _l(spark, d)), wrap=True)


@query("q04_join_materialize", f"SELECT o_custkey AS r_payload, l_suppkey AS s_payload {OL}")
def q04(spark, d):
    return J.materialize(J.join(_o(spark, d), _l(spark, d)))


WIDE = f"SELECT CAST(sum(o_custkey + l_partkey + l_suppkey + l_linenumber) AS BIGINT) AS agg {OL}"


@query("q05_wide_payload", WIDE)
def q05(spark, d):
    o = relation(table(spark, d, "orders"), "o_orderkey", d0="o_custkey")
    li = relation(table(spark, d, "lineitem"), "l_orderkey", d0="l_partkey", d1="l_suppkey", d2="l_linenumber")
    return J.wide_sum(J.join(o, li), ["r_d0", "s_d0", "s_d1", "s_d2"])


@query("q05b_late_materialize", WIDE)
def q05b(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("rid"), "o_custkey")
    # (l_orderkey, l_linenumber) repeats in these data; a row's file and place in it do not, and both reads of the table agree on them.
    place = [F.col("_metadata.file_path").alias("s_file"), F.col("_metadata.row_index").alias("s_row")]
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), *place, "l_partkey", "l_suppkey", "l_linenumber")
    return J.wide_sum(J.late_materialized(o, li, "rid", ["s_file", "s_row"]), ["o_custkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("q06_perfect_hash", "SELECT CAST(sum(p_size * l_suppkey) AS BIGINT) AS agg FROM part JOIN lineitem ON p_partkey = l_partkey")
def q06(spark, d):
    return J.sum_product(J.perfect(relation(table(spark, d, "part"), "p_partkey", "p_size"), _lp(spark, d)))


@query("q06b_perfect_wide", "SELECT CAST(sum(p_size + l_suppkey + l_linenumber) AS BIGINT) AS agg FROM part JOIN lineitem ON p_partkey = l_partkey")
def q06b(spark, d):
    p = relation(table(spark, d, "part"), "p_partkey", d0="p_size")
    li = relation(table(spark, d, "lineitem"), "l_partkey", d0="l_suppkey", d1="l_linenumber")
    return J.wide_sum(J.perfect(p, li), ["r_d0", "s_d0", "s_d1"])


@query(
    "q07_many_to_many",
    "SELECT count(*) AS matches, CAST(sum(a.l_suppkey * b.l_suppkey) AS BIGINT) AS agg FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey",
)
def q07(spark, d):
    j = J.join(_lp(spark, d), _lp(spark, d), "shuffle_hash")
    return j.agg(F.count("*").alias("matches"), F.sum(J.product()).cast("bigint").alias("agg"))


@query(
    "q07b_many_to_many_preaggregated",
    "SELECT count(*) AS matches, CAST(sum(a.l_suppkey * b.l_suppkey) AS BIGINT) AS agg FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey",
)
def q07b(spark, d):
    """The same sums without making the pairs: counts and payload sums of each key, multiplied."""
    s = _lp(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.sum("payload").alias("v"))
    return s.agg(F.sum(F.col("n") * F.col("n")).alias("matches"), F.sum(F.col("v") * F.col("v")).cast("bigint").alias("agg"))


def _strategy(name: str) -> Query:
    return lambda spark, d: J.sum_product(J.join(_o(spark, d), _l(spark, d), name))


for _n, _s in (("a", "broadcast"), ("b", "shuffle_hash"), ("c", "merge"), ("e", "persisted_memory"), ("f", "persisted_disk"), ("g", "radix")):
    query(f"q08{_n}_{_s}", SUM_PRODUCT)(_strategy(_s))


@query("q08d_nested_loop", "SELECT count(*) AS matches, CAST(sum(r_regionkey * n_nationkey) AS BIGINT) AS agg FROM region JOIN nation ON r_regionkey = n_regionkey")
def q08d(spark, d):
    r = relation(table(spark, d, "region"), "r_regionkey", "r_regionkey")
    j = J.join(r, relation(table(spark, d, "nation"), "n_regionkey", "n_nationkey"), "nested_loop")
    return j.agg(F.count("*").alias("matches"), F.sum(J.product()).cast("bigint").alias("agg"))


@query("q09_radix_pass_one", "SELECT (l_orderkey >> 5) & 255 AS part, count(*) AS cnt FROM lineitem GROUP BY 1")
def q09(spark, d):
    return radix.histogram(table(spark, d, "lineitem"), radix.pass_one(F.col("l_orderkey")))


@query("q10_radix_two_pass", "SELECT ((((l_orderkey >> 5) & 255) << 5) + (l_orderkey & 31)) AS part, count(*) AS cnt FROM lineitem GROUP BY 1")
def q10(spark, d):
    return radix.histogram(table(spark, d, "lineitem"), radix.pass_two(F.col("l_orderkey")))


def _cut(rows: int, number: str, size: str) -> str:
    return (
        "WITH h AS (SELECT l_orderkey & 63 AS part, count(*) AS n FROM lineitem GROUP BY 1) "
        f"SELECT part, b AS {number}, least({rows}, n - {rows} * b) AS {size} FROM h, unnest(range((n + {rows - 1}) // {rows})) AS u(b)"
    )


@query("q11_bucket_info", _cut(16, "bucket_no", "rows"))
def q11(spark, d):
    return radix.bucket_info(table(spark, d, "lineitem"), bits.digit(F.col("l_orderkey"), 0, 6), 16)


@query("q12_decompose_chains", _cut(32, "chain_no", "len"))
def q12(spark, d):
    return radix.decompose_chains(table(spark, d, "lineitem"), bits.digit(F.col("l_orderkey"), 0, 6), 16, 2)


@query("q13_partitioned_join", f"SELECT l_orderkey & 63 AS part, count(*) AS matches, CAST(sum(o_custkey * l_suppkey) AS BIGINT) AS agg {OL} GROUP BY 1")
def q13(spark, d):
    return J.partitioned_aggregate(J.join(_o(spark, d), _l(spark, d)), bits.digit(F.col("key"), 0, 6))


COPROCESS = (
    "SELECT o_custkey & 15 AS host_part, o_orderkey // ((SELECT count(*) FROM customer) // 4) AS segment, count(*) AS matches "
    "FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2"
)


@query("q14_coprocess_counters", COPROCESS)
def q14(spark, d):
    return J.coprocess_counters(*_cust_orders(spark, d))


@query("q14b_coprocess_totals", f"WITH c AS ({COPROCESS}) SELECT CAST(sum(matches) AS BIGINT) AS total, min(matches) AS least, max(matches) AS most FROM c")
def q14b(spark, d):
    return J.counter_totals(q14(spark, d))


@query(
    "q14c_coprocess_batches",
    "SELECT CAST(o_custkey & 15 AS INTEGER) AS host_part, count(*) AS matches, CAST(sum(c_nationkey * o_orderkey) AS BIGINT) AS agg FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def q14c(spark, d):
    """Co-processing as it runs: host partitions on storage, packed into batches, joined batch by batch."""
    c = relation(table(spark, d, "customer"), "c_custkey", "c_nationkey")
    j = J.coprocess_batches(c, relation(table(spark, d, "orders"), "o_custkey", "o_orderkey"), shared_folder(spark, "coprocess"))
    return j.groupBy("host_part").agg(F.count("*").alias("matches"), F.sum(J.product()).cast("bigint").alias("agg"))


@query(
    "q15_segment_probe",
    "SELECT o_orderkey // ((SELECT count(*) FROM customer) // 4) AS segment, count(*) AS matches, 2 * count(*) AS slots "
    "FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def q15(spark, d):
    return J.segment_counters(*_cust_orders(spark, d))


@query("q15s_stream_probe", f"SELECT count(*) AS matches, CAST(sum(o_custkey * l_suppkey) AS BIGINT) AS agg {OL}")
def q15s(spark, d):
    schema = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").schema
    return stream_probe(spark, _o(spark, d), f"{d}/lineitem.parquet", schema, "l_orderkey", "l_suppkey")


@query("q15m_stream_materialize", f"SELECT o_custkey AS r_payload, l_suppkey AS s_payload {OL}")
def q15m(spark, d):
    """Every match, written segment by segment by the streaming probe."""
    schema = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").schema
    return stream_materialize(spark, _o(spark, d), f"{d}/lineitem.parquet", schema, "l_orderkey", "l_suppkey", shared_folder(spark, "segments")).drop("segment")


@query("q16_cpu_join", f"SELECT count(*) AS s, CAST(sum(l_orderkey) AS BIGINT) % 4294967296 AS g {OL}")
def q16(spark, d):
    return J.count_and_key_sum(J.join(_o(spark, d), _l(spark, d)))


@query("q16b_join_by_size", SUM_PRODUCT)
def q16b(spark, d):
    return J.sum_product(J.join_by_size(_o(spark, d), _l(spark, d)))


def _scan_sql(frame: str, by: str = "") -> str:
    return f"SELECT o_orderkey AS pos, CAST(coalesce(sum(o_custkey) OVER ({by}ORDER BY o_orderkey ROWS BETWEEN {frame}), 0) AS BIGINT) AS scan FROM orders"


@query("q17a_exclusive_prefix", _scan_sql("UNBOUNDED PRECEDING AND 1 PRECEDING"))
def q17a(spark, d):
    return scan.exclusive_scan(table(spark, d, "orders"), "o_orderkey", "o_custkey").select("pos", "scan")


@query("q17b_exclusive_suffix", _scan_sql("1 FOLLOWING AND UNBOUNDED FOLLOWING"))
def q17b(spark, d):
    return scan.exclusive_scan(table(spark, d, "orders"), "o_orderkey", "o_custkey", suffix=True).select("pos", "scan")


@query("q17c_segmented_scan", _scan_sql("UNBOUNDED PRECEDING AND 1 PRECEDING", "PARTITION BY o_orderkey // 1024 ").replace("SELECT ", "SELECT o_orderkey // 1024 AS segment, ", 1))
def q17c(spark, d):
    return scan.segmented_scan(table(spark, d, "orders"), "o_orderkey", "o_custkey", F.expr("o_orderkey div 1024"))


@query(
    "q17e_bordered_scan",
    "WITH b AS (SELECT o_orderkey AS pos, o_custkey AS v, CAST(sum(CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS BIGINT) AS segment FROM orders) "
    "SELECT segment, pos, CAST(coalesce(sum(v) OVER (PARTITION BY segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM b",
)
def q17e(spark, d):
    """Segments by a table of borders of no regular distance."""
    o = table(spark, d, "orders")
    return scan.bordered_scan(o, "o_orderkey", "o_custkey", o.where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("border")))


@query("q17f_interleaved_scan", _scan_sql("UNBOUNDED PRECEDING AND 1 PRECEDING", "PARTITION BY o_orderkey // 1024, o_orderkey % 3 ").replace("SELECT ", "SELECT o_orderkey // 1024 AS block, o_orderkey % 3 AS range, ", 1))
def q17f(spark, d):
    return scan.interleaved_scan(table(spark, d, "orders"), "o_orderkey", "o_custkey", 3)


@query(
    "q17d_two_level_scan",
    "WITH b AS (SELECT o_orderkey // 1024 AS block, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1) "
    "SELECT block, total, CAST(coalesce(sum(total) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM b",
)
def q17d(spark, d):
    return scan.block_bases(table(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("q18_aggregate_func", "SELECT 1 AS func_id, min(l_partkey) AS res FROM lineitem UNION ALL SELECT 2, max(l_partkey) FROM lineitem UNION ALL SELECT 3, CAST(sum(l_partkey) AS BIGINT) FROM lineitem")
def q18(spark, d):
    return reduce.aggregate_all(table(spark, d, "lineitem"), "l_partkey")


@query("q19_scatter", "SELECT (SELECT count(*) FROM orders) - 1 - o_orderkey AS idx, o_custkey AS v FROM orders")
def q19(spark, d):
    o = table(spark, d, "orders")
    return movement.scatter(o, "o_custkey", F.lit(o.count() - 1) - F.col("o_orderkey"))


@query("q19b_copy", "SELECT o_orderkey, o_custkey FROM orders")
def q19b(spark, d):
    return movement.copy(table(spark, d, "orders").select("o_orderkey", "o_custkey"))


@query("q20_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def q20(spark, d):
    return scan.row_ids(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("q21a_popcount32", "SELECT event_id, CAST(bit_count((event_id - 5000) & 4294967295) AS BIGINT) AS r FROM events")
def q21a(spark, d):
    return table(spark, d, "events").select("event_id", bits.popcount32(F.col("event_id") - 5000).alias("r"))


@query("q21b_next_pow2", "SELECT event_id, CAST(CASE WHEN event_id <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(ltrim(bin(event_id - 1), '0')) END AS BIGINT) AS r FROM events")
def q21b(spark, d):
    return table(spark, d, "events").select("event_id", bits.next_pow2(F.col("event_id")).alias("r"))


@query("q21c_lower_pow2", "SELECT event_id, CAST(CASE WHEN event_id <= 1 THEN 0 ELSE CAST(1 AS BIGINT) << (length(ltrim(bin(event_id - 1), '0')) - 1) END AS BIGINT) AS r FROM events")
def q21c(spark, d):
    return table(spark, d, "events").select("event_id", bits.lower_pow2(F.col("event_id")).alias("r"))


@query("q21d_ctz", "SELECT event_id, CAST(CASE WHEN event_id = 0 THEN 32 ELSE bit_count((event_id & -event_id) - 1) END AS BIGINT) AS r FROM events")
def q21d(spark, d):
    return table(spark, d, "events").select("event_id", bits.ctz32(F.col("event_id")).alias("r"))


@query(
    "q21e_murmur",
    "WITH a AS (SELECT event_id, event_id & 4294967295 AS x FROM events), b AS (SELECT event_id, xor(x, x >> 16) AS x FROM a), "
    "c AS (SELECT event_id, CAST((CAST(x AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS x FROM b), e AS (SELECT event_id, xor(x, x >> 13) AS x FROM c), "
    "f AS (SELECT event_id, CAST((CAST(x AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS x FROM e) SELECT event_id, xor(x, x >> 16) & 1048575 AS r FROM f",
)
def q21e(spark, d):
    return table(spark, d, "events").select("event_id", bits.murmur_finalizer(F.col("event_id")).alias("r"))


@query("q23_sort_desc", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row_id FROM orders")
def q23(spark, d):
    ids = scan.row_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", descending=True)
    return ids.orderBy(F.col("o_orderkey").desc())


_ITEMS = (
    "h AS (SELECT o_custkey & 15 AS part, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT greatest(1, 1 + CAST(sum(n) AS BIGINT) // greatest(1, count(*))) AS unit FROM h), "
    "i AS (SELECT part, n, CASE WHEN n <= unit THEN 1 ELSE 2 END AS weight FROM h, u), "
    "sub AS (SELECT CAST([] AS BIGINT[]) AS ids, CAST(-1 AS BIGINT) AS last, 0 AS w, CAST(0 AS BIGINT) AS gain "
    "UNION ALL SELECT list_append(ids, part), part, w + weight, gain + n FROM sub JOIN i ON part > last AND w + weight <= 5)"
)


def _host_parts(spark, d) -> tuple[dict[int, int], int]:
    """Rows of the sixteen host partitions of orders, and the unit of weight."""
    h = radix.histogram(table(spark, d, "orders"), bits.digit(F.col("o_custkey"), 0, 4))
    counts = {r["part"]: r["cnt"] for r in h.collect()}  # 16 rows at most
    return counts, max(1, 1 + sum(counts.values()) // max(1, len(counts)))


def _batches(spark, batches) -> DataFrame:
    return spark.createDataFrame([(b, i.id, i.weight) for b, batch in enumerate(batches) for i in batch], "batch INT, part BIGINT, weight INT")


@query(
    "q24_pack_batches",
    f"WITH RECURSIVE {_ITEMS}, best AS (SELECT ids FROM sub ORDER BY gain DESC, len(ids), list_reverse(ids) LIMIT 1), "
    "rest AS (SELECT part, weight, row_number() OVER (PARTITION BY weight ORDER BY part) - 1 AS k FROM i, best WHERE NOT list_contains(ids, part)), "
    "heavy AS (SELECT count(*) AS m FROM rest WHERE weight = 2) "
    "SELECT 0 AS batch, part, weight FROM i, best WHERE list_contains(ids, part) UNION ALL SELECT CAST(1 + k AS INTEGER), part, weight FROM rest WHERE weight = 2 "
    "UNION ALL SELECT CAST(CASE WHEN k < 3 * m THEN 1 + k // 3 ELSE 1 + m + (k - 3 * m) // 5 END AS INTEGER), part, weight FROM rest, heavy WHERE weight = 1",
)
def q24(spark, d):
    """Sixteen host partitions of orders, packed into resident batches."""
    return _batches(spark, schedule.batches_for(*_host_parts(spark, d)))


@query(
    "q24b_pack_optimal",
    f"WITH RECURSIVE {_ITEMS}, packs AS (SELECT ids, row_number() OVER (ORDER BY gain DESC, len(ids), list_reverse(ids)) AS rank FROM sub WHERE len(ids) > 0), "
    "p AS (SELECT 0 AS batch, ids, ids AS used FROM packs WHERE rank = 1 UNION ALL SELECT batch + 1, next, list_concat(used, next) FROM "
    "(SELECT p.batch, p.used, arg_min(k.ids, k.rank) AS next FROM p JOIN packs k ON NOT list_has_any(k.ids, p.used) GROUP BY p.batch, p.used)) "
    "SELECT batch, part, weight FROM p JOIN i ON list_contains(p.ids, part)",
)
def q24b(spark, d):
    """The same partitions by repeated knapsacks."""
    counts, unit = _host_parts(spark, d)
    total = sum(counts.values()) or 1
    return _batches(spark, schedule.pack_optimal([schedule.Item(p, 1 if n <= unit else 2, n / total) for p, n in sorted(counts.items())]))


@query(
    "q25_histogram_offsets",
    "WITH h AS (SELECT l_orderkey & 15 AS digit, count(*) AS cnt FROM lineitem GROUP BY 1) SELECT digit, cnt, CAST(coalesce(sum(cnt) OVER w, 0) AS BIGINT) AS start_off, "
    "CAST(coalesce(sum(((cnt + 31) // 32) * 32) OVER w, 0) AS BIGINT) AS start_aligned FROM h WINDOW w AS (ORDER BY digit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def q25(spark, d):
    return radix.histogram_offsets(table(spark, d, "lineitem"), bits.digit(F.col("l_orderkey"), 0, 4))


query("q26_csr_probe", SUM_PRODUCT)(_strategy("csr"))


def _facts(r: DataFrame, s: DataFrame) -> DataFrame:
    """n_r, n_s, distinct keys of s, matches; the keys are counted on each side before they meet."""
    a = r.groupBy("key").agg(F.count("*").alias("n_r"))
    b = s.groupBy("key").agg(F.count("*").alias("n_s"))
    j = a.join(b, "key", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.agg(
        F.sum(z("n_r")).alias("n_r"), F.sum(z("n_s")).alias("n_s"), F.count(F.when(z("n_s") > 0, 1)).alias("distinct_s"), F.sum(z("n_r") * z("n_s")).alias("matches")
    )


FACTS = (
    "SELECT (SELECT count(*) FROM r) AS n_r, (SELECT count(*) FROM s) AS n_s, (SELECT count(DISTINCT key) FROM s) AS distinct_s, "
    "(SELECT count(*) FROM r JOIN s USING (key)) AS matches"
)
N_P, N_O = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM orders)"
UNIQUE_R = f"r AS (SELECT i AS key FROM range(0, {N_P}) t(i))"


def _counts(spark, d):
    return table(spark, d, "part").count(), table(spark, d, "orders").count()


@query("g1_unique", f"WITH {UNIQUE_R}, s AS (SELECT CASE WHEN i = 0 THEN 0 ELSE (i - 1) % {N_P} + 1 END AS key FROM range(0, {N_O}) t(i)) {FACTS}")
def g1(spark, d):
    p, o = _counts(spark, d)
    return _facts(G.unique(spark, p, p), G.unique(spark, o, p))


def _lcg(i: str) -> str:
    return f"((({i}) % 2147483647) * 48271 + 11) % 2147483647"


@query("g2_nonunique", f"WITH r AS (SELECT {_lcg('i')} % ({N_P} // 2) AS key FROM range(0, {N_P}) t(i)), s AS (SELECT {_lcg('i')} % ({N_P} // 2) AS key FROM range(0, {N_O}) t(i)) {FACTS}")
def g2(spark, d):
    p, o = _counts(spark, d)
    return _facts(G.nonunique(spark, p, p // 2), G.nonunique(spark, o, p // 2))


@query("g3_fk_from_pk", f"WITH r AS (SELECT p_partkey AS key FROM part), s AS (SELECT p_partkey AS key FROM range(0, {N_O}) t(i) JOIN part ON p_partkey = i % {N_P}) {FACTS}")
def g3(spark, d):
    part = table(spark, d, "part")
    r = relation(part, "p_partkey")
    return _facts(r, G.fk_from_pk(part, table(spark, d, "orders").count(), "p_partkey", "p_partkey"))


def _zipf_sql(theta: float, scale: int) -> str:
    """z (id, k): the events' draws by ranks of part; a draw is the finalizer's 32 bits of the position, scaled to the sum of weights."""
    x = lambda a, shift: f"xor({a}, {a} >> {shift})"
    mul = lambda a, c: f"CAST((CAST({a} AS HUGEINT) * {c}) % 4294967296 AS BIGINT)"
    return (
        f"w0 AS (SELECT p_partkey + 1 AS k, greatest(CAST(floor({scale}.0::DOUBLE / pow(CAST(p_partkey + 1 AS DOUBLE), {theta}::DOUBLE)) AS BIGINT), 1) AS wt FROM part), "
        "w AS (SELECT k, wt, CAST(sum(wt) OVER (ORDER BY k) AS BIGINT) AS hi FROM w0), tot AS (SELECT max(hi) AS t FROM w), "
        f"m0 AS (SELECT event_id, {x('((event_id + 11) & 4294967295)', 16)} AS h FROM events), m1 AS (SELECT event_id, {mul('h', 2246822507)} AS h FROM m0), m2 AS (SELECT event_id, {x('h', 13)} AS h FROM m1), "
        f"m3 AS (SELECT event_id, {mul('h', 3266489909)} AS h FROM m2), m4 AS (SELECT event_id, {x('h', 16)} AS h FROM m3), "
        "dr AS (SELECT event_id, CAST(floor(CAST(h AS DOUBLE) / 4294967296.0::DOUBLE * CAST(t AS DOUBLE)) AS BIGINT) AS u FROM m4, tot), "
        "z AS (SELECT event_id, k FROM dr JOIN w ON u < hi AND u >= hi - wt)"
    )


def _zipf(spark, d, theta=1.0, scale=1_000_000):
    ranks = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("k"))
    total = G.zipf_total(ranks, scale, theta)
    draws = table(spark, d, "events").select(F.col("event_id").alias("id"), G.spread(F.col("event_id"), total).alias("u"))
    return G.zipf(draws, G.zipf_cdf(ranks, scale, theta), total)


def _zipf_counts(name: str, theta: float, scale: int) -> None:
    @query(name, f"WITH {_zipf_sql(theta, scale)} SELECT k, count(*) AS cnt FROM z GROUP BY 1")
    def counts(spark, d):
        return _zipf(spark, d, theta, scale).groupBy("k").agg(F.count("*").alias("cnt"))


_zipf_counts("g4_zipf_draws", 1.0, 1_000_000)
_zipf_counts("g4c_zipf_half", 0.5, 1_000_000)
_zipf_counts("g4d_zipf_steep", 1.5, 1_000_000_000)


@query("g4b_zipf_join", f"WITH {_zipf_sql(1.0, 1_000_000)}, r AS (SELECT i AS key FROM range(0, {N_P}) t(i)), s AS (SELECT k AS key FROM z) {FACTS}")
def g4b(spark, d):
    p = table(spark, d, "part").count()
    return _facts(G.unique(spark, p, p), _zipf(spark, d).select(F.col("k").cast("int").alias("key")))


_MURMUR = (
    "a AS (SELECT i AS id, (i + 11) & 4294967295 AS x FROM range(0, {n}) t(i)), b AS (SELECT id, xor(x, x >> 16) AS x FROM a), c AS (SELECT id, CAST((CAST(x AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS x FROM b), "
    "e AS (SELECT id, xor(x, x >> 13) AS x FROM c), f AS (SELECT id, CAST((CAST(x AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS x FROM e), "
    "g AS (SELECT id, xor(x, x >> 16) AS x FROM f), perm AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS place FROM g)"
)


@query("g7_permutation", f"WITH {_MURMUR.format(n=N_O)} SELECT * FROM perm")
def g7(spark, d):
    return G.permutation(spark, table(spark, d, "orders").count())


@query("g8_zipf_permuted", f"WITH {_zipf_sql(1.0, 1_000_000)}, {_MURMUR.format(n=N_P)} SELECT CAST(place + 1 AS INTEGER) AS key, count(*) AS cnt FROM z JOIN perm ON id = k - 1 GROUP BY 1")
def g8(spark, d):
    """Zipf draws over a permuted alphabet: the frequent keys are not the small ones."""
    alphabet = G.permutation(spark, table(spark, d, "part").count()).select((F.col("id") + 1).alias("k"), (F.col("place") + 1).cast("int").alias("key"))
    return _zipf(spark, d).groupBy("k").agg(F.count("*").alias("cnt")).join(alphabet, "k").select("key", "cnt")


@query("q27_skewed_join", f"WITH {_zipf_sql(1.5, 1_000_000_000)} SELECT count(*) AS matches, CAST(sum(p_size * event_id) AS BIGINT) AS agg FROM z JOIN part ON p_partkey + 1 = k")
def q27(spark, d):
    """Hot keys cut into sub-chains of at most 64 rows, each joined by itself."""
    z = _zipf(spark, d, 1.5, 1_000_000_000).select(F.col("k").alias("key"), F.col("id").alias("payload"))
    p = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("key"), F.col("p_size").alias("payload"))
    j = J.chained(p, z, 64)
    return j.agg(F.count("*").alias("matches"), F.sum(J.product()).cast("bigint").alias("agg"))


@query("q28_raw_round_trip", "SELECT CAST(o_orderkey AS INTEGER) AS key, 1 AS payload FROM orders")
def q28(spark, d):
    """Keys written as raw part files and read back."""
    out = shared_folder(spark, "raw")
    n = write_raw(table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("key")), out)
    return read_raw(spark, out, n)


@query("g5_replicate", f"WITH {UNIQUE_R}, s AS (SELECT r.key FROM r, range(0, 3) t(i)) {FACTS}")
def g5(spark, d):
    r = G.unique(spark, *[table(spark, d, "part").count()] * 2)
    return _facts(r, G.replicate(r, 3))


@query(
    "g6_initialise",
    f"WITH i AS (SELECT i FROM range(0, {N_O}) t(i)), u AS (SELECT 'seq' AS kind, CAST(i AS BIGINT) AS v FROM i UNION ALL SELECT 'uniform', {_lcg('i')} % 1000 FROM i "
    f"UNION ALL SELECT 'zero', 0 FROM i UNION ALL SELECT 'int100', {_lcg('i')} % 100 + 1 FROM i UNION ALL SELECT 'float256', {_lcg('i')} % 256 FROM i) "
    "SELECT kind, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM u GROUP BY 1",
)
def g6(spark, d):
    n = table(spark, d, "orders").count()
    out = None
    for kind in ("seq", "uniform", "zero", "int100", "float256"):
        v = F.round(F.col("v") * 10) if kind == "float256" else F.col("v")
        one = G.initialise(spark, n, kind, 1000).select(F.lit(kind).alias("kind"), v.cast("bigint").alias("v"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
