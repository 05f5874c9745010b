"""Edge cases, generator cardinalities, plans and the packing of batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import bits
from keyloom.operators import join as J
from keyloom.operators import radix, scan
from keyloom.plans import schedule, strategy
from keyloom.sources import generators as G
from keyloom.sources import relations as R

STRATS = [s for s in J.STRATEGIES]


def rel(spark, rows):
    return spark.createDataFrame(rows, "key INT, payload INT")


def brute(r, s):
    return sorted((k, p, q) for k, p in r for m, q in s if k == m)


CASES = {
    "plain": ([(1, 2), (2, 3), (2, 4)], [(2, 5), (2, 6), (9, 9)]),
    "empty_build": ([], [(1, 1)]),
    "empty_probe": ([(1, 1)], []),
    "disjoint": ([(1, 1)], [(2, 2)]),
    "one_key": ([(7, i) for i in range(40)], [(7, i) for i in range(30)]),
    "negative": ([(-1, 1), (-(2**31), 2)], [(-1, 3), (-(2**31), 4), (0, 1)]),
    "large": ([(1, 2**31 - 1)], [(1, 2**31 - 1), (1, 2**31 - 2)]),
}


@pytest.mark.parametrize("case", CASES)
def test_strategies_agree(spark, case):
    r, s = CASES[case]
    for name in STRATS:
        j = J.join(rel(spark, r), rel(spark, s), name)
        assert sorted((x.key, x.r_payload, x.s_payload) for x in j.collect()) == brute(r, s), name
    total = sum(p * q for _, p, q in brute(r, s))
    j = J.join(rel(spark, r), rel(spark, s))
    assert J.sum_product(j).first()[0] == total
    assert J.sum_product(j, wrap=True).first()[0] == (total + 2**31) % 2**32 - 2**31


@pytest.mark.parametrize("hint", ["broadcast", "shuffle_hash", "merge"])
def test_requested_join_runs(spark, hint):
    r = G.unique(spark, 1000, 1000)
    n = strategy.nodes(J.match_count(J.join(r, G.unique(spark, 5000, 1000), hint)))
    assert n.get(strategy.NODES[hint]) == 1


def test_broadcast_gives_way_beyond_its_bound(spark):
    r = G.unique(spark, 1000, 1000)
    j = r.withColumnRenamed("payload", "x").join(strategy.checked_hint(r, "broadcast", limit=10), "key")
    assert strategy.nodes(j).get("SortMergeJoin") == 1


def test_broadcast_counts_rows_of_compressed_files(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS key", "1 AS payload").coalesce(1).write.parquet(f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r")
    held = 20_000 * 8 * 3  # two columns and the null bits
    assert strategy.size_bytes(r) < held == strategy.row_bytes(r)
    for limit, node in ((held - 1, "SortMergeJoin"), (held, "BroadcastHashJoin")):
        j = spark.range(0, 40_000, 3).toDF("key").join(strategy.checked_hint(r, "broadcast", limit), "key")
        assert strategy.nodes(j).get(node) == 1
        assert j.count() == 6_667
    text = spark.createDataFrame([(1, "aé"), (2, None)], "key INT, `a.b` STRING")
    assert strategy.row_bytes(text) == 2 * 24 + 3
    assert strategy.row_bytes(text.limit(0)) == 0


def test_broadcast_of_many_rows_in_small_files_gives_way(spark, tmp_path):
    n = strategy.BROADCAST_BYTES // 24 + 1
    spark.range(n).selectExpr("id AS key", "1 AS payload").write.parquet(f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r")
    assert strategy.size_bytes(r) < strategy.BROADCAST_BYTES
    j = J.join(r, rel(spark, [(0, 1), (n - 1, 2), (n, 3)]), "broadcast")
    assert strategy.nodes(j).get("SortMergeJoin") == 1
    assert sorted(map(tuple, j.collect())) == [(0, 1, 1), (n - 1, 2, 1)]


def test_radix_join_adds_no_exchange(spark):
    n = strategy.nodes(J.materialize(J.join(G.unique(spark, 1000, 1000), G.unique(spark, 1000, 1000), "radix")))
    assert n["Exchange"] == 2


def test_perfect_rejects_repeated_keys(spark):
    with pytest.raises(ValueError):
        J.perfect(rel(spark, [(1, 1), (1, 2)]), rel(spark, [(1, 1)]))


@pytest.mark.parametrize("k", [2, 5])
def test_unique_cardinality(spark, k):
    n = 1000
    r = G.unique(spark, n, n).where(F.col("key") < n)
    m = lambda s: J.match_count(J.join(r, s)).first()[0]
    assert m(G.unique(spark, n // 2, n)) == n // 2
    assert m(G.unique(spark, n, n)) == n
    assert m(G.unique(spark, k * n, n)) == k * n - (k - 1)
    assert m(G.replicate(G.unique(spark, n, n), k)) == k * n


def test_fk_all_match(spark):
    pk = spark.range(100).select("id", (F.col("id") * 3).cast("int").alias("k"))
    fk = G.fk_from_pk(pk, 257, "id", "k")
    assert fk.count() == 257
    assert fk.join(pk, F.col("key") == F.col("k"), "left_anti").count() == 0


def test_scans(spark):
    rng = random.Random(3)
    pos = rng.sample(range(-5000, 50000), 3000)
    rows = [(p, rng.randint(-9, 9)) for p in pos]
    df = spark.createDataFrame(rows, "p BIGINT, v BIGINT")
    rows.sort()
    ahead = list(itertools.accumulate([v for _, v in rows], initial=0))
    got = sorted((r.pos, r.scan) for r in scan.exclusive_scan(df, "p", "v", block=16).collect())
    assert got == [(p, a) for (p, _), a in zip(rows, ahead)]
    got = sorted((r.pos, r.scan) for r in scan.exclusive_scan(df, "p", "v", block=16, suffix=True).collect())
    assert got == [(p, ahead[-1] - a) for (p, _), a in zip(rows, ahead[1:])]
    assert scan.exclusive_scan(df.where("p > 1e9"), "p", "v").count() == 0
    ids = sorted((r.p, r.row_id) for r in scan.row_ids(df, "p", 64).collect())
    assert [i for _, i in ids] == list(range(3000))


@pytest.mark.parametrize("n", [4095, 4096, 4097, 8192, 8193])
def test_bucket_boundaries(spark, n):
    df = spark.range(n).select(F.lit(5).alias("key"))
    b = sorted((r.bucket_no, r.rows) for r in radix.bucket_info(df, F.col("key")).collect())
    assert sum(x for _, x in b) == n and all(x == 4096 for _, x in b[:-1])
    assert radix.decompose_chains(df, F.col("key")).count() == -(-n // 8192)


def test_segment_scans(spark):
    rng = random.Random(5)
    rows = sorted((p, rng.randint(-9, 9)) for p in rng.sample(range(-3000, 9000), 1500))
    df = spark.createDataFrame(rows, "p BIGINT, v BIGINT")
    borders = sorted({rng.randrange(-4000, 9500) for _ in range(40)} | {rows[7][0]})

    def brute(segment):
        out, ahead = [], {}
        for p, v in rows:
            out.append((segment(p), p, ahead.get(segment(p), 0)))
            ahead[segment(p)] = ahead.get(segment(p), 0) + v
        return out

    got = scan.bordered_scan(df, "p", "v", spark.createDataFrame([(b,) for b in borders * 2], "border BIGINT"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(lambda p: sum(b <= p for b in borders))
    # one segment with nearly all rows
    got = scan.segmented_scan(df, "p", "v", F.when(F.col("p") < -2900, 0).otherwise(1))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(lambda p: int(p >= -2900))
    got = {r.pos: (r.block, r.range, r.scan) for r in scan.interleaved_scan(df, "p", "v", 3, 100).collect()}
    assert got == {p: (p // 100, p % 3, s) for (_, p, s) in brute(lambda p: (p // 100, p % 3))}


def test_bits(spark):
    xs = [0, 1, 2, 3, 4, 5, 7, 8, 9, 1023, 1024, 2**31 - 1, 2**31, 2**32 - 1, 12345678]
    df = spark.createDataFrame([(x,) for x in xs], "x BIGINT")
    c = F.col("x")
    rows = df.select("x", bits.popcount32(c).alias("p"), bits.ctz32(c).alias("z"), bits.next_pow2(c).alias("u"), bits.lower_pow2(c).alias("d"), bits.wrap32(c).alias("w"), bits.murmur_finalizer(c).alias("m")).collect()
    for r in rows:
        x = r.x
        h = x ^ (x >> 16)
        h = h * 2246822507 % 2**32
        h ^= h >> 13
        h = h * 3266489909 % 2**32
        assert r.p == bin(x).count("1") and r.m == (h ^ (h >> 16)) % 2**20
        assert r.z == (32 if x == 0 else (x & -x).bit_length() - 1)
        assert r.u == (1 if x <= 1 else 1 << (x - 1).bit_length())
        assert r.d == (0 if x <= 1 else 1 << ((x - 1).bit_length() - 1))
        assert r.w == (x + 2**31) % 2**32 - 2**31


def test_raw_round_trip(spark, tmp_path):
    df = rel(spark, [(k, 1) for k in (-5, 0, 7, 2**31 - 1)])
    R.write_raw(df, str(tmp_path / "raw"))
    back = R.read_raw(spark, str(tmp_path / "raw"), 4)
    assert sorted(r.key for r in back.collect()) == [-5, 0, 7, 2**31 - 1]
    with pytest.raises(ValueError):
        R.read_raw(spark, str(tmp_path / "raw"), 5)
    with pytest.raises(FileNotFoundError):
        R.read_raw(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("n", [0, 1, 9973, 12288])
def test_raw_files_of_any_length(spark, tmp_path, n):
    df = spark.range(n, numPartitions=3).select((F.col("id") * 7 - 5000).cast("int").alias("key"))
    assert R.write_raw(df, f"file://{tmp_path}/raw") == n
    R.write_raw(df, f"file://{tmp_path}/raw")  # again: the same files
    assert sorted(r.key for r in R.read_raw(spark, f"file://{tmp_path}/raw", n).collect()) == [7 * i - 5000 for i in range(n)]


def test_raw_records():
    assert [R.record_bytes(4 * n) for n in (1, 9973, 16384, 16384 * 3, 2 * 9973)] == [4, 4 * 9973, 1 << 16, 1 << 16, 4 * 9973]
    assert R.record_bytes(4 * 1000003) == 4


def test_throughput(spark):
    from keyloom.plans import measure

    t = measure.Throughput(2.0, 1_000_000)
    assert (t.tuples_per_s, t.mb_per_s) == (500_000, 4.0)
    assert measure.run(spark.range(10), 10).tuples_per_s > 0


def test_file_names():
    assert [G.file_name(*x) for x in (("unique", 7), ("pk", 5), ("fk", 9, 5), ("nonunique_s", 3))] == ["unique_7.bin", "pk_R5.bin", "fk_S9_pk_R5.bin", "nonUnique_S3.bin"]
    with pytest.raises(ValueError):
        G.file_name("fk", 9)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_permutation(spark, n):
    got = G.permutation(spark, n).collect()
    assert sorted(r.place for r in got) == sorted(r.id for r in got) == list(range(n))
    assert n < 2 or sum(r.place == r.id for r in got) < 20


@pytest.mark.parametrize("theta", [0.0, 0.5, 1.0, 1.7, 3.0])
def test_zipf_loses_no_rank(spark, theta):
    ranks = spark.range(1, 3001).select(F.col("id").alias("k"))
    cdf = sorted((r.k, r.lo, r.hi) for r in G.zipf_cdf(ranks, 100_000, theta).collect())
    assert all(a < b for _, a, b in cdf) and [a for _, a, _ in cdf[1:]] == [b for _, _, b in cdf[:-1]]
    assert cdf[-1][2] == G.zipf_total(ranks, 100_000, theta)
    draws = spark.range(-(-cdf[-1][2] // 97)).select("id", (F.col("id") * 97).alias("u"))
    got = {r.k: r["count"] for r in G.zipf(draws, G.zipf_cdf(ranks, 100_000, theta), cdf[-1][2]).groupBy("k").count().collect()}
    assert sum(got.values()) == -(-cdf[-1][2] // 97) and all(abs(got.get(k, 0) - (b - a) / 97) <= 1 for k, a, b in cdf)


def test_spread_is_even(spark):
    got = spark.range(20000).select(G.spread(F.col("id"), 10).alias("u")).groupBy("u").count().collect()
    assert len(got) == 10 and all(abs(r["count"] - 2000) < 250 for r in got)
    counts = [r["count"] for r in spark.range(20000).select(G.spread(F.col("id"), 20000).alias("u")).groupBy("u").count().collect()]
    assert max(counts) > 3  # draws are independent, not a permutation


def test_sub_chains_of_a_hot_key(spark):
    s = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("int").alias("key"), F.col("id").alias("payload"))
    r = spark.createDataFrame([(7, 1), (7, 2), (9, 3), (12, 4)], "key INT, payload INT")
    big, small, on = radix.chained(s, r, "key", 100)
    sizes = {(x.key, x["__chain"]): x["count"] for x in big.groupBy(*on).count().collect()}
    assert len([k for k in sizes if k[0] == 7]) == 34 and max(sizes.values()) < 200
    assert small.where("key = 7").count() == 68 and small.where("key <> 7").count() == 2
    want = sorted((x.key, x.s_payload, x.r_payload) for x in J.join(r, s).collect())
    assert sorted((x.key, x.s_payload, x.r_payload) for x in J.chained(r, s, 100).collect()) == want


def test_batches_read_their_own_partitions(spark, tmp_path):
    r, s = G.unique(spark, 900, 900), G.unique(spark, 2500, 900)
    out = J.coprocess_batches(r, s, f"file://{tmp_path}/c")
    want = J.join(r, s).groupBy(F.col("key").bitwiseAND(F.lit(15)).alias("host_part")).count()
    assert sorted(map(tuple, out.groupBy("host_part").count().collect())) == sorted(map(tuple, want.collect()))
    parts = {}
    for x in out.select("batch", "host_part").distinct().collect():
        parts.setdefault(x.batch, set()).add(x.host_part)
    assert len(parts) > 2 and sum(map(len, parts.values())) == 16 and max(map(len, parts.values())) <= 5
    assert J.coprocess_batches(r.limit(0), s, f"file://{tmp_path}/e").count() == 0


def test_segments_are_materialised_once(spark, tmp_path):
    from keyloom.streaming.probe import stream_materialize

    s = spark.range(300).select((F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("p"))
    s.repartition(3).write.parquet(f"file://{tmp_path}/s.parquet")
    r = G.unique(spark, 40, 40).select("key", F.col("key").cast("bigint").alias("payload"))
    got = stream_materialize(spark, r, f"file://{tmp_path}/s.parquet/", s.schema, "k", "p", f"file://{tmp_path}/out")
    assert got.select("segment").distinct().count() == 3
    want = s.join(r, s["k"] == r["key"]).select("payload", "p")
    assert sorted((x.r_payload, x.s_payload) for x in got.collect()) == sorted(map(tuple, want.collect()))


def test_shared_folders_need_a_shared_place(spark):
    from types import SimpleNamespace

    from keyloom.streaming.probe import shared_folder

    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(there, "x")


def test_cached_relation(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), G.unique(spark, 10, 10))[1]
    for _ in range(2):
        assert R.cached_relation(spark, str(tmp_path / "u_10_10"), make).count() == 10
    assert len(made) == 1


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(40):
        items = [schedule.Item(i, rng.randint(1, 3), rng.random()) for i in range(rng.randint(0, 9))]
        got = sum(i.gain for i in schedule.knapsack(items))
        best = max(sum(i.gain for i in c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(i.weight for i in c) <= 5)
        assert abs(got - best) < 1e-9
        for pack in (schedule.pack_optimal(items), schedule.pack_pairs([i for i in items if i.weight < 3])):
            assert all(sum(i.weight for i in b) <= 5 for b in pack)
        assert sorted(i.id for b in schedule.pack_optimal(items) for i in b) == [i.id for i in items]


def test_chooser():
    n = strategy.IN_MEMORY_ROWS
    assert [strategy.choose_strategy(*x) for x in ((n - 1, n - 1), (n - 1, n), (n, 1))] == ["in_memory", "streaming_probe", "co_processing"]


def test_skewed_join_with_salt(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("int").alias("key"), F.col("id").alias("v"))
    small = G.unique(spark, 3000, 3000)
    a, b, on = radix.salted(big, small, "key", 8)
    assert a.join(b, on).count() == big.join(small, "key").count()


def test_late_materialized_on_both_sides(spark):
    r = spark.createDataFrame([(1, 10, 100), (1, 11, 101), (2, 12, 102), (None, 13, 103)], "key INT, rid INT, a INT")
    s = spark.createDataFrame([(1, "f", 0, 7), (1, "f", 1, 7), (2, "g", 0, 8), (3, "g", 1, 9), (None, "g", 2, 9)], "key INT, s_file STRING, s_row INT, b INT")
    got = J.late_materialized(r, s, "rid", ["s_file", "s_row"]).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(100, 7), (100, 7), (101, 7), (101, 7), (102, 8)]


def test_q05b_fetches_both_sides_late(spark):
    from keyloom import queries as Q

    plan = Q.QUERIES["q05b_late_materialize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scans) == 4 and sum("l_partkey" in x for x in scans) == 1 and sum("o_custkey" in x for x in scans) == 1
