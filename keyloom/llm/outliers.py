"""Quality rules and robust multivariate outliers.

Each text gives a vector of transformed statistics (stats.VECTOR). For every language and source a
minimum-covariance-determinant estimate of location and scatter is found as FAST-MCD does: from several starts, concentration steps
take mean and covariance of the h = 75 % of the group's rows with the least Mahalanobis distances, again and again until the determinant
falls no more; of the starts, the one with the least determinant is kept. Starts are coordinatewise medians and quartiles, and moments of
small random subsets. The scatter is regularised by RIDGE on each axis, in the determinant too, as some statistics are zero in most texts.
All rows take part, and all passes are distributed: rows are reduced to counts and moments by group, start and distance
bucket where they lie, so a group of any size is at most STARTS * BUCKETS rows when it meets in one place. A row goes if its distance, scaled so that
the group's median is that of a chi-squared variable, exceeds TAIL times a high quantile of it.

Groups with fewer than LEAST_ROWS rows are pooled by language, and those of languages that have as few with one another. A null language or
source is a value like another. Null and empty texts have zero statistics and fail the base rule. Rows that repeat count as often as
they occur. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import components as C
from keyloom.llm.session import remove, ship, written
from keyloom.llm.stats import VECTOR, structure, vector
from keyloom.llm.text import slices

D = len(VECTOR)
H, LEAST_ROWS = 0.75, 100
#: Random subsets to start from, beside the medians, and rows of each; concentration steps at most, and the fall of the determinant's logarithm that ends them.
SUBSETS, SUBSET_ROWS = 2, 6 * D
MOST_STEPS, SETTLED = 20, 1e-3
#: Buckets of the logarithm of the squared distance, and how many there are for a factor of e.
BUCKETS, FINE = 256, 12
#: Squared standard deviations added to each coordinate: statistics that are zero in most texts have none of their own.
RIDGE = 0.1**2
QUANTILE = 0.99999
#: Text statistics have heavier tails than a normal vector: the cut is so many times the quantile.
TAIL = 6.0
#: Groups up to which estimates are sent to all tasks, about 2 KB each.
BROADCAST_GROUPS = 20_000
_UP = np.triu_indices(D)
_X = [f"x{i}" for i in range(D)]
_M = [f"m{i}" for i in range(D + len(_UP[0]))]
BASE = "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT"


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return d * (1 - 2 / (9 * d) + lo * math.sqrt(2 / (9 * d))) ** 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        s, _, _ = structure(b.column("text"))
        v = vector(s)
        base = [pa.array(x) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *base, *(pa.array(v[:, i]) for i in range(D))], ["doc_id", "lang", "source", *(c.split()[0] for c in BASE.split(", ")), *_X])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and the vector of every row."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, lang STRING, source STRING, {BASE}, {', '.join(f'{x} DOUBLE' for x in _X)}")


def _named(lang, source):
    return F.to_json(F.struct(lang.alias("l"), source.alias("s")), {"ignoreNullFields": "false"})


def grouped(rows: DataFrame) -> DataFrame:
    """rows with g, the group whose estimate is used, and n_g, its rows."""
    n, path = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    by_lang = n.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    a, b = n.alias("a"), by_lang.alias("b")
    g = F.when(F.col("n") >= LEAST_ROWS, _named(F.col("a.lang"), F.col("a.source"))).when(F.col("n_lang") >= LEAST_ROWS, F.to_json(F.struct(F.col("a.lang").alias("l")), {"ignoreNullFields": "false"})).otherwise(F.lit("*"))
    names = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).select(_named(F.col("a.lang"), F.col("a.source")).alias("own"), "n", g.alias("g"))
    held = names.groupBy("g").agg(F.sum("n").alias("n_g"))
    names, _ = written(names.join(held, "g").withColumnRenamed("n", "n_own"), "groups")
    remove(rows.sparkSession, path)
    return C.meet(rows.withColumn("own", _named(F.col("lang"), F.col("source"))), names, "own", "n_own").drop("own", "n_own")


#: One estimate: the logarithm of the determinant, the location, the inverse scatter.
_EST = 1 + D + D * D


def distances(code: np.ndarray, est: list[bytes], x: np.ndarray) -> np.ndarray:
    """(rows, starts): squared Mahalanobis distances; est: by code, the estimates of its starts one after the other."""
    starts = len(est[0]) // (8 * _EST) if est else 1
    out = np.empty((len(code), starts))
    order = np.argsort(code, kind="stable")
    cut = np.searchsorted(code[order], np.arange(len(est) + 1))
    for c, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        rows = order[a:b]
        for k, e in enumerate(np.frombuffer(est[c]).reshape(-1, _EST)):
            y = x[rows] - e[1 : D + 1]
            out[rows, k] = ((y @ e[D + 1 :].reshape(D, D)) * y).sum(1)
    return out


def _passed(rows: DataFrame, est: DataFrame, work: Callable[[], Callable], schema: str) -> DataFrame:
    """work over rows with their group's estimate: (batch, names of groups, code of each row, estimates by code, vectors).

    Estimates of BROADCAST_GROUPS or fewer are sent to the tasks; more are joined, with a salt as groups may be hot.
    """
    table: dict[str, bytes] | None = None
    if est.count() <= BROADCAST_GROUPS:
        table = {r.g: bytes(r.est) for r in est.select("g", "est").collect()}
    else:
        salted = est.select("g", "est").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(32)).cast("int")).join(salted, ["g", "salt"]).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for b in batches:
            if b.num_rows:
                names, at, code = np.unique(b.column("g").to_numpy(zero_copy_only=False).astype(str), return_index=True, return_inverse=True)
                held = [table[n] for n in names.tolist()] if table is not None else [b.column("est")[i].as_py() for i in at.tolist()]
                yield from do(b, names, code, held, np.stack([b.column(c).to_numpy() for c in _X], 1))
        yield from do(None, None, None, None, None)

    return rows.mapInArrow(run, schema)


def _bucket(d2: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log(np.maximum(d2, 1e-9)) * FINE) + BUCKETS // 2 - 2 * FINE, 0, BUCKETS - 1).astype(np.int64)


_SUMS = f"g STRING, start BIGINT, bucket BIGINT, n DOUBLE, {', '.join(f'{m} DOUBLE' for m in _M)}"


class _Sums:
    """Counts and moments by group, start and bucket, given out at the end of a task."""

    def __init__(self):
        self.held: dict[tuple[str, int, int], np.ndarray] = {}

    def add(self, names: np.ndarray, code: np.ndarray, start: int, bucket: np.ndarray, x: np.ndarray) -> None:
        full = np.concatenate((np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :])[:, _UP[0], _UP[1]]), 1)
        cell = code * BUCKETS + bucket
        order = np.argsort(cell, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
        for c, m in zip(cell[order][at].tolist(), np.add.reduceat(full[order], at)):
            k = (str(names[c // BUCKETS]), start, c % BUCKETS)
            self.held[k] = self.held[k] + m if k in self.held else m

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            m, keys = np.stack(list(self.held.values())), list(zip(*self.held))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int64()), *(pa.array(m[:, i]) for i in range(m.shape[1]))], ["g", "start", "bucket", "n", *_M])


def _by_distance() -> Callable:
    sums = _Sums()

    def do(b, names, code, est, x) -> Iterator[pa.RecordBatch]:
        if b is None:
            yield from sums.rows()
            return
        d2 = distances(code, est, x)
        for k in range(d2.shape[1]):
            sums.add(names, code, k, _bucket(d2[:, k]), x)

    return do


def _total(sums: DataFrame) -> DataFrame:
    return sums.groupBy("g", "start", "bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _M))


def estimate(mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    scatter = cov + np.eye(D) * RIDGE
    return np.concatenate(([np.linalg.slogdet(scatter)[1]], mu, np.linalg.inv(scatter).reshape(-1)))


def nearest(t: pd.DataFrame, h: float = H) -> np.ndarray:
    """The estimate from the buckets of a group and start that hold its h nearest rows; the last one in part."""
    t = t.sort_values("bucket")
    n = t["n"].to_numpy()
    left = np.clip(math.ceil(h * n.sum()) - (np.cumsum(n) - n), 0, n)
    s = (t[_M].to_numpy() * (left / n)[:, None]).sum(0) / left.sum()
    mu, second = s[:D], np.zeros((D, D))
    second[_UP] = s[D:]
    second = second + np.triu(second, 1).T
    return estimate(mu, second - np.outer(mu, mu))


def _concentrate(t: pd.DataFrame) -> pd.DataFrame:
    est = [nearest(x) for _, x in sorted(t.groupby("start"), key=lambda p: p[0])]
    return pd.DataFrame({"g": [t["g"].iloc[0]], "est": [np.concatenate(est).tobytes()], "dets": [[float(e[0]) for e in est]]})


def _median(t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("bucket")
    n = t["n"].to_numpy()
    k = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
    before = n[:k].sum()
    inside = (n.sum() / 2 - before) / n[k]
    return pd.DataFrame({"g": [t["g"].iloc[0]], "scale": [math.exp((t["bucket"].to_numpy()[k] + inside - BUCKETS // 2 + 2 * FINE) / FINE) / chi2_quantile(0.5, D)]})


_ESTIMATES = "g STRING, est BINARY, dets ARRAY<DOUBLE>"


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates that concentration starts from: medians and quartiles, and the moments of random subsets of about SUBSET_ROWS rows."""
    quart = [F.percentile(F.round(x, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in _X]  # of rounded values: the buffer is bounded
    cell = F.pmod(F.xxhash64(*_X), F.greatest(F.expr(f"n_g div {SUBSET_ROWS}"), F.lit(1)))
    few = rows.select("g", *_X, cell.cast("bigint").alias("start")).where(F.col("start") < SUBSETS)
    one = [F.sum(F.lit(1.0)).alias("n"), *(F.sum(x).alias(m) for x, m in zip(_X, _M))]
    cross = [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(m) for i, j, m in zip(*_UP, _M[D:])]
    subset = few.groupBy("g", "start").agg(*one, *cross).groupBy("g").agg(F.collect_list(F.struct("start", "n", *_M)).alias("subsets"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for k in range(len(t)):
                q = np.stack([t[x].iloc[k] for x in _X])
                est = [estimate(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))]
                subsets = t["subsets"].iloc[k]
                for r in sorted([] if subsets is None else subsets, key=lambda r: r["start"]):
                    est.append(nearest(pd.DataFrame([{"bucket": 0, "n": r["n"], **{m: r[m] for m in _M}}]), 1.0))
                est += [est[0]] * (1 + SUBSETS - len(est))
                out.append(np.concatenate(est))
            yield pd.DataFrame({"g": t["g"], "est": [e.tobytes() for e in out], "dets": [[float(d) for d in e[::_EST]] for e in out]})

    return rows.groupBy("g").agg(*quart).join(subset, "g", "left").mapInPandas(begin, _ESTIMATES)


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        est = [np.frombuffer(e).reshape(-1, _EST) for e in t["est"]]
        best = [e[int(e[:, 0].argmin())] for e in est]
        yield pd.DataFrame({"g": t["g"], "est": [e.tobytes() for e in best], "dets": [[float(e[0])] for e in best]})


def estimates(rows: DataFrame) -> DataFrame:
    """(g, est, dets, scale) from rows with g, n_g and the vector."""
    spark = rows.sparkSession
    x = rows.select("g", *_X)
    est, path = written(_starts(rows), "mcd")
    for step in range(MOST_STEPS):
        new, new_path = written(_total(_passed(x, est, _by_distance, _SUMS)).groupBy("g").applyInPandas(_concentrate, _ESTIMATES), "mcd")
        fall = F.max(F.array_max(F.zip_with("old", "dets", lambda a, b: F.abs(a - b))))
        moved = new.join(est.select("g", F.col("dets").alias("old")), "g").agg(fall).first()[0]
        remove(spark, path)
        est, path = new, new_path
        if step and (moved is None or moved < SETTLED):
            break
    best, best_path = written(est.mapInPandas(_least, _ESTIMATES), "mcd")
    scale = _total(_passed(x, best, _by_distance, _SUMS)).select("g", "bucket", "n").groupBy("g").applyInPandas(_median, "g STRING, scale DOUBLE")
    out, _ = written(best.join(scale, "g"), "mcd")
    remove(spark, path)
    remove(spark, best_path)
    return out


def judged(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the scaled squared distance of every row."""
    stats, path = written(measure(docs), "stats")
    rows, _ = written(grouped(stats), "stats")
    remove(docs.sparkSession, path)
    est = estimates(rows)
    limit = TAIL * chi2_quantile(quantile, D)
    names = [c.split()[0] for c in BASE.split(", ")]
    # the median's scale goes into the scatter, so that distances come scaled
    scaled = est.select("g", "est", "scale").mapInPandas(_scaled, "g STRING, est BINARY")

    def work() -> Callable:
        def do(b, _, code, held, x) -> Iterator[pa.RecordBatch]:
            if b is not None:
                d2 = distances(code, held, x)[:, 0]
                n, rep = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
                failed = (n < 50) | (100 * rep > 50 * n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in names), pa.array(failed), pa.array(~failed & (d2 <= limit)), pa.array(d2)], ["doc_id", *names, "base_failed", "kept", "distance"])

        return do

    kind = dict(docs.dtypes)["doc_id"]
    return _passed(rows, scaled, work, f"doc_id {kind}, {BASE}, base_failed BOOLEAN, kept BOOLEAN, distance DOUBLE")


def _scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        out = []
        for e, scale in zip(t["est"], t["scale"]):
            v = np.frombuffer(e).copy()
            v[D + 1 :] /= scale
            out.append(v.tobytes())
        yield pd.DataFrame({"g": t["g"], "est": out})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
