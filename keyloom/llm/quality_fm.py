"""Quality scores by a factorisation machine.

x holds hashed words (relative frequencies, normed), structure statistics and text metadata
(length, lines). score = sigmoid(b + w.x + sum over pairs <v_i, v_j> x_i x_j), the pairs in linear
time: half of (sum v x)^2 - sum v^2 x^2 for each factor. Trained by Adam on the
logistic loss over at most TRAIN_ROWS labelled documents.

Neither labels nor lang, source or doc_id enter a score. Null and empty texts have no words and are scored
by their statistics, all zero before standardising. Without labelled rows of both kinds every score is the base rate, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import learn
from keyloom.llm.session import ship
from keyloom.llm.stats import structure, vector
from keyloom.llm.text import slices

WORDS = 2048  #: buckets of hashed words
FACTORS = 8
TRAIN_ROWS = 5000
LEAST_STEPS = 600  #: of the optimiser, however few rows there are
CUT = 0.7


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def score(self, hashed: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(_raw(np.concatenate((hashed, self.standard(stats)), 1), self.b, self.w, self.v))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _raw(x: np.ndarray, b: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return b + x @ w + 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum(1)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, WORDS) hashed words with unit norm, and (texts, statistics)."""
    s, W, h = structure(col)
    code = W.doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64)
    x = np.bincount(code, minlength=W.n_docs * WORDS).reshape(W.n_docs, WORDS).astype(np.float32)
    x = np.sqrt(x)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    n = np.maximum(s.n_words, 1)
    meta = np.stack([np.log1p(s.n_lines), np.sqrt(s.n_digit / n), np.sqrt(s.n_repeat_words / n), s.n_upper / np.maximum(s.word_chars, 1), s.n_symbols / n], 1)
    return x, np.concatenate((vector(s), meta), 1)


def fit(x: np.ndarray, stats: np.ndarray, y: np.ndarray, rounds: int = 14, batch: int = 128, seed: int = 5) -> Model:
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    m = Model(mean, scale, 0.0, np.zeros(x.shape[1] + stats.shape[1], np.float32), np.zeros((x.shape[1] + stats.shape[1], FACTORS), np.float32))
    if not len(y) or y.min() == y.max():
        m.b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
        return m
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.02, m.v.shape).astype(np.float32)
    m.b = float(np.log(y.mean() / (1 - y.mean())))
    full = np.concatenate((x, m.standard(stats)), 1)
    rounds = max(rounds, LEAST_STEPS * batch // len(y))
    params = [np.array([m.b], np.float32), m.w, m.v]
    mom, sq, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for r in range(rounds):
        rate = 0.01 / (1 + 4 * r / rounds)
        for i in np.split(rng.permutation(len(y)), range(batch, len(y), batch)):
            xb, t = full[i], t + 1
            xv = xb @ params[2]
            g = ((_sigmoid(_raw(xb, params[0][0], params[1], params[2])) - y[i]) / len(i)).astype(np.float32)
            dv = xb.T @ (g[:, None] * xv) - params[2] * ((xb * xb).T @ g)[:, None]
            for p, d, a, s in zip(params, (np.array([g.sum()]), xb.T @ g + 1e-4 * params[1], dv + 1e-3 * params[2]), mom, sq):
                a += 0.1 * (d - a)
                s += 0.001 * (d * d - s)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    m.b, m.w, m.v = float(params[0][0]), params[1], params[2]
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Hashed features of the sampled rows come to the driver, not their texts."""
    ship(docs.sparkSession)
    sample = learn.labelled(docs, labels, "quality", rows, learn.fold(F.col("doc_id"), 4) != 2)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, s = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r[r > 0].tobytes() for r in x], pa.binary()), pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())], ["id", "label", "v", "i", "s"])

    got = sorted(sample.mapInArrow(hashed, f"id {dict(docs.dtypes)['doc_id']}, label INT, v BINARY, i BINARY, s BINARY").collect(), key=lambda r: (r[0], r[4]))
    n_stats = features(pa.array(["a"]))[1].shape[1]
    x = np.zeros((len(got), WORDS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(bytes(r[3]), "<u2")] = np.frombuffer(bytes(r[2]), np.float32)
    s = np.array([np.frombuffer(bytes(r[4])) for r in got]).reshape(len(got), n_stats) if got else np.zeros((1, n_stats))
    return fit(x, s, np.array([r[1] for r in got], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            # the score as it is returned decides: in single precision 0.7 is less than the double 0.7
            p = np.concatenate([model.score(*features(b.column("text").slice(i, 1024))) for i in range(0, b.num_rows, 1024)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (learn.fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out BOOLEAN, score DOUBLE, predicted INT")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
