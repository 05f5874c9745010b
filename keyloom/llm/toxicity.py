"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x) for k = 0, 1, 2 with one weight vector w and ordered
thresholds, all fitted together by maximum likelihood. x marks which entries of a lexicon a text holds: whole words, or the first four or
five bytes of longer ones, which catches inflected forms. The lexicon comes from the labelled rows: entries
whose rate among toxic documents exceeds that among the others beyond chance, near copies counted once.

Labels are 0 or 1, so severity has to be graded from the rows themselves, and not by the features that the model then sees: the training rows are halved by
a hash of their text, either half tells which entries are significant and by what log-odds, the sum of those is the evidence in a toxic text of the other half,
and its terciles there are the grades 1, 2 and 3. Toxic texts have the share BALANCE in the likelihood. The result is the expected grade, 0 to 3; a text is toxic if P(grade >= 1) is at least 0.5.

Words: maximal runs of letters and digits, lower-cased. Null and empty texts have no words and
keep the base rate, which is below 0.5. Without labelled rows of both kinds nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import learn
from keyloom.llm.components import sets
from keyloom.llm.session import fresh, ship
from keyloom.llm.text import ALNUM_WORDS, Words, slices, windows, words

GRADES = 4
#: Labelled rows to learn from, at most.
TRAIN_ROWS = 6000
#: Least number of toxic training documents with an entry, and least z-score of its excess.
LEAST_DOCS, LEAST_Z = 3, 4.0
#: Least z-score of an entry that counts as evidence for the grade of a text of the other half.
EVIDENT_Z = 4.0
#: Penalty on squared weights, and the share of the toxic texts in the likelihood, however few they are.
PENALTY, BALANCE = 2e-3, 0.4
LEXICON = 5000
PREFIXES = (4, 5)
CUT = 0.5


@dataclass
class Model:
    lexicon: np.ndarray  #: sorted word hashes
    weight: np.ndarray
    theta: np.ndarray

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(grade >= 1), expected grade) of sums w.x."""
        above = 1 - _sigmoid(self.theta[None, :] - x[:, None])
        return above[:, 0], above.sum(1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _word_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct entries of each text, how many, and a sketch of each text that near copies mostly share."""
    W = words(pc.utf8_lower(col), ALNUM_WORDS)
    h = W.hashes(lower=True)
    found, doc, length = [h], [W.doc], W.end - W.start
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        cut = Words(W.data, W.off, W.start[at], W.start[at] + k, np.zeros(0, np.int64))
        found.append(cut.hashes(lower=True) ^ np.uint64(0xA5A5 + k))
        doc.append(W.doc[at])
    order = np.argsort(np.concatenate(doc), kind="stable")
    e, n = sets(np.concatenate(found)[order], np.bincount(np.concatenate(doc), minlength=W.n_docs))
    w, m = windows(h, W.count, 3, short=True)
    sketch = np.zeros(W.n_docs, np.uint64)
    full = np.flatnonzero(m)
    if len(full):
        sketch[full] = np.minimum.reduceat(w, (np.cumsum(m) - m)[full])
    return e, n, sketch


def z_scores(bad: np.ndarray, every: np.ndarray, n_bad: int, n: int) -> np.ndarray:
    """How far the number of toxic texts with an entry exceeds what its number of texts lets expect, in standard deviations."""
    p = every / max(n, 1)
    return (bad - n_bad * p) / np.sqrt(np.maximum(n_bad * p * (1 - p) * (1 - n_bad / max(n, 1)), 1e-9))


def severity(code: np.ndarray, doc: np.ndarray, y: np.ndarray, half: np.ndarray, n_words: int) -> np.ndarray:
    """Grades 0 to 3: of toxic texts by terciles, within each half, of the evidence of the other half: the sum of log-odds of the entries that are significant there."""
    grade = np.zeros(len(y), np.int64)
    for k in (0, 1):
        judge = np.flatnonzero((half == k) & (y == 1))
        if not len(judge):
            continue
        bad = np.bincount(code[(half[doc] != k) & (y[doc] == 1)], minlength=n_words)
        good = np.bincount(code[(half[doc] != k) & (y[doc] == 0)], minlength=n_words)
        n_bad, n_good = int(((half != k) & (y == 1)).sum()), int(((half != k) & (y == 0)).sum())
        odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
        evidence = np.where(z_scores(bad, bad + good, n_bad, n_bad + n_good) >= EVIDENT_Z, odds, 0.0)
        total = np.bincount(doc, weights=evidence[code], minlength=len(y))
        rank = np.argsort(np.argsort(total[judge], kind="stable"), kind="stable")
        grade[judge] = 1 + 3 * rank // len(judge)
    return grade


def log_likelihood(w: np.ndarray, theta: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of texts of weight `each`, less the penalty, and its gradient by w and by theta; text row[i] holds entry col[i]."""
    n = len(grade)
    cum = _sigmoid(theta[None, :] - np.bincount(row, weights=w[col], minlength=n)[:, None])
    full = np.concatenate((np.zeros((n, 1)), cum, np.ones((n, 1))), 1)
    slope = np.concatenate((np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))), 1)
    at = np.arange(n)
    prob = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
    upper, lower = each * slope[at, grade + 1] / prob, each * slope[at, grade] / prob
    d_theta = np.bincount(grade, weights=upper, minlength=GRADES)[:-1] - np.bincount(grade, weights=lower, minlength=GRADES)[1:]
    d_w = np.bincount(col, weights=(lower - upper)[row], minlength=len(w)) - PENALTY * w
    return float(each @ np.log(prob) - PENALTY / 2 * (w @ w)), d_w, d_theta


def fit(texts: list[tuple[np.ndarray, int]], rounds: int = 1500) -> Model:
    """texts: the distinct entry hashes, sorted, and the 0/1 label of each training document."""
    y = np.array([t for _, t in texts], np.int64)
    size = np.array([len(h) for h, _ in texts], np.int64)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 20.0))
    if not (y == 1).any() or not (y == 0).any():
        return none
    flat, doc = np.concatenate([h for h, _ in texts]), np.repeat(np.arange(len(y)), size)
    vocab, code = np.unique(flat, return_inverse=True)
    bad = np.bincount(code[y[doc] == 1], minlength=len(vocab))
    every = np.bincount(code, minlength=len(vocab))
    n1, n = int((y == 1).sum()), len(y)
    z = z_scores(bad, every, n1, n)
    good = np.flatnonzero((bad >= LEAST_DOCS) & (z >= LEAST_Z))
    good = np.sort(good[np.argsort(-z[good], kind="stable")[:LEXICON]])
    if not len(good):
        return none
    slot = np.full(len(vocab), -1)
    slot[good] = np.arange(len(good))
    use = slot[code] >= 0
    row, col = doc[use], slot[code[use]]
    half = np.array([int(h[0] >> np.uint64(40)) & 1 if len(h) else 0 for h, _ in texts])
    grade = severity(code, doc, y, half, len(vocab))
    w = np.zeros(len(good))
    each = np.where(y == 1, BALANCE / n1, (1 - BALANCE) / (n - n1))
    share = np.array([each[grade <= k].sum() for k in range(GRADES - 1)])
    theta = np.log((share + 1e-3) / (1 - share + 1e-3))
    theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-3)
    gw2, gt2 = np.full(len(w), 1e-8), np.full(len(theta), 1e-8)
    for _ in range(rounds):
        _, dw, dt = log_likelihood(w, theta, row, col, grade, each)
        gw2 += dw * dw
        gt2 += dt * dt
        w += 0.3 * dw / np.sqrt(gw2)
        theta = np.maximum.accumulate(theta + 0.1 * dt / np.sqrt(gt2))
    order = np.argsort(vocab[good])
    return Model(vocab[good][order], w[order], theta)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From at most `rows` labelled documents, in one task; only the lexicon and its weights come to the driver."""
    ship(docs.sparkSession)
    sample = learn.labelled(docs, labels, "toxic", rows, F.lit(True))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, n, sketch = _word_sets(b.column("text"))
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32) * 8
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(h))]), pa.array(sketch.view(np.int64))], ["id", "label", "h", "sketch"])

    def model(got: list[dict]) -> Model:
        got = sorted(got, key=lambda r: (r["id"], r["h"]))
        once = {(r["sketch"], r["label"]): (np.frombuffer(r["h"], "<u8"), r["label"]) for r in got}  # a near copy teaches nothing new
        return fit(list(once.values()))

    return learn.fitted(sample.mapInArrow(hashed, f"id {dict(docs.dtypes)['doc_id']}, label INT, h BINARY, sketch BIGINT"), model)


def predict(col: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    h, n, _ = _word_sets(col)
    x = np.zeros(len(n))
    if len(model.lexicon) and len(h):
        at = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
        hit = np.flatnonzero(model.lexicon[at] == h)
        doc = np.repeat(np.arange(len(n)), n)[hit]
        x = np.bincount(doc, weights=model.weight[at[hit]], minlength=len(n))
    return model.score(x)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_toxic, severity, grade, toxic) for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p, e = predict(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(e), pa.array(np.rint(e).astype(np.int32)), pa.array(p >= CUT)], ["doc_id", "p_toxic", "severity", "grade", "toxic"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, p_toxic DOUBLE, severity DOUBLE, grade INT, toxic BOOLEAN")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the toxic ones, all columns kept."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        b = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.concat_arrays([pa.array(predict(x.column("text"), model)[0] >= CUT) for x in slices([b])])

    flag = fresh(docs.columns, "__toxic")
    return docs.withColumn(flag, toxic(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
