"""Language identification of words and texts by a linear-chain conditional random field.

Words are runs of letters, lower-cased. A word's features are its affixes and n-grams (byte
n-grams of the word between boundary marks, two to four long) and the word itself as a
lexicon entry, hashed. Transitions between the languages of neighbouring words are learned with them.
Training maximises the conditional likelihood of sequences made of stretches of labelled
texts, of one language or of several in turn, so that transitions at switches are seen. Words are
labelled by forward-backward; a text's language has the largest sum of posteriors, and
its score is that sum over the number of words.

Null texts and texts without letters get `und` and score 0, as does every text if no labels are there. Neither lang,
source nor doc_id enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import learn
from keyloom.llm.session import ship
from keyloom.llm.text import Words, slices, within, words

FEATURES = 1 << 16
#: Training texts of each language and words of each that are used, at most. Every language is learned.
TRAIN_TEXTS, TRAIN_WORDS = 600, 120
#: Words whose scores are summed at once, and bytes of text labelled at once, times languages.
SCORED, LABELLED = 1 << 17, 32 << 20
UND = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_letter = regex.compile(r"\p{L}")


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  #: (FEATURES, labels)
    step: np.ndarray  #: transition scores
    first: np.ndarray  #: scores of the first label


def word_features(W: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words numbered `at`, and how many each has."""
    length = (W.end - W.start)[at]
    size = length + 2
    pos = within(size)
    ends = np.cumsum(size)
    b = np.zeros(int(size.sum()) + 4, np.uint32)
    inner = (pos > 0) & (pos < np.repeat(size, size) - 1)
    b[:-4][inner] = W.data[np.repeat(W.start[at], size)[inner] + pos[inner] - 1]
    b[:-4][pos == 0] = 1
    b[ends - 1] = 2
    left = np.repeat(size, size) - pos
    grams, word = [], [np.repeat(np.arange(len(at)), size)] * 3
    g = b[:-4].copy()
    for n in (2, 3, 4):
        g = g | (b[n - 1 : len(b) - 5 + n] << np.uint32(8 * (n - 1)))
        grams.append(np.where(left >= n, ((g * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(16), np.uint32(FEATURES)))
    lex = (Words(W.data, W.off, W.start[at], W.end[at], np.zeros(0, np.int64)).hashes() >> np.uint64(48)).astype(np.uint32)
    f = np.concatenate((*grams, lex))
    w = np.concatenate((*word, np.arange(len(at))))
    ok = f < FEATURES
    f, w = f[ok].astype(np.int64), w[ok]
    order = np.argsort(w, kind="stable")
    return f[order], np.bincount(w, minlength=len(at))


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def posteriors(score: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of one length (n, words, labels) of emission scores: label posteriors and pair posteriors summed over positions."""
    n, t, k = score.shape
    a, b = np.zeros_like(score), np.zeros_like(score)
    a[:, 0] = first + score[:, 0]
    for i in range(1, t):
        a[:, i] = _log_sum(a[:, i - 1][:, :, None] + step, 1) + score[:, i]
    for i in range(t - 2, -1, -1):
        b[:, i] = _log_sum(step + (score[:, i + 1] + b[:, i + 1])[:, None, :], 2)
    z = _log_sum(a[:, -1], 1)[:, None, None]
    pair = np.zeros((k, k))
    for i in range(t - 1):
        pair += np.exp(a[:, i][:, :, None] + step + (score[:, i + 1] + b[:, i + 1])[:, None, :] - z).sum(0)
    return np.exp(a + b - z), pair


def gradient(score: np.ndarray, step: np.ndarray, first: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean log-likelihood of label sequences `gold` (n, words): by emission scores, transitions and first labels. Observed counts less expected ones."""
    n, t, k = score.shape
    post, pair = posteriors(score, step, first)
    by_word = (np.eye(k)[gold] - post) / n
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1.0)
    return by_word, (seen - pair) / n, by_word[:, 0].sum(0)


def fit(texts: list[tuple[str, str]], seed: int = 3, rounds: int = 3, span: int = 24, batch: int = 64) -> Model:
    """texts: (label, text)."""
    labels = sorted({lang for lang, _ in texts})
    k = len(labels)
    m = Model(labels, np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    if not k:
        return m
    rng = np.random.default_rng(seed)
    W = words(pc.utf8_lower(pa.array([t for _, t in texts], pa.string())), _LETTERS)
    number = {lang: i for i, lang in enumerate(labels)}
    y = np.array([number[lang] for lang, _ in texts])[W.doc]
    f, n = word_features(W, np.arange(len(W.start)))
    f_at = np.cumsum(n) - n
    code = {lang: np.flatnonzero((y[W.first[:-1][W.count > 0]] == i)) for i, lang in enumerate(labels)}
    starts, counts = W.first[:-1][W.count > 0], W.count[W.count > 0]
    ada = [np.full_like(x, 1e-6) for x in (m.weight, m.step, m.first)]
    total = max(batch, len(starts) * TRAIN_WORDS // 2 // span)
    for r in range(rounds):
        for _ in range(-(-total // batch)):
            seqs = []
            for _ in range(batch):
                # one text's stretch, or stretches of two or three
                row: list[int] = []
                parts = 1 + (rng.random() < 0.4) + (rng.random() < 0.2)
                for p in range(parts):
                    lang = labels[rng.integers(k)]
                    if not len(code[lang]):
                        continue
                    d = code[lang][rng.integers(len(code[lang]))]
                    want = span // parts + (p < span % parts)
                    at = starts[d] + rng.integers(max(1, counts[d] - want + 1))
                    row += list(range(at, min(at + want, starts[d] + counts[d])))
                if row:
                    row = (row * -(-span // len(row)))[:span]  # short ones are repeated, so that all have one length
                    seqs.append(row)
            s = np.array(seqs)
            flat = s.reshape(-1)
            rows = np.repeat(f_at[flat], n[flat]) + within(n[flat])
            used = f[rows]
            e = np.add.reduceat(m.weight[used], np.cumsum(n[flat]) - n[flat]).reshape(len(s), span, k)
            g_e, g_step, g_first = gradient(e, m.step, m.first, y[s])
            g_e = g_e.reshape(-1, k)
            g_w = np.stack([np.bincount(used, weights=np.repeat(g_e[:, c], n[flat]), minlength=FEATURES) for c in range(k)], 1) - 1e-6 * m.weight
            for x, g, h in zip((m.weight, m.step, m.first), (g_w, g_step - 1e-3 * m.step, g_first - 1e-3 * m.first), ada):
                h += g * g
                x += 0.2 * g / np.sqrt(h)
    return m


def label(col: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(texts, labels) sums of word posteriors and the number of words of each text; exact forward-backward over whole texts.

    Texts advance side by side, the longest first, so that step t works on those with more than t words.
    """
    W = words(pc.utf8_lower(col), _LETTERS)
    k = len(m.labels)
    total = np.zeros((W.n_docs, k))
    if not len(W.start) or not k:
        return total, W.count
    code, uniq = pd.factorize(W.hashes())
    first_of = np.empty(len(uniq), np.int64)
    first_of[code[::-1]] = np.arange(len(code))[::-1]
    f, n = word_features(W, first_of)
    e = np.empty((len(uniq), k), np.float32)
    cuts = np.concatenate(([0], np.cumsum(n)))
    size = max(1, SCORED // max(k, 4))
    for i in range(0, len(uniq), size):
        j = min(i + size, len(uniq))
        e[i:j] = np.add.reduceat(m.weight[f[cuts[i] : cuts[j]]], cuts[i:j] - cuts[i])
    e = np.exp(e - e.max(1, keepdims=True))
    order = np.argsort(-W.count, kind="stable")
    count, at = W.count[order], W.first[:-1][order]
    steps = int(count[0])
    active = np.searchsorted(-count, -np.arange(steps), "left")  # texts with more than t words
    T = np.exp(m.step - m.step.max())
    a = np.empty((len(code), k), np.float32)
    p = np.exp(m.first - m.first.max()) * e[code[at[: active[0]]]]
    p /= p.sum(1, keepdims=True)
    a[at[: active[0]]] = p
    for t in range(1, steps):
        c = active[t]
        i = at[:c] + t
        p = (p[:c] @ T) * e[code[i]]
        p /= np.maximum(p.sum(1, keepdims=True), 1e-30)
        a[i] = p
    b = np.ones((0, k))
    TT = T.T
    sums = np.zeros((len(count), k))
    for t in range(steps - 1, -1, -1):
        c = active[t]
        if len(b):
            nxt = at[: len(b)] + t + 1
            b = (e[code[nxt]] * b) @ TT
            b /= np.maximum(b.sum(1, keepdims=True), 1e-30)
        if c > len(b):
            b = np.concatenate((b, np.full((c - len(b), k), 1.0 / k)))
        g = a[at[:c] + t] * b
        sums[:c] += g / np.maximum(g.sum(1, keepdims=True), 1e-30)
    total[order] = sums
    return total, W.count


def predict(col: pa.Array, m: Model) -> tuple[list[str], np.ndarray]:
    total, n = label(col, m)
    if not m.labels:
        return [UND] * len(col), np.zeros(len(col))
    best = total.argmax(1)
    score = np.clip(total[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
    none = n == 0
    # bytes beyond ASCII need not be letters
    data_ascii = pc.match_substring_regex(pc.fill_null(col, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(~data_ascii & ~none):
        none[i] = not _letter.search(col[int(i)].as_py())
    return [UND if x else m.labels[c] for x, c in zip(none, best)], np.where(none, 0.0, score)


def train(docs: DataFrame, rows: int = TRAIN_TEXTS) -> Model:
    """From at most about `rows` texts of each language, those with the least hashes of doc_id, and a stretch of each. It is fitted in a task; only the model comes to the driver."""
    ship(docs.sparkSession)
    ok = docs.where((learn.fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    counts = ok.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return fit([])
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows / r["n"])))))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    few = ok.where(F.coalesce(u < F.element_at(share, F.col("lang")), F.lit(False)))
    # about twice the bound could only come of repeated doc_ids
    ws = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("w") - TRAIN_WORDS + 1, F.lit(1))).cast("int") + 1
    got = few.withColumn("w", ws).where(F.size("w") > 0).select("doc_id", "lang", F.array_join(F.slice("w", start, F.lit(TRAIN_WORDS)), " ").alias("t")).limit(2 * rows * len(counts))
    return learn.fitted(got.select("lang", "t"), lambda texts: fit(sorted((r["lang"], r["t"]) for r in texts)))


def identify(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=LABELLED // max(len(m.labels), 4)):
            lang, score = predict(b.column("text"), m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (learn.fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out BOOLEAN, lang_pred STRING, score DOUBLE")


def word_labels(text: str, m: Model) -> list[tuple[str, str]]:
    """The words of a text and the language of each: code-switched stretches keep their own."""
    W = words(pc.utf8_lower(pa.array([text])), _LETTERS)
    if not len(W.start) or not m.labels:
        return []
    f, n = word_features(W, np.arange(len(W.start)))
    e = np.add.reduceat(m.weight[f], np.cumsum(n) - n)
    post, _ = posteriors(e[None], m.step, m.first)
    return [(W.word(i).decode(), m.labels[c]) for i, c in enumerate(post[0].argmax(1))]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
