"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Every document is scored against all others: its own n-grams are taken off the counts. For n = ORDER
down to 1 the first n-gram of a word that others hold gives count(n-gram) / count(context), times
BACKOFF for each step down; a word that nobody else has counts as one. The document's
score is the sum of the logarithms.

The count tables are partitioned by n-gram hash. Documents lie in chunks (by a hash of doc_id and text, so of
even size); a chunk explodes its n-grams and adds them up before anything is shuffled, and sends
(hash range, its distinct n-grams, their counts) as packed columns to the ranges in which it has any. A hash range adds up what all chunks sent
it, joins the totals back to each chunk's n-grams, and returns what all other chunks hold of them in the same order. A common n-gram costs
one entry a chunk, never a row an occurrence, so no partition is hot. A row holds one n-gram at least, so rows are never more than
a plain table of (chunk, n-gram, count) has: as the input grows, they grow with its square only until they hold one n-gram each, and in proportion from there on.

Words and bigrams go first. A longer n-gram is asked for once the totals of its two (n-1)-grams are there, and only if other
documents hold both: if they don't, none can hold the n-gram, and its count is zero without asking. Whoever else holds it holds
both parts too and asks as well, so totals are whole.

Words are `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have no words and score 0. Repeated rows score one another. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.session import parallelism, ship
from keyloom.llm.text import slices, windows, words

ORDER, BACKOFF = 3, 0.4
#: Bytes of text for each chunk, and for each hash range.
CHUNK_BYTES = 13 << 20


def _grams(col: pa.Array, order: int, least: int = 1):
    """For n = 1..order: how many n-grams each text has, the distinct ones, their counts, and the codes of all in document order; None below least."""
    W = words(col)
    h = W.hashes()
    out = []
    for n in range(1, order + 1):
        if n < least:
            out.append(None)
            continue
        g, m = (h, W.count) if n == 1 else windows(h, W.count, n)
        code, uniq = pd.factorize(g)
        del g
        rank = np.argsort(uniq)
        place = np.empty(len(uniq), np.int32)
        place[rank] = np.arange(len(uniq), dtype=np.int32)
        code = place[code] if len(code) else code.astype(np.int32)
        out.append((m, uniq[rank], np.bincount(code, minlength=len(uniq)).astype(np.uint32), code))
    return W.count, out


def _text(t: pa.Table) -> pa.Array:
    return t.column("text").cast(pa.large_string()).combine_chunks() if t.num_rows else pa.array([], pa.large_string())


def _cuts(uniq: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash space ends among sorted hashes."""
    edges = ((np.arange(1, ranges, dtype=object) << 64) // ranges).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(uniq, edges), [len(uniq)]))


_CODEC = pa.Codec("zstd", 1)


def _pack(a: np.ndarray) -> bytes:
    """How many values, and the first bytes of all, then the second ones, and so on, compressed: small numbers take few bits each."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(a).to_bytes(4, "little") + _CODEC.compress(planes, asbytes=True)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(b[:4], "little")
    planes = np.frombuffer(_CODEC.decompress(b[4:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def _requests(chunk: int, n: int, uniq: np.ndarray, count: np.ndarray, ranges: int) -> list[tuple]:
    """A row for each hash range where the chunk has n-grams: the gaps between its sorted ones, and their counts."""
    at = _cuts(uniq, ranges)
    return [(chunk, n, r, _pack(np.diff(uniq[a:b], prepend=np.uint64(0)).astype("<u8")), _pack(count[a:b].astype("<u4"))) for r, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]


_SENT = ["chunk", "n", "part", "grams", "counts"]
_SENT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_SENT), _SENT_TYPES)], _SENT)


def _send_short(order: int, ranges: int):
    """Requests of a chunk for n up to 2."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, grams = _grams(_text(t), min(order, 2))
        return _sent([row for n, (_, uniq, count, _) in enumerate(grams, 1) for row in _requests(key[0].as_py(), n, uniq, count, ranges)])

    return run


def _send_long(n: int, ranges: int):
    """Requests of a chunk for one n from 3 on, given the totals of shorter ones."""

    def run(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        _, grams = _grams(_text(docs), n, 2)
        wanted, (_, uniq, count, _) = _wanted(grams, _others(grams, got, n - 1), n), grams[n - 1]
        del grams
        return _sent(_requests(key[0].as_py(), n, uniq[wanted], count[wanted], ranges))

    return run


def _add(key: tuple, t: pa.Table) -> pa.Table:
    """A hash range: how often other chunks hold the n-grams of each chunk, in its order."""
    n = t.column("n").to_numpy()
    chunk, grams, counts = t.column("chunk").to_pylist(), t.column("grams").to_pylist(), t.column("counts").to_pylist()
    rows = []
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k).tolist()
        g = [np.cumsum(_unpack(grams[i], "<u8"), dtype=np.uint64) for i in at]
        c = np.concatenate([_unpack(counts[i], "<u4") for i in at]).astype(np.uint64)
        code, uniq = pd.factorize(np.concatenate(g))
        elsewhere = np.bincount(code, weights=c, minlength=len(uniq)).astype("<u8")[code] - c if len(code) else c
        ends = np.cumsum([len(x) for x in g])
        rows += [(chunk[i], k, key[0].as_py(), _pack(elsewhere[e - len(x) : e])) for i, x, e in zip(at, g, ends)]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), types)], ["chunk", "n", "part", "elsewhere"])


def _own(m: np.ndarray, code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own document; count: in the chunk."""
    out = np.ones(len(code), np.int64)
    again = np.flatnonzero(count[code] > 1)
    if len(again):
        doc = np.repeat(np.arange(len(m)), m)[again]
        pair, _ = pd.factorize(doc * len(count) + code[again])
        out[again] = np.bincount(pair)[pair]
    return out


def _within(grams: list, n: int) -> np.ndarray:
    """Where the (n-1)-gram that begins an n-gram lies among the (n-1)-grams; the one that ends it comes next. A text has one more of them."""
    m, shorter = grams[n - 1][0], grams[n - 2][0]
    return np.repeat(np.cumsum(shorter) - shorter - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))


def _wanted(grams: list, others: list[np.ndarray], n: int) -> np.ndarray:
    """Whether the chunk asks for each of its distinct n-grams: other documents than one that holds it hold both its (n-1)-grams."""
    _, uniq, _, code = grams[n - 1]
    at, held = _within(grams, n), others[n - 2]
    out = np.zeros(len(uniq), bool)
    out[code[(held[at] > 0) & (held[at + 1] > 0)]] = True
    return out


def _others(grams: list, got: pa.Table, order: int) -> list[np.ndarray | None]:
    """For k = 1..order: how often the k-gram that begins at each place occurs in other documents; None where grams has none."""
    n, part, packed = got.column("n").to_numpy(), got.column("part").to_numpy(), got.column("elsewhere")
    out: list[np.ndarray | None] = []
    for k, held in enumerate(grams[:order], 1):
        if held is None:
            out.append(None)
            continue
        m, uniq, count, code = held
        at = np.flatnonzero(n == k)
        elsewhere = np.concatenate([np.zeros(0, np.uint64), *(_unpack(packed[i].as_py(), "<u8") for i in at[np.argsort(part[at])].tolist())]).astype(np.int64)
        if k > 2:
            full = np.zeros(len(uniq), np.int64)
            full[_wanted(grams, out, k)] = elsewhere  # what it did not ask for is held by no other document
            elsewhere = full
        here = count[code] - _own(m, code, count)  # in other documents of this chunk
        out.append(elsewhere[code] + here)
    return out


def _score(order: int, everything: int):
    def run(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        count, grams = _grams(_text(docs), order)
        others = _others(grams, got, order)
        doc = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        rest = np.maximum(everything - count, 0)[doc]
        score = np.where(others[0] > 0, others[0] / np.maximum(rest, 1), 1.0 / (rest + 1.0))
        for k in range(2, order + 1):
            ends = np.flatnonzero(pos >= k - 1)  # words with k - 1 before them, in the order of the k-grams
            num, den = others[k - 1], others[k - 2][_within(grams, k)]
            score[ends] = np.where(num > 0, num / np.maximum(den, 1), BACKOFF * score[ends])
        total = np.bincount(doc, weights=np.log(score), minlength=len(count)) if len(count) else np.zeros(0)
        return pa.table([docs.column("doc_id"), pa.array(count, pa.int64()), pa.array(np.round(total.astype(float), 6)), pa.array(np.round(total.astype(float) / np.maximum(count, 1), 6))], ["doc_id", "n_words", "log_score", "mean_score"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and words of the texts of a task."""
    size = [0, 0]
    for b in slices(batches):
        W = words(b.column("text"))
        size = [size[0] + len(W.data), size[1] + len(W.start)]
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in size], ["bytes", "words"])


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.select("text").mapInArrow(_sizes, "bytes BIGINT, words BIGINT").agg(F.sum("bytes"), F.sum("words")).first()
    chunks, everything = (size[0] or 0) // CHUNK_BYTES + 1, size[1] or 0
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(parallelism(docs.sparkSession, docs), "chunk")
    request, answer = "chunk INT, n INT, part INT, grams BINARY, counts BINARY", "chunk INT, n INT, part INT, elsewhere BINARY"
    back = dealt.groupBy("chunk").applyInArrow(_send_short(order, chunks), request).groupBy("part").applyInArrow(_add, answer)
    for n in range(3, order + 1):
        sent = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_send_long(n, chunks), request)
        back = back.union(sent.groupBy("part").applyInArrow(_add, answer))
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_score(order, everything), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words BIGINT, log_score DOUBLE, mean_score DOUBLE")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) u(i)),
n AS (SELECT sum(len(w)) AS n FROM d),
o1 AS (SELECT doc_id, c, count(*) AS own FROM t GROUP BY ALL), n1 AS (SELECT doc_id, c, sum(own) OVER (PARTITION BY c) - own AS n FROM o1),
o2 AS (SELECT doc_id, b, c, count(*) AS own FROM t WHERE i > 1 GROUP BY ALL), n2 AS (SELECT doc_id, b, c, sum(own) OVER (PARTITION BY b, c) - own AS n FROM o2),
o3 AS (SELECT doc_id, a, b, c, count(*) AS own FROM t WHERE i > 2 GROUP BY ALL), n3 AS (SELECT doc_id, a, b, c, sum(own) OVER (PARTITION BY a, b, c) - own AS n FROM o3),
s AS (SELECT t.doc_id, t.i, n.n - len(d.w) AS rest, x.n AS n_c, y.n AS n_b, bc.n AS n_bc, ab.n AS n_ab, abc.n AS n_abc
  FROM t JOIN d USING (doc_id) CROSS JOIN n JOIN n1 x ON x.doc_id = t.doc_id AND x.c = t.c LEFT JOIN n1 y ON y.doc_id = t.doc_id AND y.c = t.b
  LEFT JOIN n2 bc ON bc.doc_id = t.doc_id AND bc.b = t.b AND bc.c = t.c LEFT JOIN n2 ab ON ab.doc_id = t.doc_id AND ab.b = t.a AND ab.c = t.b
  LEFT JOIN n3 abc ON abc.doc_id = t.doc_id AND abc.a = t.a AND abc.b = t.b AND abc.c = t.c),
s1 AS (SELECT *, CASE WHEN n_c > 0 THEN n_c / CAST(rest AS DOUBLE) ELSE 1.0::DOUBLE / (rest + 1) END AS p1 FROM s),
s2 AS (SELECT *, CASE WHEN i < 2 THEN p1 WHEN n_bc > 0 THEN n_bc / CAST(n_b AS DOUBLE) ELSE 0.4::DOUBLE * p1 END AS p2 FROM s1),
s3 AS (SELECT doc_id, CASE WHEN i < 3 THEN p2 WHEN n_abc > 0 THEN n_abc / CAST(n_ab AS DOUBLE) ELSE 0.4::DOUBLE * p2 END AS p3 FROM s2),
r AS (SELECT doc_id, sum(ln(p3)) AS x FROM s3 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x, 0.0::DOUBLE), 6) AS log_score, round(coalesce(x, 0.0::DOUBLE) / greatest(len(w), 1), 6) AS mean_score FROM d LEFT JOIN r USING (doc_id)
"""
