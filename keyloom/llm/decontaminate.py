"""Benchmark decontamination by suffix arrays of the training text.

Documents are taken shard by shard (some MB of text in a task). A shard's suffix array
holds the positions whose next words could begin a match at all, which the
benchmark's words and word pairs tell, sorted by their words as far as a window
reaches. Every test suffix is then binary-searched in it; the range
found is where that window occurs. Neighbouring windows of an item that occur one after
the other make up the longest verbatim match.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, compared by 64-bit hashes. A null, empty or
wordless document has n_words 0 and isn't contaminated; an item without words has no window. Items with
the same text all count, rows with the same item_id once. A repeated document gets a row each time. An empty benchmark finds nothing.

A benchmark beyond BLOCK_BYTES is searched block by block. The corpus is still scanned once: a bitmap of the hashes of all
windows, of fixed size, tells which documents may hold one at all, and the blocks are searched in those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import sieve
from keyloom.llm.session import fresh, ship, written
from keyloom.llm.text import ALNUM_WORDS, Words, slices, windows, within, words

WINDOW = 13
#: Bytes of benchmark text that tasks get at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
_FILTER = 1 << 20
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_END, _TOP = 0, 0xFFFFFFFF


@dataclass
class Bench:
    ids: list[str]
    vocab: np.ndarray  #: sorted word hashes; code = place + 1
    flags: np.ndarray  #: by the low bits of a word's hash: may it be in the vocabulary
    pairs: np.ndarray  #: by a hash of two codes: may one follow the other
    keys: np.ndarray  #: distinct windows, (m, window) codes
    length: np.ndarray  #: words of each
    at_key: np.ndarray  #: windows' occurrences in items, sorted by window: where each window's begin
    item: np.ndarray
    offset: np.ndarray
    window: int

    @classmethod
    def of(cls, ids: list[str], texts: list[str | None], window: int = WINDOW) -> Bench:
        W = words(pa.array(texts, pa.string()), ALNUM_WORDS)
        h = W.hashes(lower=True)
        vocab = np.unique(h)
        code = (np.searchsorted(vocab, h) + 1).astype(np.int64)
        n = np.where(W.count >= window, W.count - window + 1, (W.count > 0).astype(np.int64))
        item = np.repeat(np.arange(W.n_docs), n)
        offset = within(n)
        length = np.minimum(W.count, window)[item]
        first = W.first[:-1][item] + offset
        keys = _rows(code, first, first + length, window)
        keys, code_of = np.unique(keys, axis=0, return_inverse=True) if len(keys) else (keys, np.zeros(0, np.int64))
        code_of = code_of.reshape(-1)
        order = np.lexsort((offset, item, code_of))
        flags = np.zeros(_FILTER, bool)
        flags[(vocab & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        pairs = np.zeros(1 << 22, bool)
        d = W.doc
        same = np.flatnonzero(d[1:] == d[:-1])
        pairs[_pair(code[same], code[same + 1])] = True
        return cls(ids, vocab, flags, pairs, keys, (keys != _END).sum(1), np.searchsorted(code_of[order], np.arange(len(keys) + 1)), item[order], offset[order], window)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << 22) - 1)


def _rows(code: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """k codes from each first on; _END from last on."""
    out = np.zeros((len(first), k), np.uint32)
    for i in range(k):
        ok = first + i < last
        out[ok, i] = code[first[ok] + i]
    return out


def _text(rows: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings in the same order."""
    k = rows.shape[1]
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * k}").reshape(-1)


def search(col: pa.Array, bench: Bench) -> dict:
    """Of a shard: n_words by document; hits: merged word spans (doc, from, to); pairs (doc, item); the longest match of each hit document."""
    W = words(col, ALNUM_WORDS)
    none = {"n_words": W.count, "spans": np.zeros((0, 3), np.int64), "items": np.zeros((0, 2), np.int64), "longest": {}}
    if not len(bench.keys) or not len(W.start):
        return none
    h = W.hashes(lower=True)
    code = np.zeros(len(h), np.int64)
    maybe = np.flatnonzero(bench.flags[(h & np.uint64(_FILTER - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(bench.vocab, h[maybe]), len(bench.vocab) - 1)
    code[maybe] = np.where(bench.vocab[at] == h[maybe], at + 1, 0)
    first, doc = W.first, W.doc
    last = first[1:][doc]
    # words that could follow one another in an item, counted from each position on
    chained = np.zeros(len(code), bool)
    chained[:-1] = (code[:-1] > 0) & (code[1:] > 0) & bench.pairs[_pair(code[:-1], code[1:])]
    chained[first[1:][W.count > 0] - 1] = False
    stop = np.where(chained, len(code), np.arange(len(code)))
    run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(code)) + 1
    sa = np.flatnonzero((code > 0) & (run >= bench.length.min()))
    if not len(sa):
        return none
    suffixes = _text(_rows(code, sa, last[sa], bench.window))
    order = np.argsort(suffixes, kind="stable")
    sa, suffixes = sa[order], suffixes[order]
    top = bench.keys.copy()
    top[top == _END] = _TOP
    lo, hi = np.searchsorted(suffixes, _text(bench.keys), "left"), np.searchsorted(suffixes, _text(top), "right")
    n = hi - lo
    if not n.sum():
        return none
    key = np.repeat(np.arange(len(n)), n)
    pos = sa[np.repeat(lo, n) + within(n)]
    edge = np.bincount(pos, minlength=len(code) + 1) - np.bincount(pos + bench.length[key], minlength=len(code) + 1)
    inside = np.cumsum(edge[:-1]) > 0
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & (doc[1:] == doc[:-1]))))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:] & (doc[1:] == doc[:-1]), [False]))) + 1
    base = first[doc[begins]]
    spans = np.stack((doc[begins], begins - base, ends - base), 1)
    # each occurrence of a window in an item, met by each place in the shard
    m = np.diff(bench.at_key)[key]
    occ = np.repeat(bench.at_key[key], m) + within(m)
    p, item, off = np.repeat(pos, m), bench.item[occ], bench.offset[occ]
    width = np.repeat(bench.length[key], m)
    items = np.unique(np.stack((doc[p], item), 1), axis=0)
    diag = p - off
    o = np.lexsort((p, diag, item))
    p, item, diag, width = p[o], item[o], diag[o], width[o]
    new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (item[1:] != item[:-1]) | (diag[1:] != diag[:-1])))
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate((head, [len(p)]))) - 1 + width[head]
    longest: dict[int, tuple] = {}
    for k in np.lexsort((p[head], item[head], -size)).tolist():
        d = int(doc[p[head[k]]])
        if d not in longest:
            longest[d] = (int(size[k]), int(item[head[k]]), int(p[head[k]] - first[d]))
    return {"n_words": W.count, "spans": spans, "items": items, "longest": longest}


def items_digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _benches(items: DataFrame, window: int) -> Iterator[Bench]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    b = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = sorted((b if n == 1 else b.where(part == k)).collect(), key=lambda r: (r[0] is not None, r[0]))
        yield Bench.of(["null" if r[0] is None else r[0] for r in rows], [r[1] for r in rows], window)


OUT = "n_words BIGINT, n_hit BIGINT, n_items BIGINT, items_sha256 STRING, contaminated BOOLEAN, longest_match BIGINT, longest_item STRING, longest_at BIGINT"
_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())]
_NONE = items_digest([])


def _verdicts(col: pa.Array, bench: Bench) -> list[pa.Array]:
    f = search(col, bench)
    n = len(f["n_words"])
    hit = np.bincount(f["spans"][:, 0], weights=f["spans"][:, 2] - f["spans"][:, 1], minlength=n).astype(np.int64)
    ids: dict[int, set[str]] = {}  # of items that repeat, one
    for d, i in f["items"].tolist():
        ids.setdefault(d, set()).add(bench.ids[i])
    sha, long, which, where = [_NONE] * n, [0] * n, [None] * n, [None] * n
    for d, found in ids.items():
        sha[d] = items_digest(found)
        long[d], i, where[d] = f["longest"][d]
        which[d] = bench.ids[i]
    bad = (hit > 0) & (20 * hit >= f["n_words"])
    cols = (f["n_words"], hit, [len(ids.get(d, ())) for d in range(n)], sha, bad, long, which, where)
    return [pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)]


def _table(bench: Bench, id_type: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_verdicts(b.column("text"), bench)], ["doc_id", *(c for c, _ in _FIELDS)])

    return run


def _pieces(bench: Bench):
    """Of hit documents only: what one block of a large benchmark finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SHARD_BYTES):
            f = search(b.column("text"), bench)
            rows: dict[int, tuple[list, list]] = {}
            for d, x, y in f["spans"].tolist():
                rows.setdefault(d, ([], []))[0].append([x, y])
            for d, i in f["items"].tolist():
                rows[d][1].append(bench.ids[i])
            docs = sorted(rows)
            longest = [f["longest"][d] for d in docs]
            take = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("th").take(take), pa.array([rows[d][0] for d in docs], pa.list_(pa.list_(pa.int64()))), pa.array([rows[d][1] for d in docs], pa.list_(pa.string())),
                 pa.array([x[0] for x in longest], pa.int64()), pa.array([bench.ids[x[1]] for x in longest], pa.string()), pa.array([x[2] for x in longest], pa.int64())],
                ["doc_id", "th", "spans", "items", "longest_match", "longest_item", "longest_at"],
            )

    return run


@F.pandas_udf(T.LongType())
def _covered(spans: pd.Series) -> pd.Series:
    def one(lists) -> int:
        n, reach = 0, -1
        for a, b in sorted(map(tuple, lists)):
            n += max(0, b - max(a, reach))
            reach = max(reach, b)
        return n

    return spans.map(one)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the columns of OUT for every row of docs (doc_id, text) against items (item_id, text)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    benches = _benches(items, window)
    first, second = next(benches), next(benches, None)
    if second is None:
        return rows.mapInArrow(_table(first), f"doc_id {kind}, {OUT}")
    return _by_blocks(rows, items, chain((first, second), benches)).drop("th")


def _window_hashes(W: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, and how many; short: of texts of exactly k words alone."""
    h = W.hashes(lower=True)
    if short:
        whole = W.count == k
        h, count = h[np.repeat(whole, W.count)], np.where(whole, W.count, 0)
    else:
        count = W.count
    return windows(h, count, k)


def _all_windows(window: int):
    """From items (text) the hashes of their windows; shorter items are one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            W = words(b.column("text"), ALNUM_WORDS)
            found = [_window_hashes(W, window, False)[0], *(_window_hashes(W, k, True)[0] for k in range(1, window))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    return run


def _maybe(window: int, short: list[int], bits: bytes):
    """Rows with n_words; the text only of those that hold a window that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SHARD_BYTES):
            W = words(b.column("text"), ALNUM_WORDS)
            some = np.zeros(W.n_docs, bool)
            for k in [window, *short]:
                h, n = _window_hashes(W, k, False)
                some[np.repeat(np.arange(W.n_docs), n)[sieve.held(h.view(np.int64), bits)]] = True
            text = pc.if_else(pa.array(some), b.column("text"), pa.scalar(None, b.column("text").type))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(W.count), pa.array(some), text], ["doc_id", "th", "n_words", "some", "text"])

    return run


def _by_blocks(rows: DataFrame, items: DataFrame, benches: Iterator[Bench]) -> DataFrame:
    """doc_id, th (the text's hash) and OUT: each block of a large benchmark is searched in its turn in the documents that may hold a window, and what was found of a document is put together."""
    kind = dict(rows.dtypes)["doc_id"]
    bench = next(benches)
    window = bench.window
    text = items.select(F.col("text").cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(_WORD))
    short = sorted(r[0] for r in text.select(n.alias("n")).where(f"n > 0 AND n < {window}").distinct().collect())  # lengths below the window's
    bits = sieve.bitmap(text.mapInArrow(_all_windows(window), "h BIGINT"))
    keyed, _ = written(rows.withColumn("th", F.xxhash64("text")).mapInArrow(_maybe(window, short, bits), f"doc_id {kind}, th BIGINT, n_words BIGINT, some BOOLEAN, text STRING"), "maybe")
    some = keyed.where("some").select("doc_id", "th", "text")
    schema = f"doc_id {kind}, th BIGINT, spans ARRAY<ARRAY<BIGINT>>, items ARRAY<STRING>, longest_match BIGINT, longest_item STRING, longest_at BIGINT"
    found = None
    while bench is not None:
        one, _ = written(some.mapInArrow(_pieces(bench), schema), "found")
        found = one if found is None else found.unionAll(one)
        bench = next(benches, None)
    best = F.min(F.struct((-F.col("longest_match")).alias("less"), "longest_item", "longest_at"))
    per = found.groupBy("doc_id", "th").agg(_flat("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("best"))
    d = keyed.select("doc_id", "th", "n_words").alias("d")
    p = per.select("*", _covered("spans").alias("n_hit")).alias("p")
    j = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.th").eqNullSafe(F.col("p.th")), "left")
    hit = F.coalesce(F.col("n_hit"), F.lit(0))
    n = F.col("n_words")
    return j.select(
        "d.doc_id", "d.th", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")), 256).alias("items_sha256"), ((hit > 0) & (hit * 20 >= n)).alias("contaminated"),
        F.coalesce(-F.col("best.less"), F.lit(0)).alias("longest_match"), "best.longest_item", "best.longest_at",
    )


def _flat(c: str):
    return F.flatten(F.collect_list(c)).alias(c)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of an item, however long they are; all columns kept. A row goes by its own text, so rows that share a doc_id may part."""
    spark = docs.sparkSession
    ship(spark)
    benches = _benches(items, window)
    first, second = next(benches), next(benches, None)
    if second is not None:
        d, t, th = (fresh(docs.columns, f"__{x}") for x in ("d", "t", "th"))
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        bad = _by_blocks(rows, items, chain((first, second), benches)).where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
        here = docs.withColumn(th, F.xxhash64(docs["text"].cast("string")))
        return here.join(bad, here["doc_id"].eqNullSafe(bad[d]) & (here[th] == bad[t]), "left_anti").drop(th)

    @F.arrow_udf("boolean")
    def bad(text: pa.Array) -> pa.Array:
        b = pa.RecordBatch.from_arrays([text.cast(pa.string())], ["text"])
        return pa.concat_arrays([_hit(x.column("text"), first) for x in slices([b], limit=SHARD_BYTES)])

    flag = fresh(docs.columns, "__bad")
    return docs.withColumn(flag, bad(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)


def _hit(col: pa.Array, bench: Bench) -> pa.Array:
    f = search(col, bench)
    out = np.zeros(len(f["n_words"]), bool)
    out[f["spans"][:, 0]] = True
    return pa.array(out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item, w, least({WINDOW}, len(w)) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item, o, k, array_to_string(w[o + 1 : o + k], ' ') AS g FROM b, unnest(range(0, len(w) - k + 1)) u(o)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM b) ks, unnest(range(0, greatest(len(w) - k + 1, 0))) u(p)),
m AS (SELECT doc_id, p, dw.k, item, o FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
cov AS (SELECT doc_id, count(DISTINCT x) AS n FROM m, unnest(range(p, p + k)) u(x) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY encode(item)) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
isl AS (SELECT *, p - o AS diag, p - row_number() OVER (PARTITION BY doc_id, item, p - o ORDER BY p) AS grp FROM m),
run AS (SELECT doc_id, item, count(*) - 1 + k AS size, min(p) AS pos FROM isl GROUP BY doc_id, item, diag, grp, k),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, encode(item), pos) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated, CAST(coalesce(size, 0) AS BIGINT) AS longest_match, item AS longest_item, CAST(pos AS BIGINT) AS longest_at
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN best USING (doc_id)
"""
