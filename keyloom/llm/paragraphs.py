"""Substring deduplication by paragraphs: MinHash banding, exact verification, components.

A paragraph is a stretch of a \\n-split line, cut where the text itself says: after a word that ends in `.`, `!` or `?`, if the sentence that
it ends has LONG_SENTENCE words or more. So a passage inside a longer line gives the same paragraphs wherever it stands.
Paragraphs with MIN_WORDS words or more are compared; shorter ones (titles, licence lines, list items) repeat without being copies of
a passage. Sets: distinct 5-word shingles of words `[^\\x20\\x09-\\x0D]+`. Fourteen bands of three MinHash values let a pair at 0.8 slip once in
23,000 and one at 0.9 once in 80 million; what collides is compared by sketch, and what is left is verified by exact Jaccard similarity. Of each
component of similar paragraphs the first by (doc_id, text hash, line, piece) stays, the others are removed.

Paragraphs with the same words are one unit from the start, so copies make no pairs. Null, empty and
blank texts have no paragraphs. Repetitions within a document count too. Rows that share doc_id
are told apart by their texts' hash; of rows that repeat as a whole, the paragraphs of one stay at most. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm import components as C
from keyloom.llm import sieve
from keyloom.llm.jaccard_join import SHINGLE, THRESHOLD, _place, _rows, _same, verify
from keyloom.llm.session import fresh, parallelism, remove, ship, written
from keyloom.llm.text import Words, slices, windows, within, words

MIN_WORDS, LONG_SENTENCE = 16, 10
ROWS, BANDS = 3, 14
K = ROWS * BANDS
TOLERANCE = 1e-6
_ENDS = b".!?"
#: Bytes of text that are cut and hashed at a time.
SLICE = 2 << 20


def prune(sketch: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return C.prune(sketch, pairs, THRESHOLD, TOLERANCE, K)


def cuts(W: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each paragraph, short ones too: its first word, its line in the text, and its number in the line. Words of texts without any are none."""
    n = len(W.start)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    breaks = np.concatenate(([0], np.cumsum(W.data == 10)))
    line = breaks[W.start] - np.repeat(breaks[W.off[:-1]], W.count)
    new_line = np.ones(n, bool)
    new_line[1:] = (line[1:] != line[:-1]) | (np.diff(W.doc) > 0)
    ends = np.isin(W.data[W.end - 1], list(_ENDS))
    begins = new_line.copy()
    begins[1:] |= ends[:-1]
    sentence = np.flatnonzero(begins)
    size = np.diff(np.concatenate((sentence, [n])))
    cut = new_line.copy()
    after = (sentence + size)[ends[sentence + size - 1] & (size >= LONG_SENTENCE)]
    cut[after[after < n]] = True
    first = np.flatnonzero(cut)
    heads = np.flatnonzero(new_line[first])
    piece = np.arange(len(first)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(first)]))))
    return first, line[first], piece


def _paragraphs(W: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line, piece, first word and number of words of the paragraphs that are compared."""
    first, line, piece = cuts(W)
    n = np.diff(np.concatenate((first, [len(W.start)])))
    at = np.flatnonzero(n >= MIN_WORDS)
    return W.doc[first[at]], line[at], piece[at], first[at], n[at]


def _only(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the words of some paragraphs."""
    return h[np.repeat(first, n) + within(n)]


def _found(signed: bool):
    f = C.Hashes(K, seed=7) if signed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            W = words(b.column("text"))
            doc, line, piece, first, n = _paragraphs(W)
            h = _only(W.hashes(), first, n)
            d = pa.array(doc)
            more = C.packed(f(*windows(h, n, SHINGLE)), ROWS) if signed else ()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(d), b.column("th").take(d), pa.array(line.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(n.astype(np.int32)), C.binary(C.content_keys(h, n)), *more],
                ["doc_id", "th", "para", "piece", "n_words", "key", *(("bands", "sketch") if signed else ())],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, picked: [(uid, para, piece)]) to (key, shingles)."""
    for b in slices(batches, limit=SLICE):
        W = words(b.column("text"))
        doc, line, piece, first, n = _paragraphs(W)
        place = {x: k for k, x in enumerate(zip(doc.tolist(), line.tolist(), piece.tolist()))}
        picked = [(x["uid"], place[d, x["para"], x["piece"]]) for d, xs in enumerate(b.column("picked").to_pylist()) for x in xs]
        at = np.array([k for _, k in picked], np.int64)
        e, m = C.sets(*windows(_only(W.hashes(), first[at], n[at]), n[at], SHINGLE))
        ends = np.concatenate(([0], np.cumsum(m))).astype(np.int32) * 8
        s = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(e))])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in picked], pa.int64()), s], ["key", "shingles"])


def _copies(docs: DataFrame) -> DataFrame | None:
    """(doc_id, th, copies) of every distinct row, or None if no row occurs more than once."""
    n = _rows(docs).groupBy("doc_id", "th").agg(F.count("*").alias("copies"))
    n, path = written(n, "copies")
    if n.where("copies > 1").limit(1).count():
        return n
    remove(docs.sparkSession, path)
    return None


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, th, para, piece, n_words, class_doc_id, class_para, class_piece, removed): every paragraph that has a copy or near copy.

    th: xxhash64 of the text; para and piece: its line, and its number in the line. The class columns name the paragraph that stays.
    Of a row that occurs k times, each paragraph is given k times; one of them stays at most.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, parts = dict(docs.dtypes)["doc_id"], parallelism(spark, docs)
    rows, copies = _rows(docs), _copies(docs)
    place = f"doc_id {kind}, th BIGINT, para INT, piece INT, n_words INT, key BINARY"
    signed = rows.mapInArrow(_found(True), f"{place}, bands BINARY, sketch BINARY")
    # one unit for each distinct paragraph; their numbers are fixed by being written
    first = F.min(F.struct("doc_id", "th", "para", "piece")).alias("f")
    units = signed.groupBy("key").agg(first, F.count("*").alias("weight"), F.first("n_words").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    units, _ = written(units.select(F.monotonically_increasing_id().alias("uid"), "key", "f", "weight", "n", "bands", "sketch"), "units", "uncompressed")
    near = C.near(units, BANDS, prune, parts)
    member, member_path = written(units.select("uid", "f", "n", "weight", "sketch").join(near, F.col("uid") == F.col("node")), "member", "uncompressed")
    block = C.blocks(member.select("node", "root", "n"))
    picked = member.groupBy(F.col("f.doc_id").alias("d"), F.col("f.th").alias("t")).agg(F.collect_list(F.struct("uid", "f.para", "f.piece")).alias("picked"))
    some = rows.where(sieve.passes(_place(F.col("doc_id"), F.col("th")), sieve.bitmap(picked.select(_place(F.col("d"), F.col("t")).alias("h")))))
    if copies is not None:
        some = some.dropDuplicates(["doc_id", "th"])
    text = some.join(picked.hint("merge"), _same(some, picked, ("doc_id", "th", "d", "t"))).select("text", "picked")
    ready = block.join(member.select(F.col("uid").alias("key"), "weight", "sketch"), "key").join(text.mapInArrow(_sets, "key BIGINT, shingles BINARY"), "key")
    _, final = C.linked(ready, prune, verify)
    tied = units.select("uid", "key", "f", "weight").join(final.withColumnRenamed("node", "uid"), "uid")
    least = tied.groupBy("root").agg(F.min("f").alias("c"), F.count("*").alias("__size"))
    flagged = C.meet(tied.select("key", "weight", "root"), least, "root", "__size").select("key", "weight", "c")
    alone = units.where("weight > 1").select("uid", "key", "weight", F.col("f").alias("c")).join(final.select(F.col("node").alias("uid")), "uid", "left_anti").drop("uid")
    flagged, _ = written(flagged.unionByName(alone), "flagged")
    remove(spark, member_path)
    # the paragraphs again, without signatures; only those that the bitmap of flagged ones lets through are shuffled
    again = rows.mapInArrow(_found(False), place)
    asked = again.where(sieve.passes(F.xxhash64("key"), sieve.bitmap(flagged.select(F.xxhash64("key").alias("h")))))
    j = C.meet(asked, flagged, "key", "weight")
    own = F.struct("doc_id", "th", "para", "piece")
    out = j.select("doc_id", "th", "para", "piece", F.col("n_words").cast("bigint").alias("n_words"), F.col("c.doc_id").alias("class_doc_id"), F.col("c.para").alias("class_para"), F.col("c.piece").alias("class_piece"), (own != F.col("c")).alias("removed"))
    if copies is None:
        return out
    # of what stays in a row that repeats, all but one go: the row is given once for itself and once for its copies
    c = copies.where("copies > 1").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "copies")
    many = out.dropDuplicates(["doc_id", "th", "para", "piece"]).join(c, _same(out, c, ("doc_id", "th", "__d", "__t")))
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("removed", F.col("removed") | (F.col("copy") > 1))
    return out.join(c, _same(out, c, ("doc_id", "th", "__d", "__t")), "left_anti").unionAll(many.select(*out.columns))


def cut_text(text: str, gone: list[tuple[int, int]] | None, everything: bool = False) -> str:
    """The text without the given (line, piece) paragraphs, or without all of them that are long enough; lines of which nothing is left go too."""
    W = words(pa.array([text]))
    first, line, piece = cuts(W)
    end = np.concatenate((first[1:], [len(W.start)]))
    want = set(gone or ())
    raw, lines = text.encode(), text.split("\n")
    starts = np.concatenate(([0], np.cumsum([len(x.encode()) + 1 for x in lines])))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, ln, p in zip(first.tolist(), end.tolist(), line.tolist(), piece.tolist()):
        by.setdefault(ln, []).append((a, b, p))
    out = []
    for k, x in enumerate(lines):
        mine = by.get(k, [])
        drop = [(a, b) for a, b, p in mine if (k, p) in want or (everything and b - a >= MIN_WORDS)]
        if not drop:
            out.append(x)
        elif len(drop) < len(mine):
            left, at = b"", int(starts[k])
            for a, b in drop:
                left += raw[at : W.start[a]]
                at = int(W.start[b]) if b < len(W.start) and W.start[b] < starts[k + 1] else int(W.end[b - 1])
            out.append((left + raw[at : starts[k + 1] - 1]).decode())
    return "\n".join(out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed paragraphs cut from their texts, all columns kept. Of repeated rows one keeps what stays, the others lose all their paragraphs."""
    found = repeated(docs).where("removed").groupBy("doc_id", "th").agg(F.collect_set(F.struct("para", "piece")).alias("gone"), F.count("*").alias("n"))
    d, t, g, c, th = (fresh(docs.columns, f"__{x}") for x in ("d", "t", "gone", "copy", "th"))
    gone = found.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(g))
    here = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series, copy: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or (y is None and k < 2) else cut_text(x, [(p["para"], p["piece"]) for p in ([] if y is None else y)], k > 1) for x, y, k in zip(text, gone, copy)], dtype=object)

    if _copies(docs) is None:
        here = here.withColumn(c, F.lit(1))
        pick = F.col(g)
    else:
        here = here.withColumn(c, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(F.lit(1))))
        # paragraphs of later copies are all removed; those of the first one only if another row has them
        kept = repeated(docs).where("NOT removed").groupBy("doc_id", "th").agg(F.collect_set(F.struct("para", "piece")).alias("kept"))
        k1, k2, k3 = (fresh([*docs.columns, d, t, g, c, th], f"__{x}") for x in ("k1", "k2", "k3"))
        gone = gone.join(kept.select(F.col("doc_id").alias(k1), F.col("th").alias(k2), F.col("kept").alias(k3)), F.col(d).eqNullSafe(F.col(k1)) & (F.col(t) == F.col(k2)), "left").withColumn(g, F.when(F.col(k3).isNull(), F.col(g)).otherwise(F.array_except(g, k3))).drop(k1, k2, k3)
        pick = F.col(g)
    j = here.join(gone, _same(here, gone, ("doc_id", th, d, t)), "left").withColumn("text", cut(F.col("text").cast("string"), pick, F.col(c)))
    return j.select(*(F.col(f"`{x}`") for x in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS para, regexp_extract_all(x[i], '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) u(i)),
t AS (SELECT doc_id, para, j, w[j] AS w, w[j] SIMILAR TO '.*[.!?]' AS ends FROM l, unnest(range(1, len(w) + 1)) u(j)),
q AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, para ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t),
z AS (SELECT *, ends AND count(*) OVER (PARTITION BY doc_id, para, sentence) >= 10 AS cut FROM q),
y AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id, para ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM z),
p AS (SELECT doc_id, para, piece, list(w ORDER BY j) AS w, string_agg(w, ' ' ORDER BY j) AS g FROM y GROUP BY 1, 2, 3 HAVING count(*) >= 16),
d AS (SELECT g, row_number() OVER (ORDER BY min((doc_id, para, piece))) AS id, any_value(w) AS w, count(*) AS rows FROM p GROUP BY 1),
s AS (SELECT DISTINCT id, array_to_string(w[o + 1 : o + 5], ' ') AS g FROM d, unnest(range(0, len(w) - 4)) u(o)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT a AS id, a AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
k AS (SELECT d.g, coalesce(min(to_id), any_value(d.id)) AS root FROM d LEFT JOIN r ON r.id = d.id GROUP BY 1),
m AS (SELECT p.doc_id, p.para, p.piece, len(p.w) AS n_words, root FROM p JOIN k USING (g)),
f AS (SELECT root, min((doc_id, para, piece)) AS c FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(piece AS INTEGER) AS piece, CAST(n_words AS BIGINT) AS n_words, c[1] AS class_doc_id, CAST(c[2] AS INTEGER) AS class_para, CAST(c[3] AS INTEGER) AS class_piece,
  (doc_id, para, piece) <> c AS removed FROM m JOIN f USING (root)
"""
