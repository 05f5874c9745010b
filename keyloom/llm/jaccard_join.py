"""The n-gram Jaccard join of documents, with Bayesian candidate pruning.

Sets: distinct 5-word shingles of words `[^\\x20\\x09-\\x0D]+`; a text of one to four words is one shingle.
Candidates share a MinHash band. Their MinHash values are compared some at a time: with a
uniform prior, after m of n agree the similarity is Beta(m + 1, n - m + 1), and a
pair goes as soon as the probability of reaching the threshold falls below the tolerance.
What is left is verified exactly on the shingle sets.

Texts without words (null, empty, blank) have no links, are classes of their own, and take part in no join.
Texts with the same words in a row are copies: links between them are counted, not
expanded. Rows that share doc_id and text count as copies of one another; rows that share doc_id but not
text stay apart by text. An empty table gives no rows. Class ids are the least doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import components as C
from keyloom.llm import sieve
from keyloom.llm.session import fresh, parallelism, remove, ship, written
from keyloom.llm.text import slices, windows, words

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5 values: a pair at the threshold is missed once in 20,000.
ROWS, BANDS = 5, 25
K = ROWS * BANDS
#: MinHash values compared at a time, and the probability below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-6


def prune(sketch: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return C.prune(sketch, pairs, THRESHOLD, TOLERANCE, STEP)


def verify(shingles: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    return C.similar(shingles, pairs, THRESHOLD)


def _shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how many, and the content keys."""
    W = words(col)
    h = W.hashes()
    s, n = windows(h, W.count, SHINGLE, short=True)
    e, m = C.sets(s, n)
    return e, m, C.content_keys(h, W.count)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = C.Hashes(K)
    for b in slices(batches):
        e, m, key = _shingles(b.column("text"))
        bands, sketch = C.packed(f(e, m), ROWS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), C.binary(key), pa.array(m), bands, sketch], ["doc_id", "th", "key", "n", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        e, m, _ = _shingles(b.column("text"))
        ends = np.concatenate(([0], np.cumsum(m))).astype(np.int32) * 8
        s = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(e))])
        yield pa.RecordBatch.from_arrays([b.column("uid"), s], ["key", "shingles"])


def _same(a: DataFrame, b: DataFrame, names: tuple[str, str, str, str]) -> Column:
    """Rows of one text: a's doc_id and text hash, and b's."""
    d, t, e, u = names
    return a[d].eqNullSafe(b[e]) & (a[t] == b[u])


def _place(doc_id: Column, th: Column) -> Column:
    return F.xxhash64(doc_id, th)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, key, n) of every row, and (key, weight, f, n_links) of every distinct text with words; f: doc_id and th of its class's first row."""
    spark = docs.sparkSession
    ship(spark)
    kind, parts = dict(docs.dtypes)["doc_id"], parallelism(spark, docs)
    rows = _rows(docs)
    signed, _ = written(rows.mapInArrow(_signed, f"doc_id {kind}, th BIGINT, key BINARY, n BIGINT, bands BINARY, sketch BINARY"), "signed", "uncompressed")
    # exact copies become one unit, numbered as written; a unit's first row stands for its text
    first = F.min(F.struct("doc_id", "th")).alias("f")
    units = signed.where("n > 0").groupBy("key").agg(first, F.count("*").alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    units, _ = written(units.select(F.monotonically_increasing_id().alias("uid"), "*"), "units", "uncompressed")
    near = C.near(units, BANDS, prune, parts)
    member, member_path = written(units.select("uid", "f", "n", "weight", "sketch").join(near, F.col("uid") == F.col("node")), "member", "uncompressed")
    block = C.blocks(member.select("node", "root", "n"))
    picked = member.select("uid", F.col("f.doc_id").alias("d"), F.col("f.th").alias("t"))
    # only rows that the members' bitmap lets through are shuffled; repeated rows give a set again
    some = rows.where(sieve.passes(_place(F.col("doc_id"), F.col("th")), sieve.bitmap(picked.select(_place(F.col("d"), F.col("t")).alias("h")))))
    text = some.join(picked.hint("merge"), _same(some, picked, ("doc_id", "th", "d", "t"))).select("uid", "text")
    if _repeats(signed):
        text = text.dropDuplicates(["uid"])
    ready = block.join(member.select(F.col("uid").alias("key"), "weight", "sketch"), "key").join(text.mapInArrow(_sets, "key BIGINT, shingles BINARY"), "key")
    links, final = C.linked(ready, prune, verify)
    u = units.select("uid", "key", "weight", "f").join(links.withColumnRenamed("key", "uid"), "uid", "left").join(final.withColumnRenamed("node", "uid"), "uid", "left")
    u = u.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1).drop("links")
    # units without a link are classes of their own
    alone = u.where("root IS NULL").select("key", "weight", "f", "n_links")
    some = u.where("root IS NOT NULL")
    least = some.groupBy("root").agg(F.min("f").alias("least"), F.count("*").alias("__size"))
    some = C.meet(some, least, "root", "__size").select("key", "weight", F.col("least").alias("f"), "n_links")
    resolved, _ = written(alone.unionAll(some), "resolved")
    remove(spark, member_path)
    return signed.select("doc_id", "th", "key", "n"), resolved


def _repeats(signed: DataFrame) -> bool:
    """Whether a row occurs more than once."""
    return bool(signed.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1").limit(1).count())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, is_first): a row for each row of docs (doc_id, text).

    n_links: other rows with a similarity of at least 0.8; is_first: whether the row is the least of its class by doc_id and text hash.
    """
    signed, units = _resolved(docs)
    none = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("is_first"))
    j = C.meet(signed.where("n > 0"), units, "key", "weight")
    own = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))
    return none.unionAll(j.select("doc_id", F.col("f.doc_id").alias("class_id"), "n_links", own.alias("is_first")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns kept: the first by doc_id and text hash; of repeated rows, one.

    Most rows stay. Those that may have to go are told by a bitmap; only they are shuffled.
    """
    signed, units = _resolved(docs)
    j = C.meet(signed.where("n > 0"), units, "key", "weight")
    stays = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))
    row = j.select("doc_id", "th", stays.alias("stays"))
    id_, th, copies = (fresh(docs.columns, f"__{x}") for x in ("id", "th", "copies"))
    here = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    twice = signed.where("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1")
    if not twice.limit(1).count():
        gone, _ = written(row.where("NOT stays").select(F.col("doc_id").alias(id_), F.col("th").alias(copies)), "gone")
        maybe = sieve.passes(_place(F.col("doc_id"), F.col(th)), sieve.bitmap(gone.select(_place(F.col(id_), F.col(copies)).alias("h"))))
        marked = here.withColumn(id_, maybe)
        stay, ask = marked.where(~F.col(id_)).drop(id_), marked.where(F.col(id_)).drop(id_)
        left = ask.join(gone.hint("merge"), _same(ask, gone, ("doc_id", th, id_, copies)), "left_anti")
        return stay.unionAll(left).drop(th)
    # repeated rows: every row that stays or has no words is kept once for each class
    kept = row.where("stays").select(F.col("doc_id").alias(id_), F.col("th").alias(copies)).distinct()
    some = here.join(kept, _same(here, kept, ("doc_id", th, id_, copies)), "left_semi").dropDuplicates(["doc_id", th])
    blank = here.where(~F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return some.unionAll(blank).drop(th)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[o + 1 : o + 5], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) u(o)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT a AS doc_id, a AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
k AS (SELECT doc_id, min(to_id) AS class_id FROM r GROUP BY 1), l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(class_id, doc_id) = doc_id AS is_first FROM d LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
"""
