"""Bounded samples of labelled rows, and training on them in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, those with the least hashes of doc_id; `keep` is over labels.doc_id.

    The ids are chosen on labels alone and are so few that they are sent to the scan of the documents.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    p = picked.select(F.col("doc_id").alias("__id"), "label")
    # twice as many documents as ids at most, should doc_ids repeat
    return docs.join(F.broadcast(p), docs["doc_id"] == p["__id"]).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "label", F.col("doc_id").alias("id")).limit(2 * rows)


def fitted(sample: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """fit of all rows of a bounded sample, run in one task, so that only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    # an empty sample may be planned without any task
    got = sample.coalesce(1).mapInArrow(run, "model BINARY").head()
    return pickle.loads(bytes(got[0])) if got else fit([])
