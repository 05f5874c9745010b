"""Relations: DataFrames of an integer key and integer payload columns."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = T.StructType([T.StructField("key", T.IntegerType(), False), T.StructField("payload", T.IntegerType(), False)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(df: DataFrame, key: str, payload: str | Column | None = None, **wide: str) -> DataFrame:
    """df as (key, payload, wide...); payload is 1 unless named. Rows with a null key can't match and are dropped at the scan."""
    pay = F.lit(1) if payload is None else F.col(payload) if isinstance(payload, str) else payload
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), pay.alias("payload"), *(F.col(c).alias(n) for n, c in wide.items()))


def read_raw(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A headerless little-endian int32 dump of keys; payload 1. Raises if the file is missing or has another number of keys.

    Keys are read some thousand at a time, as many as divide their number, and decoded as arrays.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    parts = [(str(f.getPath()), f.getLen()) for f in fs.listStatus(fs_path) if f.isFile() and f.getPath().getName()[0] not in "_."]
    held = sum(n for _, n in parts)
    if held % 4 or (expected is not None and held != 4 * expected):
        raise ValueError(f"{path} holds {held} bytes; {4 * expected if expected is not None else 'a multiple of 4'} expected")
    by: dict[int, list[str]] = {}
    for name, n in parts:
        if n:
            by.setdefault(record_bytes(n), []).append(name)
    out = spark.createDataFrame([], RELATION)
    for size, names in by.items():
        raw = spark.createDataFrame(spark.sparkContext.binaryRecords(",".join(names), size).map(lambda r: (r,)), "raw BINARY")
        out = out.unionAll(raw.mapInArrow(_decode, "key INT, payload INT"))
    return out


def record_bytes(size: int, most: int = 1 << 16) -> int:
    """The longest record of whole keys, up to `most` bytes, that a file of `size` bytes is cut into without rest."""
    n = size // 4
    return 4 * max(d for i in range(1, math.isqrt(n) + 1) if n % i == 0 for d in (i, n // i) if 4 * d <= most)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column("raw").to_pylist()), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.ones(len(keys), np.int32))], ["key", "payload"])


def write_raw(df: DataFrame, path: str, key: str = "key") -> int:
    """The keys of df as little-endian int32 part files, one for each partition; returns their number.

    Every task writes its own part and renames it when whole, so a repeated task does no harm; the driver gets one count a part. The path
    is a folder that all machines mount.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: raw files are written to mounted folders only")
    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)  # an empty table has no task that would

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        final = f"{folder}/part-{TaskContext.get().partitionId():05d}.bin"
        own, n = f"{folder}/.{uuid.uuid4().hex}", 0
        with open(own, "wb") as f:
            for b in batches:
                f.write(b.column(0).to_numpy(zero_copy_only=False).astype("<i4").tobytes())
                n += b.num_rows
        os.replace(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.select(key).mapInArrow(run, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def cached_relation(spark: SparkSession, path: str, make) -> DataFrame:
    """The relation kept under path; made and written on a miss. The path must name every parameter of make."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def show(df: DataFrame, rows: int = 1024) -> None:
    """Debug sink with a row cap."""
    df.show(rows, truncate=False)
