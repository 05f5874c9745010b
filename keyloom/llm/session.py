"""Shared folders, module shipping and row helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors, unless PYTHONPATH already does so there."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_keyloom_sent", False):
        return
    path = f"{tempfile.mkdtemp()}/keyloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "keyloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._keyloom_sent = True


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that the cluster names in spark.checkpoint.dir, removed when the driver ends if not before.

    A temporary one is used only on a local master, as in tests: elsewhere each machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/keyloom"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p, fs = _of(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def _of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """df written to a shared folder and read back: its lineage ends there, and a lost executor costs a reread."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _of(spark, path)
    fs.delete(p, True)


def fresh(columns: list[str], name: str) -> str:
    """name, or a variation of it that isn't among the columns."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name += "_"
    return name


def parallelism(spark: SparkSession, df: DataFrame) -> int:
    """Partitions for a shuffle of df's texts: the scan's, or the session's if more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
