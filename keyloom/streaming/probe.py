"""The streaming probe: a finite or endless probe side, micro-batch by micro-batch, against a static build side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends; a temporary one on a local master alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/keyloom"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stream_probe(spark: SparkSession, build: DataFrame, probe_path: str, schema, key: str, payload: str, files_per_batch: int = 1) -> DataFrame:
    """The sum of payload products and the matches over all micro-batches.

    The aggregate's state is one row; the build side is joined as a static table and re-planned in each batch.
    """
    probe = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{probe_path}*")  # a glob: a plain path must be a folder
    s = probe.select(F.col(key).alias("key"), F.col(payload).alias("s_payload"))
    j = s.join(build.select("key", F.col("payload").alias("r_payload")), "key")
    agg = j.agg(F.count("*").alias("matches"), F.sum(F.col("r_payload").cast("bigint") * F.col("s_payload").cast("bigint")).alias("agg"))
    name = f"probe_{uuid.uuid4().hex}"
    q = agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)


def stream_materialize(spark: SparkSession, build: DataFrame, probe_path: str, schema, key: str, payload: str, out: str, files_per_batch: int = 1) -> DataFrame:
    """(segment, r_payload, s_payload): all matches, written segment by segment as the probe side arrives.

    A segment is a micro-batch. Its folder is named by the batch's number and overwritten if the batch is run again, so every match
    is there once whatever fails.
    """
    probe = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{probe_path}*")
    s = probe.select(F.col(key).alias("key"), F.col(payload).alias("s_payload"))
    j = s.join(build.select("key", F.col("payload").alias("r_payload")), "key").select("r_payload", "s_payload")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/segment={number}")

    q = j.writeStream.foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema("r_payload BIGINT, s_payload BIGINT, segment INT").parquet(out)
