"""The corpus pipeline: toxicity, near-duplicate join, decontamination, source mix, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, jaccard_join, mixing, tokens, toxicity
from keyloom.llm.session import folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grader, fitted on the labelled rows among docs, finds toxic go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays."""
    return jaccard_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, long ones too. Null and empty texts stay, as all do if the benchmark is empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; the one at the cut is shortened. Those without words aren't taken. A null source is one of its own."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the token format; a row for each document as read back from the files."""
    out = folder(spark, "pipeline_tokens")
    tokens.write(docs, out)
    return tokens.digests(spark, out)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids)]

#: The toxicity model is trained, and the tokenizer is no SQL function; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = folder(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
