"""A corpus pipeline of five stages; each is one operator of tidemark.llm applied to all that the stage before has kept.

A stage is a function of (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and reads them again for the next, after which the rows before them go. All stages but the last return the columns of documents.

Language ID drops the documents that it rejects. Near-dedup, on five-word shingles at a similarity of 0.8, keeps the document with the
smallest id of each group. Decontamination drops documents that hold ten consecutive words of a benchmark item, or a whole shorter
item. Mixing returns a row for each copy that the mix takes; the last copy of a source may be cut, and n_chars follows its text.
Sharding returns, for each row, its id, size, shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language, mixing, near_dedup, sharding
from tidemark.llm.common import remove, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identify(docs).where("_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.materialize(mixing.mix(docs))
    cut = F.col("_take") < F.col("_words")
    return rows.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, 24, law="rows")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language models, hashed sampling keys and label propagation have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            remove(spark, before)
        before = path
    return docs
