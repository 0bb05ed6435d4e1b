"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal if they are identical after each run of white space became one space. Only ids and hashes are shuffled for the
groups; the bytes of a text move only if another row has its hash or, where the hashes of groups are too many to broadcast, a filter of
theirs takes it in by mistake (one in a hundred, until the filter is full); and then the least and the greatest text of each hash meet after
a partial aggregation, so a group that holds a third of all rows arrives as one row per task. Where least and greatest differ, the
hash has collided, and the rows of that hash are grouped by their bytes instead.

Defined cases: null text counts as empty and equals white-space-free emptiness only; a null id never stays if another row of the
group has an id; rows that repeat an id and a text are copies of one another and all carry kept = (id is the group's id); an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE_SPACE, cut, join_small, rows_with, text_or_empty


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), F.lit(WHITE_SPACE), F.lit(" "))


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", content_hash=md5_bytes) -> DataFrame:
    """One row per row of docs: the id column, keep_id, group_size, kept, text_sha256 (hex, of the normalised text).

    content_hash maps the normalised text to a binary; a weak one still gives right groups, only more slowly.
    """
    read = docs.select(F.col(id).alias("_id"), normalised(text).alias("_text")).withColumn("_hash", content_hash(F.col("_text")))
    slim = cut(read.select("_id", "_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")))
    groups = cut(slim.groupBy("_hash").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    members = rows_with(read, groups, "_hash")
    collided = cut(members.groupBy("_hash").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most")).where("_least <> _most").select("_hash"))
    if not collided.isEmpty():
        good = join_small(slim, collided, "_hash", "left_anti")
        bad = cut(rows_with(read, collided, "_hash"))
        by_bytes = bad.groupBy("_hash", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        regrouped = bad.join(by_bytes, ["_hash", "_text"]).select("_id", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    else:
        good, regrouped = slim, None
    joined = join_small(good, groups, "_hash", "left").select("_id", "text_sha256", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    out = joined if regrouped is None else joined.unionByName(regrouped)
    return out.select(F.col("_id").alias(id), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
