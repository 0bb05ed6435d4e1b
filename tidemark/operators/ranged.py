"""Stored tables in key ranges: a merge rewrites only the files whose range holds a changed row.

Under `path`, data/ holds Parquet files, each with the rows of one range of the key, and manifest/ holds versions: tables of (file, low,
high, rows), of which the last complete one counts. A merge finds the files of its rows by the ranges' lower ends, reads these files
alone, and writes anew those in which a row changes or is added; then it writes the next version of the manifest, which is the commit.
Whatever stops before it leaves the table as it was. A batch that is merged again changes no row, so it writes nothing and the version
stays. Two merges at a time can't both write a version; the second fails. The manifest has a row per file, which the driver reads.

Defined cases: rows of a merge have a key each (a null fails) and one row per keys; a key below all ranges belongs to the first file,
one between two to the lower; a range that has outgrown `rows` is written as several files; an empty batch changes nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.mutation import upsert
from tidemark.session import cut

#: Rows of a file.
ROWS = 1_000_000


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def version(spark: SparkSession, path: str) -> int:
    """The version that counts, 0 if there is no table."""
    return max(_versions(spark, path), default=0)


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(file, low, high, rows) of a version, the last by default."""
    return spark.read.parquet(f"{path}/manifest/v{version(spark, path) if number is None else number}")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last by default."""
    return _rows(spark, path, [r["file"] for r in manifest(spark, path, number).select("file").collect()])


def _own(df: DataFrame) -> DataFrame:
    """Without the column that a path's folder adds."""
    return df.drop("_range")


def _rows(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    return _own(spark.read.parquet(*[f"{path}/data/{f}" for f in files]))


def _written(rows: DataFrame, path: str, key: str, each: int) -> DataFrame:
    """Writes rows (with _range) in files of one range each, and returns their lines of the manifest."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    parts = max(1, -(-rows.count() // each))
    rows.repartitionByRange(parts, "_range", key).sortWithinPartitions("_range", key).write.partitionBy("_range").parquet(f"{path}/data/{name}")
    back = spark.read.parquet(f"{path}/data/{name}").select(key, F.col("_metadata.file_path").alias("_at"))
    file = F.concat(F.lit(f"{name}/"), F.substring_index("_at", f"/data/{name}/", -1))
    return back.groupBy(file.alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))


def create(df: DataFrame, path: str, key: str, *, rows: int = ROWS) -> int:
    """Writes df as version 1 of a new table in files of some `rows` rows by ranges of the key."""
    checked = cut(df.withColumn("_range", F.when(F.assert_true(F.col(key).isNotNull(), F.lit("a row without a key")).isNull(), F.lit(0))))
    _written(checked, path, key, rows).coalesce(1).write.parquet(f"{path}/manifest/v1")
    return 1


def merge(new: DataFrame, path: str, keys: list[str], *, preserve: tuple[str, ...] = (), fill: tuple[str, ...] = (), guarded: dict[str, Column] | None = None, rows: int = ROWS) -> int:
    """Merges new rows by `keys`, the first of which is the key of the ranges, as mutation.upsert does, and returns the version that then
    counts. Without a table, creates it."""
    spark, key, number = new.sparkSession, keys[0], version(new.sparkSession, path)
    if number == 0:
        return create(new, path, key, rows=rows)
    lines = manifest(spark, path, number)
    ends = lines.select("file", "low").orderBy("low").collect()
    lows = [r["low"] for r in ends]

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        held = np.array(lows) if isinstance(lows[0], (int, float)) else np.array(lows, dtype=object)
        return pd.Series(np.maximum(np.searchsorted(held, values.to_numpy(), side="right") - 1, 0))

    asked = cut(new.withColumn("_range", F.when(F.assert_true(F.col(key).isNotNull(), F.lit("a row without a key")).isNull(), place(F.col(key)))))
    touched = sorted(r[0] for r in asked.select("_range").distinct().collect())
    if not touched:
        return number
    # Files of one range stand side by side in `ends`; equal lower ends are one range.
    files = [i for i, low in enumerate(lows) if any(low == lows[t] for t in touched)]
    old = _rows(spark, path, [ends[i]["file"] for i in files])
    merged = upsert(old, new, keys, preserve=preserve, fill=fill, guarded=guarded)
    columns = merged.columns
    before = old.select(F.struct(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in columns]).alias("_was"), *keys)
    compared = cut(merged.join(before, keys, "left").withColumn("_changed", ~F.struct(*columns).eqNullSafe(F.col("_was"))).drop("_was").withColumn("_range", place(F.col(key))))
    changed = sorted(r[0] for r in compared.where("_changed").select("_range").distinct().collect())
    if not changed:
        return number
    again = {i for i, low in enumerate(lows) if any(low == lows[c] for c in changed)}
    fresh = _written(compared.where(F.col("_range").isin(changed)).drop("_changed"), path, key, rows)
    kept = lines.where(~F.col("file").isin([ends[i]["file"] for i in again]))
    kept.unionByName(fresh).coalesce(1).write.parquet(f"{path}/manifest/v{number + 1}")
    return number + 1
