"""What several training-data operators share: checkpoints, joins with a checked broadcast, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Largest row count of a side that is broadcast; sides hold a key and a few numbers, so some 10 MB at most.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset, in local runs alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, removed at the end; what is still wanted then must be cut before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder now and go on from there; a lost executor then costs no recomputation. Python gets its rows in
    small batches, so that a worker's memory stays low."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession, rows=rows):
        return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df, of at most some `rows` rows, in as few partitions as hold `each` of them: a small table that is cut again and again then costs
    a file or two each time, not one for every shuffle partition; a large one keeps its partitions."""
    wanted = -(-max(rows, 1) // each)
    return df.coalesce(wanted) if wanted < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is cut already, to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """left joined to right, which is cut already: by broadcast if it has at most `most` rows, else by a shuffle that adaptive
    execution splits where a key is hot."""
    return left.join(small_side(right, most), on, how)


#: A key filter has at most 2^FILTER_BITS bits, 32 MB, and else a hundred bits a key or more, so it is wrong for one row in a hundred at most.
FILTER_BITS = 28
#: Bits of one bitmap, as bitmap_construct_agg makes them.
MAP_BITS = 32768


def flagged(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows with `_likely`: false where their key is certainly none of the keys (a table that is cut). The keys' hashes are marked in
    bitmaps of a bounded size, which are broadcast; so wide rows need not be shuffled to learn that they meet nothing. A filter that
    has filled up only tells less."""
    bits = min(FILTER_BITS, max(15, (100 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(on), F.lit(1 << bits))
    maps = cut(keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / MAP_BITS).alias("_map")).agg(F.bitmap_construct_agg(F.col("_p") % MAP_BITS).alias("_bits")))
    met = rows.withColumn("_place", place).join(F.broadcast(maps), F.floor(F.col("_place") / MAP_BITS) == F.col("_map"), "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_place % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    likely = F.coalesce(F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1") == 1, F.lit(False))
    return met.withColumn("_byte", byte).withColumn("_likely", likely).drop("_place", "_map", "_bits", "_byte")


def _few(keys: DataFrame, most: int) -> bool:
    return keys.limit(most + 1).count() <= most


def rows_with(rows: DataFrame, keys: DataFrame, on: str, most: int | None = None) -> DataFrame:
    """The wide rows whose key is among the keys (one column, cut): by broadcast if they are few; else only likely rows are shuffled."""
    keys = keys.select(on)
    if _few(keys, BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(keys), on, "left_semi")
    return flagged(rows, keys, on).where("_likely").drop("_likely").join(keys, on, "left_semi")


def rows_without(rows: DataFrame, slim: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The wide rows whose key isn't among the keys; slim has the keys of all rows and nothing else of them, and is cut like the keys.
    Rows that are certainly without stay where they are. Which of the likely ones are without after all is found out from slim, so
    only these are shuffled."""
    keys = keys.select(on)
    if _few(keys, BROADCAST_ROWS):
        return rows.join(F.broadcast(keys), on, "left_anti")
    mistaken = cut(flagged(slim.select(on), keys, on).where("_likely").select(on).join(keys, on, "left_anti").distinct())
    return flagged(rows, keys, on).where("not _likely").drop("_likely").unionByName(rows_with(rows, mistaken, on))


def rows_left_join(rows: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Wide rows with what right (cut, one row a key) has for their key, nulls where it has nothing: by broadcast if right is small; else
    only likely rows are shuffled."""
    if _few(right, BROADCAST_ROWS):
        return rows.join(F.broadcast(right), on, "left")
    told = flagged(rows, right.select(on), on)
    return told.where("_likely").drop("_likely").join(right, on, "left").unionByName(told.where("not _likely").drop("_likely"), allowMissingColumns=True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20, rows: int | None = None) -> Iterator[None]:
    """What is written or counted inside hands rows to Python in batches of some `most` bytes, or of one row that is longer; and of at
    most `rows` rows instead of the session's number."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(most)} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shield(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns in0, in1, ..., and their names by the old ones: no column of the caller can clash with an operator's own."""
    return docs.toDF(*[f"in{i}" for i in range(len(docs.columns))]), {c: f"in{i}" for i, c in enumerate(docs.columns)}


def unshield(df: DataFrame, names: dict[str, str], **added: Column) -> DataFrame:
    """The caller's columns under their old names, then the added ones; an added column takes the place of one that has its name."""
    taken = {c.lower() for c in added}
    return df.select(*[F.col(own).alias(c) for c, own in names.items() if c.lower() not in taken], *[value.alias(c) for c, value in added.items()])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
