"""Price snapshots as a stream: duplicates go within a watermark, batches are merged into a stored table.

An extension: the batch pipeline reaches the same table by idempotent merges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranged
from tidemark.session import shared_dir


def deduplicated(prices: DataFrame, keys: list[str], at: str = "collected_at", delay: str = "1 hour") -> DataFrame:
    return prices.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def merge_stream(prices: DataFrame, folder: str, keys: list[str], checkpoint: str, order: str | None = None):
    """Merges every micro-batch into the table under folder, which lies in ranges of the first key: a batch rewrites the files that it
    changes, and one that is run again after a failure changes nothing. Of a batch's rows with one key the last in `order` counts, whole
    (of equals the largest, so reruns agree); a stored row that is later in `order` than a new one stays."""
    def write(batch: DataFrame, epoch: int) -> None:
        values = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max(F.struct(*([order] if order else []), *[c for c in values if c != order])).alias("_last"))
        new = last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values]) if values else last.select(*keys)
        later = {c: F.col(f"old_{order}") > F.col(f"new_{order}") for c in values} if order else None
        ranged.merge(new, folder, keys, guarded=later)

    return prices.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_prices(spark: SparkSession, source: str, schema, keys: list[str], select, at: str = "collected_at", order: str | None = None, files: int = 8) -> DataFrame:
    """Runs the stream over the files under source, `files` at a time, until all are read, and returns the merged table."""
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = merge_stream(deduplicated(select(stream), [*dict.fromkeys([*keys, at])], at), f"{top}/table", keys, f"{top}/state", order)
    query.awaitTermination()
    return ranged.read(spark, f"{top}/table")
