"""Changes to stored tables as pure functions of the old table and the new rows; a sink writes the result to a new path and swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import pair_key
from tidemark.session import cut


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *, preserve: Sequence[str] = (), fill: Sequence[str] = (), guarded: dict[str, Column] | None = None) -> DataFrame:
    """old merged with new by keys. A new row's values win, but: `preserve` keeps the old value of a row that exists; `fill` keeps it
    where the new one is null; `guarded` keeps it where the condition on the old row (columns as old_<c>) holds."""
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a = old.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys])
    b = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys])
    both = a.join(b, list(keys), "full")
    out = []
    for c in columns:
        if c not in new.columns or c not in old.columns:
            out.append(F.col(f"old_{c}" if c in old.columns else f"new_{c}").alias(c))
            continue
        value = F.coalesce(f"new_{c}", f"old_{c}") if c in fill else F.col(f"new_{c}")
        keep = F.col("_new").isNull()
        if c in preserve:
            keep = keep | F.col("_old").isNotNull()
        if guarded and c in guarded:
            keep = keep | (F.col("_old").isNotNull() & F.coalesce(guarded[c], F.lit(False)))
        out.append(F.when(keep, F.col(f"old_{c}")).otherwise(value).alias(c))
    return both.select(*keys, *out)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those of the new rows whose key it lacks, once each."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def dedupe_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by order, with n_rows and n_versions (distinct contents). By max over structs, so no key is sorted."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    out = rows.groupBy(*keys).agg(F.max(packed).alias("_last"), F.count("*").alias("n_rows"), F.countDistinct(F.struct(*rest)).alias("n_versions"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*order, *rest)], "n_rows", "n_versions")


def assign_ids(old: DataFrame, new: DataFrame, *, id: str = "id", order: Sequence[str]) -> DataFrame:
    """new with ids after the largest of old, in the given order. Rows are numbered through counts per range of the order, so that no
    task sees all of them."""
    top = old.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    ranged = cut(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # partition ids must not change between uses
    inside = Window.partitionBy("_part").orderBy(*order)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))
    return numbered.withColumn(id, (F.col("_top") + F.col("_before") + F.col("_i")).cast("long")).drop("_top", "_before", "_i", "_part")


def backfill_first_day(fighters: DataFrame, bouts: DataFrame) -> DataFrame:
    """fighters with debut: the first day of any of their completed bouts, where it is missing or later."""
    days = bouts.where("status = 'completed'").select("day", F.explode(F.array("red", "blue")).alias("fighter")).groupBy("fighter").agg(F.min("day").alias("_first"))
    return fighters.join(days, "fighter", "left").withColumn("debut", F.least("debut", "_first")).drop("_first")


def swap_cancel(scheduled: DataFrame, cards: DataFrame) -> DataFrame:
    """Scheduled bouts after new cards came (both: event_id, red, blue, ...): a stored pair that the card still has stays; a stored one
    that shares a fighter with another pair of the same event's card is cancelled; pairs that weren't stored come as scheduled."""
    old = scheduled.select("*", *pair_key("red", "blue"))
    new = cards.select("*", *pair_key("red", "blue"))
    same = old.join(new.select("event_id", "_low", "_high"), ["event_id", "_low", "_high"], "left_semi").select("bout_id", F.lit(True).alias("_same"))
    fresh = new.join(old.select("event_id", "_low", "_high"), ["event_id", "_low", "_high"], "left_anti")
    busy = fresh.select("event_id", F.explode(F.array("red", "blue")).alias("fighter")).distinct()
    hit = scheduled.select("event_id", "bout_id", F.explode(F.array("red", "blue")).alias("fighter")).join(busy, ["event_id", "fighter"], "left_semi").select("bout_id").distinct().withColumn("_hit", F.lit(True))
    kept = scheduled.join(same, "bout_id", "left").join(hit, "bout_id", "left")
    kept = kept.withColumn("status", F.when(F.col("_same").isNull() & F.col("_hit").isNotNull() & (F.col("status") == "scheduled"), "cancelled").otherwise(F.col("status"))).drop("_same", "_hit")
    return kept.unionByName(fresh.drop("_low", "_high").withColumn("status", F.lit("scheduled")), allowMissingColumns=True)


def claim(rows: DataFrame, claims: DataFrame, *, key: str, column: str) -> DataFrame:
    """rows whose null `column` is set from claims (key, column); a value that another row has already isn't claimed twice."""
    taken = rows.where(F.col(column).isNotNull()).select(column).distinct()
    free = claims.join(taken, column, "left_anti").groupBy(key).agg(F.min(column).alias("_claim"))
    return rows.join(free, key, "left").withColumn(column, F.coalesce(column, "_claim")).drop("_claim")
