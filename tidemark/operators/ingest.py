"""From parsed raw tables to tables with ids: names become fighters, rows that can't be resolved are set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import mutation, resolve
from tidemark.session import cut
from tidemark.sources import readers


def numbered(rows: DataFrame, id: str, *order: str) -> DataFrame:
    """rows with ids from 1 in the given order."""
    return mutation.assign_ids(rows.limit(0).select(F.lit(0).cast("long").alias(id)), rows, id=id, order=list(order))


def fighter_names(fighters: DataFrame, corrections: DataFrame) -> DataFrame:
    """(name, id) of fighters (fighter_id, real_name): null for a shared name. corrections (wrong, right): spellings that stand for a
    name that one fighter has; others are left out."""
    named = fighters.select(F.col("real_name").alias("name"), F.col("fighter_id").alias("id"))
    right = resolve.name_lookup(named).where("id is not null")
    fixed = corrections.join(right, F.col("right") == F.col("name")).select(F.col("wrong").alias("name"), "id")
    return resolve.name_lookup(named, overrides=fixed)


def with_fighter(rows: DataFrame, column: str, id: str, names: DataFrame, shared: DataFrame) -> DataFrame:
    """rows with the id of the fighter that a column names: by the table of shared names (name, weight_class or null, id), or else the
    only fighter of that name; null for others."""
    table = shared.withColumnRenamed("name", column)
    own = names.select(F.col("name").alias(column), F.col("id").alias("_own"))
    return resolve.collisions(rows, table, name=column).join(own, column, "left").withColumn(id, F.coalesce("resolved_id", "_own")).drop("resolved_id", "_own")


def build_bouts(results: DataFrame, events: DataFrame, names: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bouts with ids, and the results without an event or a fighter. results: as parse_fight_results gives them; events: event_id, name
    (of one name, the largest id). Bouts are numbered by source_url, event and bout."""
    known = events.groupBy(F.col("name").alias("event")).agg(F.max("event_id").alias("event_id"))
    rows = with_fighter(with_fighter(results, "red", "red_id", names, shared), "blue", "blue_id", names, shared)
    rows = cut(rows.join(known, "event", "left"))
    whole = F.col("red_id").isNotNull() & F.col("blue_id").isNotNull() & F.col("event_id").isNotNull()
    winner = F.when(F.col("winner_side") == "red", F.col("red_id")).when(F.col("winner_side") == "blue", F.col("blue_id"))
    return numbered(rows.where(whole).withColumn("winner_id", winner).drop("winner_side"), "bout_id", "source_url", "event", "bout"), rows.where(~whole)


def build_stats(stats: DataFrame, bouts: DataFrame, names: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of the bouts of the same event and card text, with bout_id and fighter_id, and those of them without a fighter. The class of
    a shared name is the bout's."""
    joined = stats.join(bouts.select("bout_id", "event", "bout", "weight_class"), ["event", "bout"])
    rows = cut(with_fighter(joined, "fighter", "fighter_id", names, shared))
    return rows.where("fighter_id is not null").drop("event", "bout", "fighter", "weight_class"), rows.where("fighter_id is null")


def load(raw: dict[str, DataFrame], corrections: DataFrame, shared: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Builds fighters, events, bouts and rounds in this order from parsed raw tables (details, tape, events, results, stats), writes each as
    Parquet and the rejected rows as JSON lines under rejected/, and returns the tables as written. shared: (name, weight_class,
    source_url)."""
    spark = raw["events"].sparkSession

    def stored(name: str, df: DataFrame) -> DataFrame:
        readers.snapshot({name: df}, folder)
        return spark.read.parquet(f"{folder}/{name}.parquet")

    out = {"fighters": stored("fighters", numbered(readers.read_fighters(raw["details"], raw["tape"]), "fighter_id", "source_url"))}
    out["events"] = stored("events", numbered(raw["events"], "event_id", "source_url"))
    names = fighter_names(out["fighters"], corrections)
    shared = shared.join(out["fighters"].select("source_url", F.col("fighter_id").alias("id")), "source_url").select("name", "weight_class", "id")
    bouts, lost = build_bouts(raw["results"], out["events"], names, shared)
    out["bouts"] = stored("bouts", bouts)
    readers.quarantine(lost, f"{folder}/rejected/bouts", "no event or fighter")
    stats, lost = build_stats(raw["stats"], out["bouts"], names, shared)
    out["stats"] = stored("stats", stats)
    readers.quarantine(lost, f"{folder}/rejected/stats", "no fighter")
    return out


def attach_ids(rows: DataFrame, ids: DataFrame, key: str, id: str = "id") -> DataFrame:
    """rows with the id of their key, or null and a line in error where there is none."""
    known = ids.groupBy(key).agg(F.min(id).alias(id))
    return rows.join(known, key, "left").withColumn("error", F.when(F.col(id).isNull(), F.concat(F.lit("no id for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))


def since(rows: DataFrame, first: str, *, day: str = "day", id: str = "id", limit: int | None = None) -> DataFrame:
    """rows from a day on, the latest first (of one day, by id), at most `limit` if it is given."""
    kept = rows.where(F.col(day) >= F.lit(first).cast("date")).orderBy(F.desc(day), id)
    return kept if limit is None else kept.limit(limit)
