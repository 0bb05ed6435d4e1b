"""From feature rows to a training matrix: mirrored rows, attachments by corner, differences, splits and their checks.

Prefixes are the contract: red_/blue_ per bout, self_/opp_ per mirrored row, diff_ for differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What the opponent's side of a pair would only repeat.
MIRRORED = ("stance_matchup", "is_open_stance_matchup")


def symmetrize(bouts: DataFrame, *, drop: tuple[str, ...] = (), mirrored: tuple[str, ...] = MIRRORED) -> DataFrame:
    """Two rows per bout: red_x/blue_x become self_x/opp_x and the other way round, with source_corner and self_won (1, 0 or null).
    Columns without a corner stay; `drop` leaves out fields, `mirrored` those of the opponent that would repeat the own ones."""
    stems = [c[4:] for c in bouts.columns if c.startswith("red_") and f"blue_{c[4:]}" in bouts.columns and c[4:] not in drop]
    shared = [c for c in bouts.columns if not c.startswith(("red_", "blue_")) and c != "winner_id"]

    def side(me: str, other: str):
        fields = [F.col(f"{me}_{s}").alias(f"self_{s}") for s in stems] + [F.col(f"{other}_{s}").alias(f"opp_{s}") for s in stems if s not in mirrored]
        return F.struct(*fields, F.lit(me).alias("source_corner"), (F.col("winner_id") == F.col(f"{me}_fighter_id")).cast("int").alias("self_won"))

    return bouts.select(*shared, F.inline(F.array(side("red", "blue"), side("blue", "red"))))


def differential(matrix: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """diff_x = self_x - opp_x for numeric (or boolean) pairs other than ids, the label as 0/1, and the columns in keep."""
    kinds = {f.name: f.dataType for f in matrix.schema}
    number = lambda c: isinstance(kinds.get(c), (T.NumericType, T.BooleanType))
    stems = [c[5:] for c in matrix.columns if c.startswith("self_") and number(c) and number(f"opp_{c[5:]}") and not c.endswith("_id") and c != "self_won"]
    return matrix.select(*keep, *[(F.col(f"self_{s}").cast("double") - F.col(f"opp_{s}").cast("double")).alias(f"diff_{s}") for s in stems], F.col("self_won").cast("int").alias("self_won"))


def difference_features(matrix: DataFrame) -> list[str]:
    """The names of a differential matrix's features, without their prefix, in alphabetical order."""
    return sorted(c.removeprefix("diff_") for c in matrix.columns if c.startswith("diff_"))


def guarded_join(left: DataFrame, right: DataFrame, on: list[str], *needed: str) -> DataFrame:
    """left joined to right (one row a key); fails when it is read if a row of left finds nothing or one of the needed columns is missing."""
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    whole = F.col("_there").isNotNull()
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    return joined.where(F.assert_true(whole, F.concat_ws(" ", F.lit("nothing to join for"), *[F.col(c).cast("string") for c in on])).isNull()).drop("_there")


def attach_by_corner(matrix: DataFrame, by_bout: DataFrame, *names: str, strict: bool = True) -> DataFrame:
    """Adds self_x/opp_x from red_x/blue_x of by_bout (one row a bout). strict: a bout without a row there fails when it is read."""
    red = F.col("source_corner") == "red"
    joined = matrix.join(by_bout.select("bout_id", *[f"{c}_{n}" for n in names for c in ("red", "blue")], F.lit(True).alias("_there")), "bout_id", "left")
    if strict:
        joined = joined.where(F.coalesce(F.col("_there"), F.assert_true(F.lit(False), F.lit("a bout has nothing to attach")).isNull()))
    for n in names:
        joined = joined.withColumns({f"self_{n}": F.when(red, F.col(f"red_{n}")).otherwise(F.col(f"blue_{n}")), f"opp_{n}": F.when(red, F.col(f"blue_{n}")).otherwise(F.col(f"red_{n}"))})
    return joined.drop("_there", *[f"{c}_{n}" for n in names for c in ("red", "blue")])


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def temporal_split(df: DataFrame, train_end: str, test_start: str, day: str = "day") -> DataFrame:
    """df with split: train before train_end, test from test_start on, val between."""
    d = F.col(day)
    return df.withColumn("split", F.when(d < F.lit(train_end).cast("date"), "train").when(d < F.lit(test_start).cast("date"), "val").otherwise("test"))


def split_report(df: DataFrame, *, bout: str = "bout_id", day: str = "day", label: str = "self_won") -> DataFrame:
    """Per split: rows, bouts, bouts without exactly two rows, first and last day, mean label."""
    per_bout = df.groupBy("split", bout).agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.sum(label).alias("wins"), F.count(label).alias("labelled"))
    return per_bout.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("bouts"), F.sum((F.col("n") != 2).cast("long")).alias("broken_pairs"), F.min("first").alias("first_day"), F.max("last").alias("last_day"), (F.sum("wins") / F.sum("labelled")).alias("label_rate"))


def shared_bouts(df: DataFrame, *, bout: str = "bout_id") -> DataFrame:
    """Bouts that lie in more than one split."""
    return df.groupBy(bout).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def validate_split(df: DataFrame, **names: str) -> None:
    """Raises if a split is missing, splits overlap in time or share bouts, pairs are broken or labels aren't even."""
    rows = {r["split"]: r for r in split_report(df, **names).collect()}
    if missing := {"train", "val", "test"} - set(rows):
        raise ValueError(f"empty: {sorted(missing)}")
    for a, b in (("train", "val"), ("val", "test")):
        if rows[a]["last_day"] >= rows[b]["first_day"]:
            raise ValueError(f"{a} and {b} overlap")
    for name, r in rows.items():
        if r["broken_pairs"]:
            raise ValueError(f"{name}: {r['broken_pairs']} bouts without two rows")
        if r["label_rate"] is not None and abs(r["label_rate"] - 0.5) > 1e-12:
            raise ValueError(f"{name}: label rate {r['label_rate']}")


def year_folds(df: DataFrame, warm_up: int, *, day: str = "day") -> DataFrame:
    """Expanding folds, as rows: each row of df once for its own year's fold (role val) and once for every later year (role train).
    The years are few, so this multiplies rows by the number of folds; use `fold` to take one."""
    y = F.year(F.col(day))
    years = df.select(y.alias("val_year")).where(F.col("val_year") > warm_up).distinct()
    return df.withColumn("_y", y).join(F.broadcast(years), F.col("_y") <= F.col("val_year")).withColumn("role", F.when(F.col("_y") == F.col("val_year"), "val").otherwise("train")).drop("_y")


def fold_years(df: DataFrame, warm_up: int, *, day: str = "day") -> list[int]:
    years = sorted(r[0] for r in df.select(F.year(F.col(day))).distinct().collect() if r[0] is not None)
    later = [y for y in years if y > warm_up]
    if not years or not later:
        raise ValueError("no rows, or none after the warm-up year")
    return later


def fold(df: DataFrame, year: int, *, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Training rows before the year, validation rows in it."""
    y = F.year(F.col(day))
    return df.where(y < year), df.where(y == year)
