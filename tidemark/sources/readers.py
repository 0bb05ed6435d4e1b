"""Readers of the raw files and the ways in and out of Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources import schemas

#: Columns of the raw files.
EVENTS = "EVENT STRING, URL STRING, DATE STRING, LOCATION STRING"
DETAILS = "FIRST STRING, LAST STRING, NICKNAME STRING, URL STRING"
TOTT = "FIGHTER STRING, HEIGHT STRING, WEIGHT STRING, REACH STRING, STANCE STRING, DOB STRING, URL STRING"
STATS = "EVENT STRING, BOUT STRING, ROUND STRING, FIGHTER STRING, KD STRING, `SIG.STR.` STRING, `SIG.STR. %` STRING, `TOTAL STR.` STRING, TD STRING, `TD %` STRING, `SUB.ATT` STRING, `REV.` STRING, CTRL STRING, HEAD STRING, BODY STRING, LEG STRING, DISTANCE STRING, CLINCH STRING, GROUND STRING"
RESULTS = "EVENT STRING, BOUT STRING, OUTCOME STRING, WEIGHTCLASS STRING, METHOD STRING, ROUND STRING, TIME STRING, `TIME FORMAT` STRING, REFEREE STRING, DETAILS STRING, URL STRING"
PAIRS = {"SIG.STR.": "sig_strikes", "TOTAL STR.": "total_strikes", "TD": "takedowns", "HEAD": "head", "BODY": "body", "LEG": "leg", "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground"}
#: Fixed value: the name of a show whose bouts are fought by candidates, outside the roster.
CANDIDATES_SHOW = "road to ufc"


def _csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).option("multiLine", False).option("enforceSchema", False).csv(path)


def _day(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(_csv(spark, path, EVENTS))


def parse_events(e: DataFrame) -> DataFrame:
    return e.select(F.trim("EVENT").alias("name"), F.trim("URL").alias("source_url"), _day(F.col("DATE"), "MMMM d, yyyy").alias("event_date"), F.trim("LOCATION").alias("location"))


def read_fighter_details(spark: SparkSession, path: str) -> DataFrame:
    return parse_fighter_details(_csv(spark, path, DETAILS))


def parse_fighter_details(d: DataFrame) -> DataFrame:
    return d.select(F.trim(F.concat_ws(" ", F.trim("FIRST"), F.trim("LAST"))).alias("real_name"), S.blank_to_null("NICKNAME").alias("nickname"), F.trim("URL").alias("source_url"))


def read_tale_of_the_tape(spark: SparkSession, path: str) -> DataFrame:
    return parse_tale_of_the_tape(_csv(spark, path, TOTT))


def parse_tale_of_the_tape(t: DataFrame) -> DataFrame:
    return t.select(F.trim("URL").alias("source_url"), S.height_cm("HEIGHT").cast("decimal(4,1)").alias("height_cm"), S.reach_cm("REACH").cast("decimal(4,1)").alias("reach_cm"), S.stance("STANCE").alias("stance"), _day(F.col("DOB"), "MMM d, yyyy", "MMMM d, yyyy").alias("dob"))


def read_fighters(details: DataFrame, tape: DataFrame) -> DataFrame:
    return details.join(tape.dropDuplicates(["source_url"]), "source_url", "left")


def read_fight_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_fight_stats(_csv(spark, path, STATS))


def parse_fight_stats(raw: DataFrame) -> DataFrame:
    """One row per fighter and round; rows without either are left out."""
    s = raw.na.drop(subset=["FIGHTER", "ROUND"])
    pairs = [f(F.col(f"`{c}`")).alias(f"{n}_{k}") for c, n in PAIRS.items() for f, k in ((S.landed, "landed"), (S.attempted, "attempted"))]
    count = lambda c: F.expr(f"try_cast(try_cast(trim(`{c}`) AS DOUBLE) AS INT)")
    return s.select(F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), F.trim("FIGHTER").alias("fighter"), S.round_number("ROUND").alias("round_number"), count("KD").alias("knockdowns"), *pairs, count("SUB.ATT").alias("sub_attempts"), count("REV.").alias("reversals"), S.clock_seconds("CTRL").alias("control_time_seconds"))


def read_fight_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_fight_results(_csv(spark, path, RESULTS))


def parse_fight_results(r: DataFrame) -> DataFrame:
    """Bouts of three or five rounds outside the candidates' show."""
    rounds = S.scheduled_rounds(F.col("`TIME FORMAT`"))
    kept = r.withColumn("scheduled_rounds", rounds).where(F.col("scheduled_rounds").isin(3, 5) & ~F.coalesce(F.lower("EVENT").contains(CANDIDATES_SHOW), F.lit(False)))
    return kept.select(F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), S.corner("BOUT", 0).alias("red"), S.corner("BOUT", 1).alias("blue"), S.winner_side("OUTCOME").alias("winner_side"), F.trim("WEIGHTCLASS").alias("weight_class"), S.is_title("WEIGHTCLASS").alias("is_title_fight"), "scheduled_rounds", F.trim("METHOD").alias("method"), F.expr("try_cast(trim(ROUND) AS INT)").alias("ending_round"), S.clock_seconds("TIME").alias("ending_time_seconds"), F.trim("DETAILS").alias("method_detail"), F.trim("URL").alias("source_url"))


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    """Cached odds documents, one JSON object per file, flattened: commence_time, home, away, book, market, last_update, name, price."""
    docs = spark.read.schema(schemas.ODDS).option("multiLine", True).json(path)
    return flatten_odds(docs)


def flatten_odds(docs: DataFrame, market: str = "h2h") -> DataFrame:
    entry = docs.select(F.explode("data").alias("e"))
    book = entry.select("e.commence_time", F.col("e.home_team").alias("home"), F.col("e.away_team").alias("away"), F.explode("e.bookmakers").alias("b"))
    offer = book.select("commence_time", "home", "away", F.col("b.title").alias("book"), F.explode("b.markets").alias("m")).where(F.col("m.key") == market)
    return offer.select("commence_time", "home", "away", "book", "m.last_update", F.explode("m.outcomes").alias("o")).select("commence_time", "home", "away", "book", "last_update", F.col("o.name").alias("name"), F.col("o.price").cast("int").alias("moneyline"))


def read_table(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    return (spark.read.schema(schemas.schema(table)) if table else spark.read).parquet(path)


def read_unknown(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose types are found from its values, for a first look (quality.profile); it is read twice."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def register_views(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str = "id", partitions: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in parallel ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT min({key}) AS a, max({key}) AS b FROM {table}").load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.options(dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions)).load()


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table each, replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_splits(df: DataFrame, folder: str) -> None:
    """train and val together, partitioned by split; test under a path of its own, so that it can be locked."""
    df.where("split <> 'test'").write.mode("overwrite").partitionBy("split").parquet(f"{folder}/open")
    df.where("split = 'test'").write.mode("overwrite").parquet(f"{folder}/locked/test")


def quarantine(rows: DataFrame, folder: str, reason: str) -> None:
    """Rejected rows as JSON lines, appended."""
    rows.withColumn("reason", F.lit(reason)).write.mode("append").json(folder)
