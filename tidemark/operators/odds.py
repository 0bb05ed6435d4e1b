"""Prices: offers resolved to bouts, the last one per book, freed of the margin, and the market's probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import resolve
from tidemark.session import cut
from tidemark.sources import readers


def closing_prices(prices: DataFrame) -> DataFrame:
    """The last price per (bout, fighter, book): raw probability, n_sides of its (bout, book) and the probability without the margin.
    The last row is an aggregate (max_by), so no snapshots are sorted; of two at one time the larger price counts. A book with one side gives 1, as n_sides shows."""
    last = prices.groupBy("bout_id", "fighter", "book").agg(F.max_by("moneyline", F.struct("collected_at", "moneyline")).alias("moneyline"), F.max("collected_at").alias("collected_at"))
    book = Window.partitionBy("bout_id", "book")  # as many rows as a bout has sides
    raw = last.withColumn("raw_prob", S.implied_probability("moneyline"))
    return raw.withColumns({"n_sides": F.count("*").over(book), "prob": F.col("raw_prob") / F.sum("raw_prob").over(book)})


def closing_line(prices: DataFrame) -> DataFrame:
    """Per (bout, fighter): the median over books of the probability without the margin, and the number of books."""
    return closing_prices(prices).groupBy("bout_id", "fighter").agg(F.median("prob").alias("market_prob"), F.count("*").alias("n_books"))


def market_baseline(matrix: DataFrame, line: DataFrame) -> DataFrame:
    """Rows of the matrix (bout_id, self, self_won) that the market covers, with market_prob."""
    return matrix.join(line, (matrix["bout_id"] == line["bout_id"]) & (matrix["self"] == line["fighter"])).select(*[matrix[c] for c in matrix.columns], "market_prob", "n_books")


def resolve_prices(docs: DataFrame, roster: DataFrame, aliases: DataFrame, bouts: DataFrame, *, days: int = 2, threshold: float = 90.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Odds documents resolved to bouts: prices (bout_id, fighter, book, moneyline, implied_prob, collected_at), new aliases (fighter_id,
    alias) and the entries without a bout (commence_time, home, away, home_resolved, away_resolved).

    A name that several fighters have stands for all of them, and the first pair of fighters with a bout near the day decides; only a
    fuzzy match that one fighter has becomes an alias. Of two equal names in an entry, both are the away side's."""
    entries = docs.select(F.explode("data").alias("e")).select("e.commence_time", F.col("e.home_team").alias("home"), F.col("e.away_team").alias("away")).distinct()
    names = entries.select(F.col("home").alias("name")).union(entries.select("away")).distinct()
    ids = F.when(F.col("fighter_id").isNotNull(), F.array("fighter_id")).otherwise(F.col("candidates"))
    who = cut(resolve.resolve_names(names, roster, aliases, threshold=threshold, fold=False).select("name", "match_type", ids.alias("ids")))
    side = lambda s, ids: who.select(F.col("name").alias(s), F.col("match_type").alias(f"{s}_match"), F.col("ids").alias(ids))
    asked = entries.join(side("home", "a_ids"), "home", "left").join(side("away", "b_ids"), "away", "left")
    keyed = asked.withColumns({"ask_id": F.struct("commence_time", "home", "away"), "day": F.try_to_date(F.substring("commence_time", 1, 10), "yyyy-MM-dd")})
    matched = cut(resolve.candidate_pairs(keyed, bouts, days=days))
    found = matched.where("bout_id is not null")
    own = F.when(F.col("name") == F.col("away"), F.col("b")).when(F.col("name") == F.col("home"), F.col("a"))
    offers = readers.flatten_odds(docs).join(found.select("commence_time", "home", "away", "bout_id", "a", "b"), ["commence_time", "home", "away"]).withColumn("fighter", own)
    prices = offers.where("fighter is not null").select("bout_id", "fighter", "book", "moneyline", S.implied_probability("moneyline").alias("implied_prob"), F.col("last_update").alias("collected_at"))
    fuzzy = lambda s, id: found.where(F.col(f"{s}_match") == "fuzzy").select(F.col(id).alias("fighter_id"), F.col(s).alias("alias"))
    known = lambda ids: F.coalesce(F.size(ids) > 0, F.lit(False))
    lost = matched.where("bout_id is null").select("commence_time", "home", "away", known("a_ids").alias("home_resolved"), known("b_ids").alias("away_resolved"))
    return prices, fuzzy("home", "a").union(fuzzy("away", "b")).distinct(), lost
