"""Schemas of the stored tables; every reader declares its types, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tables and their columns.
DDL = {
    "fighters": "id BIGINT, real_name STRING, dob DATE, height_cm DECIMAL(4,1), reach_cm DECIMAL(4,1), stance STRING, nationality STRING, ufc_debut_date DATE, source_url STRING",
    "fighter_aliases": "id BIGINT, fighter_id BIGINT, alias_name STRING",
    "events": "id BIGINT, name STRING, event_date DATE, location STRING, venue STRING, source_url STRING, wikipedia_pageid BIGINT",
    "bouts": "id BIGINT, event_id BIGINT, fighter_red_id BIGINT, fighter_blue_id BIGINT, winner_id BIGINT, weight_class STRING, is_title_fight BOOLEAN, scheduled_rounds SMALLINT, card_position STRING, status STRING, method STRING, method_detail STRING, ending_round SMALLINT, ending_time_seconds SMALLINT, source_url STRING, rounds_confirmed BOOLEAN",
    "bout_stats": "id BIGINT, bout_id BIGINT, fighter_id BIGINT, round_number SMALLINT, sig_strikes_landed SMALLINT, sig_strikes_attempted SMALLINT, total_strikes_landed SMALLINT, total_strikes_attempted SMALLINT, takedowns_landed SMALLINT, takedowns_attempted SMALLINT, sub_attempts SMALLINT, knockdowns SMALLINT, reversals SMALLINT, control_time_seconds SMALLINT",
    "odds_snapshots": "id BIGINT, bout_id BIGINT, fighter_id BIGINT, sportsbook STRING, moneyline INT, implied_prob DECIMAL(5,4), collected_at TIMESTAMP",
    "predictions": "id BIGINT, bout_id BIGINT, model_version STRING, predicted_prob_red DECIMAL(5,4), predicted_winner_id BIGINT, feature_snapshot STRING, odds_at_prediction_time INT, created_at TIMESTAMP",
    "prediction_results": "id BIGINT, prediction_id BIGINT, actual_winner_id BIGINT, correct BOOLEAN, log_loss_contribution DECIMAL(8,6), brier_contribution DECIMAL(8,6), settled_at TIMESTAMP",
}

ODDS = "data ARRAY<STRUCT<commence_time: STRING, home_team: STRING, away_team: STRING, bookmakers: ARRAY<STRUCT<title: STRING, markets: ARRAY<STRUCT<key: STRING, last_update: STRING, outcomes: ARRAY<STRUCT<name: STRING, price: DOUBLE>>>>>>>>, timestamp STRING"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: null is the only missing value inside."""
    def clean(f: T.StructField) -> Column:
        return F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)

    return df.select(*[clean(f) for f in df.schema])


def violations(bouts: DataFrame) -> DataFrame:
    """Rows that break the table's checks, with their names."""
    rules = {
        "rounds": ~F.col("scheduled_rounds").isin(3, 5),
        "status": ~F.col("status").isin("scheduled", "completed", "cancelled"),
        "corners": F.col("fighter_red_id") == F.col("fighter_blue_id"),
        "winner": F.col("winner_id").isNotNull() & (F.col("winner_id") != F.col("fighter_red_id")) & (F.col("winner_id") != F.col("fighter_blue_id")),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return bouts.withColumn("broken", broken).where(F.size("broken") > 0)
