"""As-of lookups at any date and feature rows, against plain Python."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import elo, features, history, matrix


def day(n: int) -> datetime.date:
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), day(rng.randrange(40)), rng.choice([None, 1, 5, 7]), rng.random() < 0.7) for _ in range(200)]
    return rows + rows[:5] + [(9, None, 4, True)]


def test_any_day(spark, facts):
    asked = [(i, k, None if d is None else day(d)) for i, (k, d) in enumerate([(k, d) for k in (1, 2, 3, 4, None) for d in (-3, 0, 1, 7, 20, 41, 400, None)] * 2)]
    known = spark.createDataFrame(facts, "k long, d date, v long, ok boolean")
    got = history.asof_lookup(spark.createDataFrame(asked, "i long, k long, d date"), known, "k", "d", {"total": F.col("v"), "rows": F.lit(1)}, last=("d",), only=F.col("ok"))
    want = Counter()
    for i, k, d in asked:
        before = [f for f in facts if k is not None and d is not None and f[0] == k and f[1] is not None and f[1] < d and f[3]]
        values = [f[2] for f in before if f[2] is not None]
        want[i, k, d, sum(values) if values else None, len(before) or None, max((f[1] for f in before), default=None)] += 1
    assert Counter(map(tuple, got.select("i", "k", "d", "total", "rows", "last_d").collect())) == want


def test_own_days_agree_with_the_window(spark, facts):
    known = spark.createDataFrame([f for f in facts if f[0] and f[1]], "k long, d date, v long, ok boolean")
    sums = {"total": F.col("v"), "rows": F.lit(1)}
    rows = lambda df: Counter(map(tuple, df.select("k", "d", "v", "total", "rows").collect()))
    assert rows(history.asof_lookup(known, known, "k", "d", sums)) == rows(history.strictly_before(known, "k", "d", sums))


def test_no_facts_and_no_questions(spark):
    none = spark.createDataFrame([], "k long, d date, v long")
    asked = spark.createDataFrame([(1, day(3))], "k long, d date")
    assert [tuple(r) for r in history.asof_lookup(asked, none, "k", "d", {"s": F.col("v")}).collect()] == [(1, day(3), None)]
    assert history.asof_lookup(asked.limit(0), none, "k", "d", {"s": F.col("v")}).count() == 0


def test_a_career_is_read_once_by_key(spark, facts):
    known = spark.createDataFrame(facts, "k long, d date, v long, ok boolean")
    plan = history.asof_lookup(known.select("k", "d"), known, "k", "d", {"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "Join Inner" not in plan


def test_trailing_months(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), day(rng.randrange(-900, 900)), rng.choice([None, 3, 11])) for i in range(150)] + [(200, 1, datetime.date(2022, 2, 28), 5), (201, 1, datetime.date(2020, 2, 29), 100), (202, 1, datetime.date(2020, 2, 28), 1000)]

    def months_before(d, n=24):
        y, m = divmod(d.year * 12 + d.month - 1 - n, 12)
        last = [31, 29 if y % 4 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
        return datetime.date(y, m + 1, min(d.day, last))

    got = elo.trailing_months(spark.createDataFrame(rows, "bout_id long, self long, day date, damage long"), "damage").collect()
    for r in got:
        past = [v for _, s, d, v in rows if s == r["self"] and months_before(r["day"]) <= d < r["day"] and v is not None]
        assert r["recent_damage"] == (sum(past) if past else None)
    assert len(got) == len(rows)


BOUTS = "bout_id long, day date, red long, blue long, winner long, status string, method string, ending_round int, ending_time int, scheduled_rounds int, is_title boolean, weight_class string"
ROUNDS = "bout_id long, fighter long, round int, sig_landed long, sig_attempted long, total_landed long, td_landed long, td_attempted long, sub_attempts long, knockdowns long, control long"


@pytest.fixture(scope="module")
def card(spark):
    bouts = spark.createDataFrame([
        (1, day(0), 7, 8, 7, "completed", "Submission", 2, 60, 3, False, "A"),
        (2, day(10), 9, 7, 7, "completed", "Decision - Split", 3, 300, 3, True, "A"),
        (3, day(10), 8, 9, None, "completed", "Draw", 3, 300, 3, False, "B"),
        (4, day(20), 7, 8, None, "scheduled", None, None, None, 5, True, "A"),
    ], BOUTS)
    rounds = spark.createDataFrame([(b, f, r, 10 * f, 20 * f, 11 * f, 1, 2, 1, 0, 30) for b, a, c in ((1, 7, 8), (2, 9, 7)) for r in (1, 3) for f in (a, c)], ROUNDS)
    fighters = spark.createDataFrame([(7, day(-9000), 180.0, 190.0, "orthodox"), (8, None, None, 170.0, "southpaw")], "fighter long, dob date, height_cm double, reach_cm double, stance string")
    return bouts, rounds, fighters


def test_feature_rows(card, spark):
    rows = {r["bout_id"]: r for r in features.feature_rows(*card).collect()}
    assert set(rows) == {1, 2, 3, 4}
    up = rows[4]  # a scheduled bout sees all completed ones
    assert (up["red_total_fights"], up["red_career_win_pct"], up["red_finish_rate"], up["red_days_since_last_fight"], up["red_total_seconds"]) == (2, 1.0, 0.5, 10, 360 + 900)
    assert (up["blue_total_fights"], up["blue_career_win_pct"], up["blue_ko_loss_rate"], up["blue_age"]) == (2, 0.0, 0.0, None)
    assert up["red_slpm"] == pytest.approx(4 * 70 * 60 / 1260) and up["red_striking_accuracy"] == 0.5
    assert (up["red_stance_matchup"], up["red_is_open_stance_matchup"], up["scheduled_rounds"], up["is_title"], up["weight_class"]) == ("orthodox vs southpaw", True, 5, True, "A")
    assert rows[1]["red_total_fights"] == 0 and rows[1]["red_career_win_pct"] is None
    assert rows[3]["blue_total_fights"] == 0  # the bout of the same day isn't seen
    assert rows[2]["red_stance"] is None and rows[2]["red_is_open_stance_matchup"] is False
    wanted = {f"{c}_{n}" for c in ("red", "blue") for n in (*features.FEATURES, *features.PHYSICAL, "fighter_id")}
    assert wanted <= set(rows[1].asDict())
    assert [r["bout_id"] for r in features.feature_rows(*card, spark.createDataFrame([(4,), (4,)], "bout_id long")).collect()] == [4]
    with pytest.raises(Exception, match="unknown bout 5"):
        features.feature_rows(*card, spark.createDataFrame([(5,)], "bout_id long")).collect()


def test_one_fighter_on_one_day(card, spark):
    bouts, rounds, fighters = card
    facts = history.bout_facts(bouts, rounds)
    got = features.at(spark.createDataFrame([(7, day(5)), (7, day(10)), (7, day(11)), (5, day(11))], "self long, day date"), facts, None, "total_fights", "career_win_pct").collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: (r["self"], r["day"]))] == [(5, day(11), 0, None), (7, day(5), 1, 1.0), (7, day(10), 1, 1.0), (7, day(11), 2, 1.0)]


def test_mirrored_fields_stay_on_one_side(card):
    bouts, rounds, fighters = card
    rows = matrix.symmetrize(features.feature_rows(bouts, rounds, fighters).join(bouts.selectExpr("bout_id", "winner as winner_id"), "bout_id"))
    assert {"self_stance_matchup", "self_is_open_stance_matchup", "opp_stance"} <= set(rows.columns)
    assert not {"opp_stance_matchup", "opp_is_open_stance_matchup"} & set(rows.columns)
    assert rows.count() == 8
