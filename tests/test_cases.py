"""Hand-computed cases and properties of single operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import similarity as M
from tidemark.operators import elo, evaluation, features, history, ingest, matrix, metrics, mutation, odds, quality, resolve
from tidemark.sources import readers, schemas, wikitext

DAY = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# Ratings ------------------------------------------------------------------------------------------------------------------------


CARDS = [(11, DAY(2019, 5, 4), 40, 41, 41), (12, DAY(2019, 5, 11), 42, 40, 42), (13, DAY(2019, 6, 1), 41, 42, 41), (14, DAY(2019, 6, 8), 40, 43, 40)]


def expected(k, start=1500.0):
    """Ratings before each bout, by the published formula, with numbers of bouts kept per fighter."""
    rating, fought, out = {}, {}, []
    for _, _, red, blue, winner in CARDS:
        a, b = rating.get(red, start), rating.get(blue, start)
        out.append((a, b))
        chance = 1 / (1 + 10 ** ((b - a) / 400))
        rating[red] = a + k(fought.get(red, 0)) * ((winner == red) - chance)
        rating[blue] = b + k(fought.get(blue, 0)) * ((winner == blue) - (1 - chance))
        fought[red], fought[blue] = fought.get(red, 0) + 1, fought.get(blue, 0) + 1
    return out


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame(CARDS, "bout_id long, day date, red long, blue long, winner long")


@pytest.mark.parametrize("k", [elo.constant_k(20), elo.experience_k(50, 15, 4)])
def test_elo_chain(chain, k):
    got = [(r["elo_red"], r["elo_blue"]) for r in elo.rate(chain, k).orderBy("bout_id").collect()]
    assert got == [pytest.approx(w, abs=1e-6) for w in expected(k)]
    assert got[0] == (1500, 1500) and got[1] == (1500, 1500 - k(0) / 2)


def test_elo_order_of_rows_does_not_matter(chain):
    assert elo.rate(chain.orderBy(F.desc("bout_id"))).orderBy("bout_id").collect() == elo.rate(chain).orderBy("bout_id").collect()


def test_k_decay():
    k = elo.experience_k(50, 15, 4)
    assert (k(0), k(4), k(5000)) == (50, pytest.approx(15 + 35 / math.e), pytest.approx(15.0))
    assert all(k(i) > k(i + 1) for i in range(50))


def test_elo_rejects_a_stranger():
    with pytest.raises(ValueError):
        elo.Ratings(elo.constant_k(32)).play(1, 2, 3)
    assert elo.Ratings(elo.constant_k(32), 1000).play(1, 2, 1) == (1000, 1000)


def test_elo_pools_and_grid(spark, chain):
    two = chain.withColumn("pool", F.lit("a")).unionByName(chain.withColumn("pool", F.lit("b")))
    got = elo.rate(two, pool="pool").groupBy("bout_id").agg(F.countDistinct("elo_red").alias("n"), F.count("*").alias("m")).collect()
    assert all(r["n"] == 1 and r["m"] == 2 for r in got)
    grid = elo.grid(chain, spark.createDataFrame([(20.0,), (90.0,)], "k double"), elo.constant_k)
    got = {r["k"]: r["elo_red"] for r in grid.where("bout_id = 14").collect()}
    assert got == {v: pytest.approx(expected(elo.constant_k(v))[3][0]) for v in (20.0, 90.0)}


# Metrics ------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def eight(spark):
    return spark.createDataFrame([(1, 0.75), (0, 0.75), (1, 0.75), (1, 0.75), (0, 0.125), (0, 0.125), (1, 0.375), (0, 0.625)], "y int, p double")


def test_metrics(eight):
    """Two bins: three rows up to a half (mean 5/24, one won), five above (mean 0.725, three won)."""
    r = metrics.evaluate(eight, n_bins=2).first()
    assert r["n"] == 8 and r["accuracy"] == 5 / 8
    assert r["brier"] == pytest.approx((3 * 0.25**2 + 0.75**2 + 2 * 0.125**2 + 2 * 0.625**2) / 8)
    assert r["ece"] == pytest.approx(3 / 8 * (1 / 3 - 5 / 24) + 5 / 8 * (0.725 - 0.6))
    a, b = metrics.reliability(eight, n_bins=2).orderBy("bin").collect()
    assert (a["n"], a["mean_pred"], a["mean_true"]) == (3, pytest.approx(5 / 24), pytest.approx(1 / 3)) and (b["n"], b["mean_pred"], b["mean_true"]) == (5, pytest.approx(0.725), 0.6)
    assert metrics.evaluate(eight.limit(0)).first()["n"] == 0


def test_bins_are_right_closed(spark):
    edges = [i / 10 for i in range(11)]
    rows = spark.createDataFrame([(e,) for e in edges], "p double").select("p", S.edges_below("p", 10).alias("b")).collect()
    assert [r["b"] for r in sorted(rows)] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_gates(spark):
    table = spark.createDataFrame([("uncalibrated", 0.07, 0.0, 0.0, 0.66), ("platt", 0.068, -0.01, 0.0, 0.6600), ("isotonic", 0.13, -0.02, -0.01, 0.65)], "method string, max_pair_dev double, d_ece double, d_log_loss double, log_loss double")
    assert evaluation.choose_calibrator(table) == "platt"
    assert evaluation.choose_calibrator(table, ece=0.015) is None
    assert evaluation.choose_calibrator(table, deviation=2.0) == "isotonic"
    blends = spark.createDataFrame([("gbt", 1, 0.07, 0.01, 0.6634), ("elo", 1, 0.0, 0.01, 0.68), ("mean", 2, 0.06, 0.01, 0.660), ("stacker", 2, 0.06, 0.01, 0.6597), ("wild", 2, 0.3, 0.01, 0.6)], "method string, n_components int, max_pair_dev double, ece double, log_loss double")
    assert evaluation.choose_blend(blends) == "mean"
    assert evaluation.choose_blend(blends, margin=0.0001) == "stacker"
    assert evaluation.choose_blend(blends, gain=0.01) is None


def test_simplex():
    got = list(evaluation.simplex(3, 0.5))
    assert len(got) == 9 and all(sum(w) == pytest.approx(1) for w in got) and (0.5, 0.25, 0.25) in got


def test_stackers_and_their_comparison(spark):
    base = spark.range(600).select("id", F.rand(5).alias("u"), (F.randn(6)).alias("x"))
    rows = base.select((F.col("id")).alias("bout_id"), (F.col("u") < S.sigmoid(F.col("x"))).cast("int").alias("y"), S.sigmoid(F.col("x") * 0.5).alias("a"), S.sigmoid(F.col("x") * 0.1 + 0.3).alias("b")).cache()
    both = evaluation.stacker(rows, "y", ["a", "b"])
    better = rows.select("y", both("a", "b").alias("p"), "a")
    assert metrics.evaluate(better, "y", "p").first()["log_loss"] < metrics.evaluate(better, "y", "a").first()["log_loss"]
    assert rows.limit(1).select(evaluation.stacker(rows, "y", ["a"], intercept=False)(F.lit(0.5))).first()[0] == pytest.approx(0.5)
    table = evaluation.blend_comparison(rows, rows, "y", ["a", "b"], step=0.25)
    got = {r["method"]: r["n_components"] for r in table.collect()}
    assert got["a"] == 1 and got["stacker"] == got["stacker_plain"] == got["mean"] == 2 and {"blend_logit", "blend_probability"} <= set(got)


def test_shuffle_test_finds_nothing(spark):
    rows = spark.range(2000).select("id", F.randn(2).alias("d")).withColumn("y", (F.col("d") > 0).cast("int")).cache()
    assert evaluation.shuffle_test(rows.where("id < 1500"), rows.where("id >= 1500"), ["d"], "y").first()["log_loss"] > 0.6


def test_assembly(spark):
    known = spark.createDataFrame([(1, DAY(2020, 1, 1), "red", 7, 8, 0.5), (1, DAY(2020, 1, 1), "blue", 8, 7, None), (2, DAY(2020, 1, 2), "red", 8, 9, 0.1), (2, DAY(2020, 1, 2), "blue", 9, 8, 0.2)], "bout_id long, day date, corner string, self long, opp long, rate double")
    asked = spark.createDataFrame([(1,), (1,)], "bout_id long")
    assert [r.asDict() for r in features.assemble(known, asked).collect()] == [{"bout_id": 1, "day": DAY(2020, 1, 1), "red_fighter_id": 7, "red_rate": 0.5, "blue_fighter_id": 8, "blue_rate": None}]
    with pytest.raises(Exception, match="unknown bout 3"):
        features.assemble(known, spark.createDataFrame([(3,)], "bout_id long")).collect()


def test_platt_and_isotonic_keep_pairs(spark):
    rows = spark.range(400).select((F.col("id") / 400).alias("p"), (F.rand(3) < F.col("id") / 400).cast("int").alias("y"))
    for g in (evaluation.platt(rows, "y", "p"), evaluation.isotonic(rows, "y", "p")):
        r = rows.select((g(F.col("p")) + g(1 - F.col("p"))).alias("s")).agg(F.min("s"), F.max("s")).first()
        assert r[0] == pytest.approx(1, abs=1e-9) and r[1] == pytest.approx(1, abs=1e-9)


def test_mirrored_logistic_sums_to_one(spark):
    half = spark.range(200).select(F.col("id").alias("bout_id"), (F.randn(1)).alias("d"))
    rows = half.withColumn("y", (F.col("d") > 0).cast("int"))
    both = rows.unionByName(rows.select("bout_id", (-F.col("d")).alias("d"), (1 - F.col("y")).alias("y")))
    model = evaluation.logistic(["d"], both.count(), "y").fit(both)
    assert metrics.pair_deviation(evaluation.predict(model, both)).first()["max_deviation"] < 1e-9
    assert evaluation.top_features(model, ["d"])[0][0] == "d"


def test_shuffled_labels_keep_their_counts(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = evaluation.shuffled_labels(rows, "y", by="id")
    assert out.count() == 1000 and out.agg(F.sum("y")).first()[0] == 100
    assert out.where("y = 1 and id % 10 = 0").count() < 40


def test_permutation_null_draws(spark):
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 300).alias("p"))
    null = evaluation.permutation_null(rows, "y", "p", 50, draws=30)
    assert null.count() == 30
    assert evaluation.against_null(null, 0.0).first()["p_value"] == 1.0


# History ------------------------------------------------------------------------------------------------------------------------


def bouts(spark, *rows):
    ddl = "bout_id long, day date, red long, blue long, winner long, status string, method string, scheduled_rounds int, ending_round int, ending_time int, is_title boolean, weight_class string"
    return spark.createDataFrame([(i, d, r, b, w, "completed", m, 3, 2, 30, False, "Lightweight") for i, (d, r, b, w, m) in enumerate(rows)], ddl)


def test_same_day_and_later_bouts_are_unseen(spark):
    b = bouts(spark, (DAY(2020, 1, 1), 1, 2, 1, None), (DAY(2020, 1, 1), 1, 3, 3, "DQ"), (DAY(2020, 2, 1), 1, 2, 2, "KO/TKO"), (DAY(2020, 3, 1), 1, 4, 1, "Decision - Split"))
    known = features.with_features(history.asof(history.bout_facts(b), stats=False), "total_fights", "career_win_pct", "finish_rate", "ko_loss_rate", "days_since_last_fight", "total_seconds")
    got = {r["bout_id"]: r for r in known.where("self = 1").collect()}
    assert [got[i]["total_fights"] for i in range(4)] == [0, 0, 2, 3]
    assert got[0]["career_win_pct"] is None and got[2]["career_win_pct"] == 0.5 and got[2]["finish_rate"] == 1.0
    assert got[2]["ko_loss_rate"] is None and got[3]["ko_loss_rate"] == 1.0
    assert got[3]["days_since_last_fight"] == 29 and got[3]["total_seconds"] == 3 * 330
    changed = bouts(spark, (DAY(2020, 1, 1), 1, 2, 1, None), (DAY(2020, 1, 1), 1, 3, 3, "DQ"), (DAY(2020, 2, 1), 1, 2, 1, None))
    again = features.with_features(history.asof(history.bout_facts(changed), stats=False), "career_win_pct").where("self = 1 and bout_id = 2").first()
    assert again["career_win_pct"] == 0.5


def test_trailing_months_edges(spark):
    days = [DAY(2020, 2, 29), DAY(2022, 2, 28), DAY(2022, 3, 1), DAY(2024, 2, 29), DAY(2024, 3, 1)]
    facts = spark.createDataFrame([(i, 1, d, 10**i) for i, d in enumerate(days)], "bout_id long, self long, day date, v long")
    got = [r["recent_v"] for r in elo.trailing_months(facts, "v").orderBy("bout_id").collect()]
    assert got == [None, 1, 10, 110, 1100]  # the lower end is included, months are calendar months


def test_class_ladder(spark):
    r = one(spark, S.weight_class(F.lit("Light Heavyweight Title Bout")).alias("a"), S.weight_class(F.lit("Catch Weight")).alias("b"), S.ladder_step(F.lit("heavyweight"), F.lit("light heavyweight")).alias("c"), S.ladder_step(F.lit("flyweight"), F.lit("women's flyweight")).alias("d"))
    assert tuple(r) == ("light heavyweight", "catch weight", -1, None)


# Matrix -------------------------------------------------------------------------------------------------------------------------


def test_differential_pairs(spark):
    rows = spark.createDataFrame([(1, 11, 12, 3.0, 1.5, 180, 178, "a", "b", True, 0), (0, 12, 11, 1.0, 2.5, 170, 176, "b", "a", True, 0)], "self_won int, self_fighter_id long, opp_fighter_id long, self_slpm double, opp_slpm double, self_reach int, opp_reach int, self_stance string, opp_stance string, self_is_open boolean, title int")
    got = matrix.differential(rows)
    assert got.columns == ["diff_slpm", "diff_reach", "self_won"]
    assert sorted((r["diff_slpm"], r["diff_reach"]) for r in got.collect()) == [(-1.5, -6.0), (1.5, 2.0)]


def test_folds(spark):
    rows = spark.createDataFrame([(100 * y + i, DAY(y, 5, 1)) for y, n in {2010: 3, 2011: 2, 2012: 4, 2013: 5, 2014: 6}.items() for i in range(n) for _ in range(2)], "bout_id long, day date")
    assert matrix.fold_years(rows, 2011) == [2012, 2013, 2014]
    train, val = matrix.fold(rows, 2013)
    assert (train.count(), val.count()) == (18, 10) and train.join(val, "bout_id").count() == 0
    with pytest.raises(ValueError):
        matrix.fold_years(rows, 2014)
    with pytest.raises(ValueError):
        matrix.fold_years(rows.limit(0), 2011)


def test_split_validation(spark):
    rows = spark.createDataFrame([(i, DAY(y, 1, 1), w) for i, y in enumerate((2021, 2023, 2025)) for w in (0, 1)], "bout_id long, day date, self_won int")
    matrix.validate_split(matrix.temporal_split(rows, "2023-01-01", "2025-01-01"))
    with pytest.raises(ValueError, match="empty"):
        matrix.validate_split(matrix.temporal_split(rows, "2019-01-01", "2025-01-01"))
    with pytest.raises(ValueError, match="without two rows"):
        matrix.validate_split(matrix.temporal_split(rows.where("bout_id > 0 or self_won = 1"), "2023-01-01", "2025-01-01"))
    with pytest.raises(Exception, match="nothing to attach"):
        side = spark.createDataFrame([(1, "red")], "bout_id long, source_corner string")
        matrix.attach_by_corner(side, spark.createDataFrame([(2, 1.0, 2.0)], "bout_id long, red_x double, blue_x double"), "x").collect()


# Scalars and text ---------------------------------------------------------------------------------------------------------------


def test_scalars(spark):
    r = one(
        spark, S.height_cm(F.lit("5' 11\"")).alias("h"), S.height_cm(F.lit("--")).alias("h0"), S.reach_cm(F.lit('66"')).alias("r"), S.clock_seconds(F.lit("4:05")).alias("c"), S.stance(F.lit(" Southpaw ")).alias("s"),
        S.landed(F.lit("12 of 30")).alias("l"), S.corner(F.lit("A vs. B vs. C"), 1).alias("b"), S.is_title(F.lit("X Title Bout")).alias("t"), S.implied_probability(F.lit(-150)).alias("i"), S.implied_probability(F.lit(200)).alias("j"),
        S.open_stance(F.lit("southpaw"), F.lit("orthodox")).alias("o"), S.open_stance(F.lit("switch"), F.lit(None).cast("string")).alias("o2"), S.template_date(F.lit("{{dts|2026|Aug|15}}")).alias("d"), S.link_target(F.lit("[[A (x)|A]] b")).alias("lt"),
        S.duration_seconds(F.lit("Decision - Split"), F.lit(3), F.lit(3), F.lit(300)).alias("u"), S.duration_seconds(F.lit("KO"), F.lit(3), F.lit(2), F.lit(19)).alias("v"), S.duration_seconds(F.lit("KO"), F.lit(3), F.lit(None).cast("int"), F.lit(19)).alias("w"), S.logit(F.lit(0.0)).alias("lg"),
    )
    assert tuple(r)[:8] == (180.3, None, 167.6, 245, "southpaw", 12, "B vs. C", True)
    assert (r["i"], r["j"]) == (pytest.approx(0.6), pytest.approx(1 / 3)) and (r["o"], r["o2"]) == (True, False)
    assert (r["d"], r["lt"], r["u"], r["v"], r["w"]) == (DAY(2026, 8, 15), "A (x)", 900, 319, None) and r["lg"] == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


def test_similarity():
    assert M.fold("  José   ÁLVAREZ ") == "jose alvarez"
    assert M.lcs("abcbdab", "bdcaba") == 4 and M.ratio("abcd", "abxd") == 75.0
    assert M.token_set_ratio("fight night: a vs b", "a vs b") == 100.0 and M.weighted_ratio("", "x") == 0.0


def test_name_cascade(spark):
    roster = spark.createDataFrame([(1, "Bruno Silva"), (2, "Bruno Silva"), (3, "José Aldo"), (4, "Khabib Nurmagomedov")], "id long, name string")
    aliases = spark.createDataFrame([("Blindado", 2)], "alias string, fighter_id long")
    asked = spark.createDataFrame([("bruno silva", "Blindado"), ("Bruno Silva", None), ("Jose Aldo", None), ("Khabib Nurmagomedow", None), ("Nobody", None)], "name string, link string")
    got = {r["name"]: (r["fighter_id"], r["match_type"]) for r in resolve.resolve_names(asked, roster, aliases).collect()}
    assert got == {"bruno silva": (2, "alias"), "Bruno Silva": (None, "collision"), "Jose Aldo": (3, "exact"), "Khabib Nurmagomedow": (4, "fuzzy"), "Nobody": (None, "unresolved")}


CARD = """==Fight card==
{{MMAevent card|Main Card}}
{{MMAevent bout|Lightweight|[[Ann Lee (fighter)|Ann Lee]] (c)|def.|Bo Ray|KO|2|1:02|title}}
{{MMAevent bout|Flyweight|Cy Poe|vs.|[[Di Fox]]||||}}
{{MMAevent card|Prelims}}
{{MMAevent bout|Heavyweight|Ed Kim|vs.|Flo Orr|}}"""
TABLE = """{| class="wikitable"
! scope="col" | Event
! Date
! Venue
! Location
|-
| [[Event 1|First]]
| {{dts|2026|Sep|5}}
| [[Hall]]
| Town, [[Land]]
|-
| Unlinked
| {{dts|2026|10|5}}
| x
| y
|-
| colspan="4" | TBA
|}"""


def test_wikitext(spark):
    pages = spark.createDataFrame([(1, CARD)], "page_id long, text string")
    got = wikitext.with_main_event(wikitext.fight_cards(pages)).orderBy("position").collect()
    assert [(r["card_tier"], r["red"], r["blue"], r["red_champion"], r["scheduled_rounds"]) for r in got] == [("Main Card", "Ann Lee", "Bo Ray", True, 5), ("Main Card", "Cy Poe", "Di Fox", False, 3), ("Prelims", "Ed Kim", "Flo Orr", False, 3)]
    assert (got[0]["red_link"], got[1]["blue_link"], got[0]["method"], got[0]["time"]) == ("Ann Lee (fighter)", "Di Fox", "KO", "1:02")
    events = wikitext.scheduled_events(spark.createDataFrame([(1, TABLE)], "page_id long, text string")).collect()
    assert [(r["event_title"], r["event_display_name"], r["date"], r["venue"], r["location"]) for r in events] == [("Event 1", "First", DAY(2026, 9, 5), "Hall", "Town, Land")]
    with pytest.raises(Exception, match="unexpected table columns"):
        wikitext.scheduled_events(spark.createDataFrame([(1, TABLE.replace("! Venue", "! Place"))], "page_id long, text string")).collect()


def test_pages_are_read_in_their_rows(spark):
    text = "x }} {{MMAevent bout|0={{a|b}}|2 = two=2 |one|3=c|[[l|m]] {{n|[[o]]|p}}|name=q}}{{MMAevent  card |T {{u}}}}{{MMAevent bout|never {{MMAevent bout||a|}}"
    got = wikitext.templates(spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id long, text string"))
    assert "Exchange" not in got._jdf.queryExecution().toString() and "Window" not in wikitext.fight_cards(got.select("page_id", F.lit("").alias("text")))._jdf.queryExecution().toString()
    rows = [(r["page_id"], r["position"], r["name"], r["card"], r["raw"], r["shown"]) for r in got.orderBy("position").collect()]
    assert rows == [
        (1, 0, "MMAevent bout", None, {0: "{{MMAevent bout", 1: "one", 2: "[[l|m]] {{n|[[o]]|p}}", 3: "c"}, {0: "{{MMAevent bout", 1: "one", 2: "[[l|m]] ", 3: "c"}),
        (1, 1, "MMAevent card", "T ", {0: "{{MMAevent  card ", 1: "T {{u}}"}, {0: "{{MMAevent  card ", 1: "T "}),
        (1, 2, "MMAevent bout", "T ", {0: "{{MMAevent bout", 1: "", 2: "a", 3: ""}, {0: "{{MMAevent bout", 1: "", 2: "a", 3: ""}),
    ]


# Sources and mutation -----------------------------------------------------------------------------------------------------------


def test_csv_readers(spark, tmp_path):
    put = lambda n, t: str((tmp_path / n).write_text(t) and tmp_path / n)
    e = readers.read_events(spark, put("e.csv", 'EVENT,URL,DATE,LOCATION\n X 1 ,u1,"August 01, 2026",Town\n')).first()
    assert (e["name"], e["event_date"]) == ("X 1", DAY(2026, 8, 1))
    d = readers.read_fighter_details(spark, put("d.csv", "FIRST,LAST,NICKNAME,URL\nAnn,Lee,,u\nSolo,,--,v\n"))
    t = readers.read_tale_of_the_tape(spark, put("t.csv", "FIGHTER,HEIGHT,WEIGHT,REACH,STANCE,DOB,URL\nAnn Lee,\"5' 4\"\"\",,\"66\"\"\",Orthodox,\"Jan 2, 1990\",u\n"))
    rows = {r["source_url"]: r for r in readers.read_fighters(d, t).collect()}
    assert rows["u"]["real_name"] == "Ann Lee" and float(rows["u"]["height_cm"]) == 162.6 and rows["u"]["dob"] == DAY(1990, 1, 2) and rows["v"]["dob"] is None
    r = readers.read_fight_results(spark, put("r.csv", "EVENT,BOUT,OUTCOME,WEIGHTCLASS,METHOD,ROUND,TIME,TIME FORMAT,REFEREE,DETAILS,URL\nX,A vs. B,L/W,Light Title Bout,KO,2,1:30,3 Rnd (5-5-5),,,u\nX,C vs. D,W/L,Light,KO,1,1:30,No Time Limit,,,v\n")).collect()
    assert len(r) == 1 and (r[0]["winner_side"], r[0]["is_title_fight"], r[0]["ending_time_seconds"]) == ("blue", True, 90)
    head = "EVENT,BOUT,ROUND,FIGHTER,KD,SIG.STR.,SIG.STR. %,TOTAL STR.,TD,TD %,SUB.ATT,REV.,CTRL,HEAD,BODY,LEG,DISTANCE,CLINCH,GROUND\n"
    s = readers.read_fight_stats(spark, put("s.csv", head + "X,A vs. B,Round 1,A,1,10 of 20,50%,12 of 22,1 of 2,50%,0,0,--,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2\nX,A vs. B,,,,,,,,,,,,,,,,,\n")).collect()
    assert len(s) == 1 and (s[0]["sig_strikes_attempted"], s[0]["control_time_seconds"], s[0]["round_number"]) == (20, None, 1)


def test_odds_json(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"data":[{"commence_time":"2026-01-01T00:00:00Z","home_team":"A","away_team":"B","bookmakers":[{"title":"K","markets":[{"key":"h2h","last_update":"z","outcomes":[{"name":"A","price":-150},{"name":"B","price":130}]},{"key":"spreads","outcomes":[]}]}]}]}')
    got = readers.read_odds(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["moneyline"]) for r in got) == [("A", -150), ("B", 130)]


def test_nan_becomes_null(spark):
    assert schemas.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()["a"] is None
    assert len(schemas.schema("bouts")) == 16


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 3, False), (2, "b", 5, True)], "k int, name string, rounds int, confirmed boolean")
    new = spark.createDataFrame([(1, None, 5, False), (2, "c", 3, False), (3, "d", 3, False)], "k int, name string, rounds int, confirmed boolean")
    load = lambda t: mutation.upsert(old if t is None else t, new, ["k"], fill=["name"], guarded={"rounds": F.col("old_confirmed"), "confirmed": F.col("old_confirmed")})
    assert sorted(map(tuple, load(None).collect())) == [(1, "a", 5, False), (2, "c", 5, True), (3, "d", 3, False)]
    assert quality.idempotent(load, "k").count() == 0


def test_splits_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id int, split string")
    readers.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/open")).count() == 2 and spark.read.parquet(str(tmp_path / "s/locked/test")).count() == 1
    readers.quarantine(rows, str(tmp_path / "q"), "why")
    readers.quarantine(rows, str(tmp_path / "q"), "again")
    assert spark.read.json(str(tmp_path / "q")).groupBy("reason").count().count() == 2


# Tables from raw rows, offers ---------------------------------------------------------------------------------------------------


def test_partial_scores():
    assert M.partial_ratio("cho", "ann cho-lee") == 100.0 and M.partial_ratio("", "") == 100.0 and M.partial_ratio("", "x") == 0.0
    assert M.partial_ratio("abcd", "zzabxdzz") == 75.0
    assert M.weighted_ratio("ann lee", "ann lee of the north") == 90.0  # a shorter string inside one half as long again
    assert M.weighted_ratio("a", "a" + "b" * 9) == 60.0


def test_loading_in_order(spark, tmp_path):
    details = spark.createDataFrame([("Ann Lee", None, "u/2"), ("Bo Dee", None, "u/1"), ("Kim", None, "u/3"), ("Kim", None, "u/4")], "real_name string, nickname string, source_url string")
    tape = spark.createDataFrame([("u/1", "southpaw")], "source_url string, stance string")
    events = spark.createDataFrame([("Night 2", "e/2"), ("Night 1", "e/1")], "name string, source_url string")
    results = spark.createDataFrame(
        [("Night 1", "Ann Lee vs. Bo Dee", "Ann Lee", "Bo Dee", "red", "Flyweight", "b/2"), ("Night 2", "Kim vs. Ann Lea", "Kim", "Ann Lea", "blue", "Flyweight", "b/1"), ("Night 2", "Kim vs. Bo Dee", "Kim", "Bo Dee", None, "Lightweight", "b/3"), ("Night 9", "Ann Lee vs. Bo Dee", "Ann Lee", "Bo Dee", "red", "Flyweight", "b/4"), (None, None, None, None, None, None, None)],
        "event string, bout string, red string, blue string, winner_side string, weight_class string, source_url string",
    )
    stats = spark.createDataFrame([("Night 1", "Ann Lee vs. Bo Dee", "Ann Lee", 1, 2), ("Night 1", "Ann Lee vs. Bo Dee", "Jo", 1, 1), ("Night 2", "Kim vs. Bo Dee", "Kim", 1, 5), ("Night 2", "Kim vs. Ann Lea", "Kim", 2, 3), (None, None, None, None, None)], "event string, bout string, fighter string, round_number int, knockdowns int")
    corrections = spark.createDataFrame([("Ann Lea", "Ann Lee"), ("Kym", "Kim")], "wrong string, right string")
    shared = spark.createDataFrame([("Kim", "Flyweight", "u/4")], "name string, weight_class string, source_url string")
    raw = {"details": details, "tape": tape, "events": events, "results": results, "stats": stats}
    out = ingest.load(raw, corrections, shared, str(tmp_path))
    assert {(r["fighter_id"], r["real_name"], r["stance"]) for r in out["fighters"].collect()} == {(1, "Bo Dee", "southpaw"), (2, "Ann Lee", None), (3, "Kim", None), (4, "Kim", None)}
    bouts = [tuple(r) for r in out["bouts"].select("bout_id", "event_id", "red_id", "blue_id", "winner_id").orderBy("bout_id").collect()]
    assert bouts == [(1, 2, 4, 2, 2), (2, 1, 2, 1, 2)]
    assert {tuple(r) for r in out["stats"].select("bout_id", "fighter_id", "round_number", "knockdowns").collect()} == {(1, 4, 2, 3), (2, 2, 1, 2)}
    assert spark.read.json(f"{tmp_path}/rejected/bouts").count() == 3 and spark.read.json(f"{tmp_path}/rejected/stats").count() == 1


def test_loading_nothing(spark, tmp_path):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    raw = {"details": empty("real_name string, source_url string"), "tape": empty("source_url string, stance string"), "events": empty("name string, source_url string"), "results": empty("event string, bout string, red string, blue string, winner_side string, weight_class string, source_url string"), "stats": empty("event string, bout string, fighter string, round_number int")}
    out = ingest.load(raw, empty("wrong string, right string"), empty("name string, weight_class string, source_url string"), str(tmp_path))
    assert all(df.count() == 0 for df in out.values())


def test_offers_of_shared_and_misspelt_names(spark):
    roster = spark.createDataFrame([(1, "Ann Lee"), (2, "Kim Park"), (3, "Kim Park"), (4, "Roberta Silva")], "id long, name string")
    aliases = spark.createDataFrame([("The Ann", 1)], "alias string, fighter_id long")
    bouts = spark.createDataFrame([(10, DAY(2024, 3, 2), 3, 1), (11, DAY(2024, 6, 1), 2, 4)], "bout_id long, day date, red long, blue long")

    def entry(at, home, away):
        return (at, home, away, [("Book", [("h2h", "t", [(home, -150.0), (away, 120.0), ("Draw", 900.0)]), ("spreads", "t", [(home, 1.0)])])])

    rows = [([entry("2024-03-01T22:00:00Z", "Kim Park", "The Ann"), entry("2024-06-02T22:00:00Z", "Kim Parks", "Roberta Silvia"), entry("2024-06-09T22:00:00Z", "Kim Park", "Roberta Silva")],), ([entry(None, "No One", "The Ann")],), ([],), (None,)]
    docs = spark.createDataFrame(rows, schemas.ODDS.split(", timestamp")[0])
    prices, new, lost = odds.resolve_prices(docs, roster, aliases, bouts)
    assert {(r["bout_id"], r["fighter"], r["moneyline"], round(r["implied_prob"], 4)) for r in prices.collect()} == {(10, 3, -150, 0.6), (10, 1, 120, 0.4545), (11, 2, -150, 0.6), (11, 4, 120, 0.4545)}
    assert {tuple(r) for r in new.collect()} == {(4, "Roberta Silvia")}  # Kim Parks is like a name that two fighters have
    assert {tuple(r) for r in lost.collect()} == {("2024-06-09T22:00:00Z", "Kim Park", "Roberta Silva", True, True), (None, "No One", "The Ann", False, True)}
