"""Queries over the as-of history: features, matrix, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import elo, features, history, matrix, metrics
from tidemark.plans import projection as P
from tidemark.plans.registry import query

WITH = f"WITH RECURSIVE {P.SQL}"
ASOF = f"{WITH}, {P.PRIOR}"


def _asof(spark: SparkSession, sf_dir: str, *names: str, stats: bool = True) -> DataFrame:
    b = P.bouts(spark, sf_dir)
    facts = history.bout_facts(b, P.rounds(spark, sf_dir, b)) if stats else history.bout_facts(b)
    known = features.with_features(history.asof(facts, stats=stats), *names)
    return P.rounded(known.select("bout_id", "self", *names))


@query(f"{ASOF} SELECT bout_id, self, round(wins / nullif(decided, 0), 6) AS career_win_pct, bouts AS total_fights FROM prior")
def asof_win_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "career_win_pct", "total_fights", stats=False)


@query(f"{ASOF} SELECT bout_id, self, day - last_day AS days_since_last_fight FROM prior")
def asof_layoff_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "days_since_last_fight", stats=False)


@query(f"""{ASOF} SELECT bout_id, self, round(coalesce(sl, 0) * 60 / nullif(sec, 0), 6) AS slpm, round(coalesce(osl, 0) * 60 / nullif(sec, 0), 6) AS sapm, round(coalesce(tdl, 0) * 900 / nullif(sec, 0), 6) AS td_avg_per_15,
    round(coalesce(sub, 0) * 900 / nullif(sec, 0), 6) AS sub_attempts_per_15, round(coalesce(kd, 0) * 900 / nullif(sec, 0), 6) AS knockdown_rate, round(coalesce(ctl, 0) / nullif(sec, 0), 6) AS control_time_pct, round(coalesce(octl, 0) / nullif(sec, 0), 6) AS time_controlled_pct FROM prior""")
def asof_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, *features.RATES)


@query(f"""{ASOF} SELECT bout_id, self, round(sl / nullif(sa, 0), 6) AS striking_accuracy, round(tdl / nullif(tda, 0), 6) AS takedown_accuracy, round(sl / nullif(tl, 0), 6) AS significant_strike_rate,
    round(1 - osl / nullif(osa, 0), 6) AS striking_defense, round(1 - otdl / nullif(otda, 0), 6) AS takedown_defense, round(sw / nullif(sub, 0), 6) AS submission_success_rate FROM prior""")
def asof_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "striking_accuracy", "takedown_accuracy", "significant_strike_rate", "striking_defense", "takedown_defense", "submission_success_rate")


@query(f"""{ASOF} SELECT bout_id, self, round(dw / nullif(decided, 0), 6) AS decision_win_pct, round(dl / nullif(decided, 0), 6) AS decision_loss_pct, round(fin / nullif(wins, 0), 6) AS finish_rate,
    round(kol / nullif(losses, 0), 6) AS ko_loss_rate, round(subl / nullif(losses, 0), 6) AS sub_loss_rate, round(sec / nullif(ntimed, 0), 6) AS avg_fight_time_seconds FROM prior""")
def asof_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "decision_win_pct", "decision_loss_pct", "finish_rate", "ko_loss_rate", "sub_loss_rate", "avg_fight_time_seconds", stats=False)


@query(f"{ASOF} SELECT bout_id, self, round(lsl / nullif(lr, 0) - esl / nullif(er, 0), 6) AS striking_output_decay, round(ltd / nullif(lr, 0) - etd / nullif(er, 0), 6) AS takedown_output_decay FROM prior")
def asof_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "striking_output_decay", "takedown_output_decay")


@query(f"""{ASOF} SELECT bout_id, self, bouts AS total_fights, CAST(coalesce(sw, 0) AS BIGINT) AS submission_win_count, CAST(coalesce(titles, 0) AS BIGINT) AS title_fight_experience,
    CAST(coalesce(okd, 0) AS BIGINT) AS times_knocked_down, CAST(coalesce(sec, 0) AS BIGINT) AS total_seconds FROM prior""")
def asof_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "total_fights", "submission_win_count", "title_fight_experience", "times_knocked_down", "total_seconds")


PHYSICAL = f"""{WITH} SELECT bout_id, self, round((day - a.dob) / 365.25, 6) AS age, a.height_cm, a.reach_cm, round(a.reach_cm / a.height_cm, 6) AS reach_to_height_ratio, a.stance, a.stance || ' vs ' || b.stance AS stance_matchup,
    coalesce((a.stance = 'orthodox' AND b.stance = 'southpaw') OR (a.stance = 'southpaw' AND b.stance = 'orthodox'), false) AS is_open_stance_matchup
    FROM sides LEFT JOIN fighter a ON a.fighter = self LEFT JOIN fighter b ON b.fighter = opp"""


@query(PHYSICAL)
def scalar_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.physical(history.two_sides(P.bouts(spark, sf_dir)), P.fighters(spark, sf_dir))
    return P.rounded(out.select("bout_id", "self", "age", "height_cm", "reach_cm", "reach_to_height_ratio", "stance", "stance_matchup", "is_open_stance_matchup"))


@query(f"""{ASOF} SELECT p.bout_id, p.self, round((p.day - p.last_day) * ((p.day - dob) / 365.25), 6) AS layoff_x_age, round((p.day - dob) / 365.25 * bouts, 6) AS age_x_experience FROM prior p LEFT JOIN fighter ON fighter = p.self""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = features.physical(history.bout_facts(P.bouts(spark, sf_dir)), P.fighters(spark, sf_dir))
    known = features.with_features(history.asof(facts, stats=False), "days_since_last_fight", "total_fights")
    return P.rounded(features.interactions(known).select("bout_id", "self", "layoff_x_age", "age_x_experience"))


#: Every feature as DuckDB says it, of a side `p` of prior, its fighter x and the opponent y.
FEATURE_SQL = {
    "slpm": "round(coalesce(p.sl, 0) * 60 / nullif(p.sec, 0), 6)", "sapm": "round(coalesce(p.osl, 0) * 60 / nullif(p.sec, 0), 6)", "td_avg_per_15": "round(coalesce(p.tdl, 0) * 900 / nullif(p.sec, 0), 6)",
    "sub_attempts_per_15": "round(coalesce(p.sub, 0) * 900 / nullif(p.sec, 0), 6)", "knockdown_rate": "round(coalesce(p.kd, 0) * 900 / nullif(p.sec, 0), 6)", "control_time_pct": "round(coalesce(p.ctl, 0) / nullif(p.sec, 0), 6)",
    "time_controlled_pct": "round(coalesce(p.octl, 0) / nullif(p.sec, 0), 6)", "striking_accuracy": "round(p.sl / nullif(p.sa, 0), 6)", "takedown_accuracy": "round(p.tdl / nullif(p.tda, 0), 6)",
    "significant_strike_rate": "round(p.sl / nullif(p.tl, 0), 6)", "career_win_pct": "round(p.wins / nullif(p.decided, 0), 6)", "decision_win_pct": "round(p.dw / nullif(p.decided, 0), 6)",
    "decision_loss_pct": "round(p.dl / nullif(p.decided, 0), 6)", "submission_success_rate": "round(p.sw / nullif(p.sub, 0), 6)", "finish_rate": "round(p.fin / nullif(p.wins, 0), 6)",
    "ko_loss_rate": "round(p.kol / nullif(p.losses, 0), 6)", "sub_loss_rate": "round(p.subl / nullif(p.losses, 0), 6)", "avg_fight_time_seconds": "round(p.sec / nullif(p.ntimed, 0), 6)",
    "total_fights": "CAST(p.bouts AS BIGINT)", "submission_win_count": "CAST(coalesce(p.sw, 0) AS BIGINT)", "title_fight_experience": "CAST(coalesce(p.titles, 0) AS BIGINT)", "times_knocked_down": "CAST(coalesce(p.okd, 0) AS BIGINT)",
    "total_seconds": "CAST(coalesce(p.sec, 0) AS BIGINT)", "striking_defense": "round(1 - p.osl / nullif(p.osa, 0), 6)", "takedown_defense": "round(1 - p.otdl / nullif(p.otda, 0), 6)",
    "days_since_last_fight": "CAST(p.day - p.last_day AS INT)", "striking_output_decay": "round(p.lsl / nullif(p.lr, 0) - p.esl / nullif(p.er, 0), 6)", "takedown_output_decay": "round(p.ltd / nullif(p.lr, 0) - p.etd / nullif(p.er, 0), 6)",
    "age": "round((p.day - x.dob) / 365.25, 6)", "height_cm": "x.height_cm", "reach_cm": "x.reach_cm", "reach_to_height_ratio": "round(x.reach_cm / x.height_cm, 6)", "stance": "x.stance", "stance_matchup": "x.stance || ' vs ' || y.stance",
    "is_open_stance_matchup": "coalesce((x.stance = 'orthodox' AND y.stance = 'southpaw') OR (x.stance = 'southpaw' AND y.stance = 'orthodox'), false)",
}
_ALL = ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
#: feat: all features of every side, with the opponent.
FEAT = f"{ASOF}, feat AS MATERIALIZED (SELECT p.bout_id, p.self, s.opp, s.corner, {_ALL} FROM prior p JOIN sides s ON s.bout_id = p.bout_id AND s.self = p.self LEFT JOIN fighter x ON x.fighter = p.self LEFT JOIN fighter y ON y.fighter = s.opp)"


def _named(prefix: str, alias: str, names=tuple(FEATURE_SQL)) -> str:
    return ", ".join(f"{alias}.{n} AS {prefix}_{n}" for n in names)


@query(f"""{FEAT} SELECT b.bout_id, b.day, b.weight_class, b.is_title, b.scheduled_rounds, b.red AS red_fighter_id, b.blue AS blue_fighter_id, {_named("red", "r")}, {_named("blue", "l")}
    FROM bout b JOIN feat r ON r.bout_id = b.bout_id AND r.self = b.red JOIN feat l ON l.bout_id = b.bout_id AND l.self = b.blue""")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature row of every bout, upcoming ones too."""
    b = P.bouts(spark, sf_dir)
    return P.rounded(features.feature_rows(b, P.rounds(spark, sf_dir, b), P.fighters(spark, sf_dir)))


LOOKUP = ("career_win_pct", "total_fights", "total_seconds", "days_since_last_fight", "slpm", "striking_accuracy", "finish_rate", "ko_loss_rate")


@query(f"""{ASOF}, daily AS (SELECT h.self, h.day, count(*) AS bouts, count(h.won) AS decided, sum(h.won) AS wins, sum(CASE WHEN h.won = 1 AND h.m NOT LIKE 'decision%' AND h.m <> 'dq' THEN 1 ELSE 0 END) AS fin, sum(CASE WHEN h.won = 0 AND h.m <> 'dq' THEN 1 ELSE 0 END) AS losses,
        sum(CASE WHEN h.won = 0 AND h.m LIKE 'ko%' THEN 1 ELSE 0 END) AS kol, sum(h.sec) AS sec, sum(sl) AS sl, sum(sa) AS sa FROM timed h LEFT JOIN per USING (bout_id, self) WHERE h.status = 'completed' GROUP BY 1, 2),
    known AS (SELECT self, day AS last_day, {", ".join(f"sum({c}) OVER w AS {c}" for c in ("bouts", "decided", "wins", "fin", "losses", "kol", "sec", "sl", "sa"))} FROM daily WINDOW w AS (PARTITION BY self ORDER BY day)),
    asked AS (SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 50 <> 0 THEN c_custkey % 120 END AS self, CASE WHEN c_custkey % 49 <> 0 THEN DATE '1991-06-01' + CAST(c_custkey * 37 % 3300 AS INT) END AS day FROM customer)
    SELECT p.ask_id, p.self, p.day, {", ".join(f"{FEATURE_SQL[n] if n != 'total_fights' else 'CAST(coalesce(p.bouts, 0) AS BIGINT)'} AS {n}" for n in LOOKUP)} FROM (SELECT a.*, k.* EXCLUDE (self) FROM asked a ASOF LEFT JOIN known k ON a.self = k.self AND a.day > k.last_day) p""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of made-up (fighter, day) pairs: days without a bout, before a career and after it, unknown fighters, null fighters and days."""
    k = F.col("c_custkey")
    asked = P.table(spark, sf_dir, "customer").select(k.alias("ask_id"), F.when(k % 50 != 0, k % 120).alias("self"), F.when(k % 49 != 0, F.date_add(F.lit("1991-06-01").cast("date"), (k * 37 % 3300).cast("int"))).alias("day"))
    return P.rounded(features.at(asked, P.facts(spark, sf_dir), None, *LOOKUP))


def _by_bout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows of decided bouts, with the winner."""
    b = P.bouts(spark, sf_dir)
    decided = b.where("status = 'completed' and winner is not null").select("bout_id", F.col("winner").alias("winner_id"))
    return features.feature_rows(b, P.rounds(spark, sf_dir, b), P.fighters(spark, sf_dir), decided).join(decided, "bout_id")


_OPP = tuple(n for n in FEATURE_SQL if n not in matrix.MIRRORED)
MATRIX = f"""{FEAT}, m AS (SELECT s.bout_id, s.day, s.weight_class, s.is_title, s.scheduled_rounds, s.corner AS source_corner, s.won AS self_won, s.self AS self_fighter_id, s.opp AS opp_fighter_id, {_named("self", "a")}, {_named("opp", "b", _OPP)}
    FROM sides s JOIN feat a ON a.bout_id = s.bout_id AND a.self = s.self JOIN feat b ON b.bout_id = s.bout_id AND b.self = s.opp WHERE s.status = 'completed' AND s.won IS NOT NULL)"""


@query(f"{MATRIX} SELECT * FROM m")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(matrix.symmetrize(_by_bout(spark, sf_dir)))


_NUMBERS = tuple(n for n in _OPP if n != "stance")


@query(f"{MATRIX} SELECT bout_id, source_corner, {', '.join(f'round(CAST(self_{n} AS DOUBLE) - opp_{n}, 6) AS diff_{n}' for n in _NUMBERS)}, self_won FROM m")
def differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.rounded(matrix.symmetrize(_by_bout(spark, sf_dir)))
    return P.rounded(matrix.differential(rows, keep=("bout_id", "source_corner")))


SPLIT = "CASE WHEN day < DATE '1996-01-01' THEN 'train' WHEN day < DATE '1998-01-01' THEN 'val' ELSE 'test' END"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = history.two_sides(P.bouts(spark, sf_dir).where("status = 'completed' and winner is not null"))
    return matrix.temporal_split(sides.withColumnRenamed("won", "self_won"), "1996-01-01", "1998-01-01")


@query(f"{WITH} SELECT bout_id, self, {SPLIT} AS split FROM sides WHERE status = 'completed' AND won IS NOT NULL")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("bout_id", "self", "split")


@query(f"""{WITH}, s AS (SELECT *, {SPLIT} AS split, count(*) OVER (PARTITION BY bout_id) AS n_sides FROM sides WHERE status = 'completed' AND won IS NOT NULL AND NOT (corner = 'blue' AND bout_id % 50 = 7)) SELECT split, count(*) AS "rows", count(DISTINCT bout_id) AS bouts, count(DISTINCT bout_id) FILTER (n_sides <> 2) AS broken_pairs, min(day) AS first_day, max(day) AS last_day, round(avg(won), 6) AS label_rate FROM s GROUP BY split""")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(matrix.split_report(_split(spark, sf_dir).where("not (corner = 'blue' and bout_id % 50 = 7)")))


@query(f"{WITH}, y AS (SELECT DISTINCT CAST(year(day) AS INT) AS val_year FROM pred WHERE year(day) > 1994) SELECT val_year, CASE WHEN year(day) = val_year THEN 'val' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT bout_id) AS bouts FROM pred JOIN y ON year(day) <= val_year GROUP BY 1, 2")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = matrix.year_folds(P.predictions(spark, sf_dir), 1994)
    return folds.groupBy("val_year", "role").agg(F.count("*").alias("n"), F.countDistinct("bout_id").alias("bouts"))


@query(f"{WITH} SELECT CAST(year(day) AS INT) AS year, count(*) AS n, round(avg(CASE WHEN winner = red THEN 1.0 ELSE 0.0 END), 6) AS red_rate FROM bout WHERE winner IS NOT NULL AND status = 'completed' GROUP BY 1")
def corner_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import evaluation

    return P.rounded(evaluation.corner_rates(P.bouts(spark, sf_dir).where("status = 'completed'"), [F.year("day").alias("year")]))


# Ratings ------------------------------------------------------------------------------------------------------------------------


def _elo_sql(k: str) -> str:
    """Ratings by a recursive query that carries all ratings in a map. k: the factor, with n as the number of earlier bouts."""
    return f"""{WITH}, seq AS (SELECT row_number() OVER (ORDER BY day, bout_id) AS i, bout_id, day, red, blue, winner FROM bout WHERE status = 'completed' AND winner IS NOT NULL),
    ids AS (SELECT list(DISTINCT s_suppkey) AS l FROM supplier),
    run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS bout_id, NULL::DOUBLE AS elo_red, NULL::DOUBLE AS elo_blue, map_from_entries([(f, 1500.0::DOUBLE) for f in l]) AS ratings, map_from_entries([(f, 0) for f in l]) AS counts FROM ids
        UNION ALL SELECT s.i, s.bout_id, ratings[s.red], ratings[s.blue],
        map_from_entries([(e.key, CASE WHEN e.key = s.red THEN e.value + ({k.format(n="counts[s.red]")}) * ((s.winner = s.red)::INT - 1 / (1 + pow(10, (ratings[s.blue] - ratings[s.red]) / 400)))
            WHEN e.key = s.blue THEN e.value - ({k.format(n="counts[s.blue]")}) * ((s.winner = s.red)::INT - 1 / (1 + pow(10, (ratings[s.blue] - ratings[s.red]) / 400))) ELSE e.value END) for e in map_entries(ratings)]),
        map_from_entries([(e.key, e.value + (e.key IN (s.red, s.blue))::INT) for e in map_entries(counts)])
        FROM run JOIN seq s ON s.i = run.i + 1),
    elo AS (SELECT bout_id, elo_red, elo_blue FROM run WHERE bout_id IS NOT NULL)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bouts(spark, sf_dir).where("status = 'completed' and winner is not null")


@query(f"{_elo_sql('32')} SELECT bout_id, round(elo_red, 6) AS elo_red, round(elo_blue, 6) AS elo_blue FROM elo")
def elo_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(elo.relaxed(_decided(spark, sf_dir)))


@query(f"{_elo_sql('24 + 40 * exp(-{n} / 10.0)')} SELECT bout_id, round(elo_red, 6) AS elo_red, round(elo_blue, 6) AS elo_blue FROM elo")
def elo_experience_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(elo.relaxed(_decided(spark, sf_dir), elo.experience_factor(64, 24, 10)))


SOS = f"""{_elo_sql('32')}, s AS (SELECT bout_id, day, self, CASE corner WHEN 'red' THEN elo_red ELSE elo_blue END AS mine, CASE corner WHEN 'red' THEN elo_blue ELSE elo_red END AS other FROM sides JOIN elo USING (bout_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY self ORDER BY day, bout_id) AS k FROM s)"""


@query(f"{SOS} SELECT a.bout_id, a.self, round(avg(b.other) FILTER (b.k >= a.k - 3), 6) AS sos_last_3, round(avg(b.other), 6) AS sos_last_5 FROM n a LEFT JOIN n b ON a.self = b.self AND b.k < a.k AND b.k >= a.k - 5 GROUP BY 1, 2")
def sos_last_3_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _decided(spark, sf_dir)
    rated = elo.by_side(elo.relaxed(b), history.two_sides(b))
    return P.rounded(elo.strength_of_schedule(rated, 3, 5).select("bout_id", "self", "sos_last_3", "sos_last_5"))


@query(f"{SOS} SELECT self, count(*) AS bouts, round(max(mine), 6) AS peak, arg_max(day, (mine, -datediff('day', DATE '1970-01-01', day))) AS peak_day FROM n GROUP BY self")
def elo_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _decided(spark, sf_dir)
    return P.rounded(elo.timeline(elo.by_side(elo.relaxed(b), history.two_sides(b))))


@query(f"{_elo_sql('32')}, e AS (SELECT (winner = red)::INT AS y, 1 / (1 + pow(10, (elo_blue - elo_red) / 400)) AS p FROM elo JOIN bout USING (bout_id)) SELECT count(*) AS n, round(avg(((p > 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM e")
def elo_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _decided(spark, sf_dir)
    scored = elo.relaxed(b).join(b, "bout_id").select((F.col("winner") == F.col("red")).cast("int").alias("y"), S.elo_expectation("elo_red", "elo_blue").alias("p"))
    return P.rounded(metrics.evaluate(scored).drop("ece"))


@query()
def elo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _decided(spark, sf_dir)
    configs = spark.createDataFrame([(n, v, s) for n in (48.0, 64.0, 80.0) for v in (16.0, 24.0, 32.0) for s in (3.0, 10.0, 20.0, 40.0)], "k_new double, k_veteran double, k_scale double")
    rated = elo.grid(b, configs, elo.experience_k, keep=("winner", "red"))
    scored = rated.select("k_new", "k_veteran", "k_scale", (F.col("winner") == F.col("red")).cast("int").alias("y"), S.elo_expectation("elo_red", "elo_blue").alias("p"))
    return P.rounded(metrics.evaluate(scored, by=("k_new", "k_veteran", "k_scale")))


RECENT = f"""{WITH}, {P.PRIOR} SELECT s.bout_id, s.self, CAST(sum(h.osl) AS BIGINT) AS recent_damage FROM sides s
    LEFT JOIN (SELECT sides.self, day, coalesce(osl, NULL) AS osl FROM sides LEFT JOIN per USING (bout_id, self)) h ON h.self = s.self AND h.day < s.day AND h.day >= s.day - INTERVAL 24 MONTH GROUP BY 1, 2"""


@query(RECENT)
def recent_24mo(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = P.facts(spark, sf_dir).select("bout_id", "self", "day", F.col("opp_sig_landed").alias("damage"))
    return elo.trailing_months(facts, "damage", 24).select("bout_id", "self", "recent_damage")


#: The classes once more, as DuckDB tables: name, ladder, place.
CLASS_SQL = """cls(n, l, i) AS (VALUES ('flyweight', 'm', 1), ('bantamweight', 'm', 2), ('featherweight', 'm', 3), ('lightweight', 'm', 4), ('welterweight', 'm', 5), ('middleweight', 'm', 6), ('light heavyweight', 'm', 7), ('heavyweight', 'm', 8),
    ('women''s strawweight', 'w', 1), ('women''s flyweight', 'w', 2), ('women''s bantamweight', 'w', 3), ('women''s featherweight', 'w', 4), ('catch weight', 'a', NULL), ('catchweight', 'b', NULL), ('open weight', 'c', NULL), ('super heavyweight', 'd', NULL))"""


def _class_sql(c: str) -> str:
    return f"(SELECT n FROM cls WHERE contains(lower({c}), n) ORDER BY length(n) DESC LIMIT 1)"


def _step_sql(a: str, b: str) -> str:
    return f"(SELECT CAST(sign(y.i - x.i) AS INT) FROM cls x, cls y WHERE x.n = {a} AND y.n = {b} AND x.l = y.l)"


#: Class texts by number, and the class texts of the moves.
CLASS_TEXTS = ("Super Heavyweight Bout", "Catch Weight Bout", "UFC Light Heavyweight Title Bout", "Heavyweight Bout", "Women's Strawweight Bout", "Strawweight Bout", "Open Weight Bout", "Ultimate Flyweight Tournament", "Women's Flyweight Title Bout", "Middleweight Bout", "Bout", "Women's Featherweight Bout")
_TEXTS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in CLASS_TEXTS) + "]"


@query(f"""WITH {CLASS_SQL}, t AS (SELECT o_orderkey AS k, {_TEXTS}[o_orderkey % 12 + 1] AS a, {_TEXTS}[o_orderkey // 12 % 12 + 1] AS b FROM orders), c AS (SELECT k, {_class_sql("a")} AS before, {_class_sql("b")} AS now FROM t)
    SELECT k, before, now, {_step_sql("before", "now")} AS step FROM c""")
def weight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    texts = P.table(spark, sf_dir, "orders").select(k.alias("k"), P.pick(k % 12, CLASS_TEXTS).alias("a"), P.pick(F.floor(k / 12) % 12, CLASS_TEXTS).alias("b"))
    return texts.select("k", S.weight_class("a").alias("before"), S.weight_class("b").alias("now")).withColumn("step", S.ladder_step("before", "now"))


@query(f"""{WITH}, {CLASS_SQL}, c AS (SELECT bout_id, self, day, {_class_sql("weight_class")} AS wc FROM sides),
    p AS (SELECT a.bout_id, a.self, a.wc, (SELECT arg_max(coalesce(b.wc, '?'), (b.day, b.bout_id)) FROM c b WHERE b.self = a.self AND b.day < a.day) AS before FROM c a)
    SELECT bout_id, self, wc AS weight_class, {_step_sql("before", "wc")} AS weight_class_change FROM p""")
def class_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = history.two_sides(P.bouts(spark, sf_dir)).withColumn("weight_class", F.coalesce(S.weight_class("weight_class"), F.lit("?")))
    moved = elo.previous_class(sides)
    return moved.select("bout_id", "self", F.nullif("weight_class", F.lit("?")).alias("weight_class"), S.ladder_step("prev_weight_class", "weight_class").alias("weight_class_change"))
