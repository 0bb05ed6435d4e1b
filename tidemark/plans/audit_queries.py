"""Queries that align, attach, check and calibrate predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation as E
from tidemark.operators import history, many_fits, matrix, metrics
from tidemark.plans import projection as P
from tidemark.plans.registry import query

WITH = f"WITH RECURSIVE {P.SQL}"
LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"


@query(f"{WITH} SELECT bout_id, self, y, round(p, 6) AS p, round(q, 6) AS q, round(r, 6) AS r FROM pred WHERE bout_id % 7 <> 0 AND self % 11 <> 0")
def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' predictions side by side, on the rows that all of them have."""
    rows = P.predictions(spark, sf_dir)
    frames = [rows.select("bout_id", "self", "y", "p"), rows.where("bout_id % 7 <> 0").select("bout_id", "self", "y", "q"), rows.where("self % 11 <> 0").select("bout_id", "self", "y", "r")]
    return P.rounded(E.align(*frames, keys=["bout_id", "self"], label="y"))


@query(f"{WITH}, s AS (SELECT bout_id, CASE WHEN (bout_id * 31 + self) % 10 < 7 THEN 'train' ELSE 'val' END AS split FROM sides) SELECT bout_id, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def shared_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts whose rows a careless split by row tears apart."""
    sides = history.two_sides(P.bouts(spark, sf_dir))
    return matrix.shared_bouts(sides.withColumn("split", F.when((F.col("bout_id") * 31 + F.col("self")) % 10 < 7, "train").otherwise("val")))


@query(f"{WITH}, n AS (SELECT bout_id % 200 AS draw, avg(abs(p - y)) AS ece FROM pred GROUP BY 1) SELECT round(quantile_cont(ece, 0.95), 6) AS p95, round(avg((ece >= 0.52)::INT), 6) AS p_value FROM n")
def null_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error against the distribution of the errors of groups."""
    draws = P.predictions(spark, sf_dir).groupBy((F.col("bout_id") % 200).alias("draw")).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("ece"))
    return P.rounded(E.against_null(draws, 0.52))


@query(f"{WITH} SELECT bout_id, corner AS source_corner, CASE corner WHEN 'red' THEN bout_id % 13 ELSE bout_id % 17 END AS self_rank, CASE corner WHEN 'red' THEN bout_id % 17 ELSE bout_id % 13 END AS opp_rank FROM sides")
def attached_by_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a bout's corners on its mirrored rows."""
    b = P.bouts(spark, sf_dir)
    rows = history.two_sides(b).select("bout_id", F.col("corner").alias("source_corner"))
    return matrix.attach_by_corner(rows, b.select("bout_id", (F.col("bout_id") % 13).alias("red_rank"), (F.col("bout_id") % 17).alias("blue_rank")), "rank")


@query(f"{WITH} SELECT bout_id, self, name, reach_cm FROM sides JOIN fighter ON fighter = self")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides with what every fighter must have; a missing one would fail the read."""
    sides = history.two_sides(P.bouts(spark, sf_dir)).select("bout_id", "self")
    return matrix.guarded_join(sides, P.fighters(spark, sf_dir).select(F.col("fighter").alias("self"), "name", "reach_cm"), ["self"], "name", "reach_cm")


@query(f"{WITH}, e AS (SELECT CASE WHEN year(day) < 1994 THEN 'to 1993' WHEN year(day) < 1997 THEN '1994 to 1996' ELSE 'from 1997' END AS era, winner = red AS won FROM bout WHERE status = 'completed' AND winner IS NOT NULL) SELECT era, count(*) AS n, round(avg(won::INT), 6) AS red_rate FROM e GROUP BY 1")
def era_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("day")
    era = F.when(y < 1994, "to 1993").when(y < 1997, "1994 to 1996").otherwise("from 1997").alias("era")
    return P.rounded(E.corner_rates(P.bouts(spark, sf_dir).where("status = 'completed'"), [era]))


#: Newton's steps for slope a and intercept b of a logistic map, as a recursive query over sums.
PLATT = f"""fit AS (SELECT y, {LOGIT.format("q")} AS x FROM pred WHERE year(day) < 1996),
    steps AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
        FROM (SELECT i, a, b, avg((p - y) * x) AS g1, avg(p - y) AS g2, avg(p * (1 - p) * x * x) AS h11, avg(p * (1 - p) * x) AS h12, avg(p * (1 - p)) AS h22
              FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM steps, fit WHERE i < 12) GROUP BY i, a, b)),
    last_ AS (SELECT a, b FROM steps ORDER BY i DESC LIMIT 1)"""


@query(f"{WITH}, {PLATT} SELECT round(a, 6) AS slope, round(b, 6) AS intercept FROM last_")
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = E.platt_weights(P.predictions(spark, sf_dir).where(F.year("day") < 1996), "y", "q")
    return P.rounded(spark.createDataFrame([(a, b)], "slope double, intercept double"))


@query(f"""{WITH}, {PLATT}, m AS (SELECT bout_id, self, y, 1 / (1 + exp(-(a * {LOGIT.format("q")} + b))) AS one, 1 / (1 + exp(-(a * {LOGIT.format("(1 - q)")} + b))) AS other FROM pred, last_ WHERE year(day) >= 1996),
    c AS (SELECT y, (one + 1 - other) / 2 AS p FROM m) SELECT count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM c""")
def platt_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetrised map on later years."""
    rows = P.predictions(spark, sf_dir)
    mapped = rows.where(F.year("day") >= 1996).withColumn("m", E.platt(rows.where(F.year("day") < 1996), "y", "q")(F.col("q")))
    return P.rounded(metrics.evaluate(mapped, "y", "m").select("n", "brier", "log_loss"))


@query(f"""{WITH}, {P.PRIOR}, x AS (SELECT s.won AS y, CAST(a.bouts - b.bouts AS DOUBLE) AS u, CAST(coalesce(a.sec, 0) - coalesce(b.sec, 0) AS DOUBLE) AS v FROM sides s JOIN prior a ON a.bout_id = s.bout_id AND a.self = s.self JOIN prior b ON b.bout_id = s.bout_id AND b.self = s.opp WHERE s.status = 'completed' AND s.won IS NOT NULL),
    z AS MATERIALIZED (SELECT y, (u - avg(u) OVER ()) / stddev_samp(u) OVER () AS u, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS v FROM x),
    steps AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
        FROM (SELECT i, a, b, sum((p - y) * u) + a AS g1, sum((p - y) * v) + b AS g2, sum(p * (1 - p) * u * u) + 1 AS h11, sum(p * (1 - p) * u * v) AS h12, sum(p * (1 - p) * v * v) + 1 AS h22
              FROM (SELECT i, a, b, u, v, y, 1 / (1 + exp(-(a * u + b * v))) AS p FROM steps, z WHERE i < 12) GROUP BY i, a, b)),
    last_ AS (SELECT a, b FROM steps ORDER BY i DESC LIMIT 1) SELECT 'diff_total_fights' AS feature, round(a, 6) AS weight FROM last_ UNION ALL SELECT 'diff_total_seconds', round(b, 6) FROM last_""")
def lr_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of a ridge regression on two standardised differences, all rows in one fold."""
    from tidemark.plans.feature_queries import _by_bout

    rows = matrix.differential(matrix.symmetrize(_by_bout(spark, sf_dir)), keep=("bout_id",))
    names = ("diff_total_fights", "diff_total_seconds")
    fits = many_fits.fit(rows, "self_won", [many_fits.Spec("two", names)])
    return P.rounded(spark.createDataFrame([(n, fits.coefficients(0)[n]) for n in names], "feature string, weight double"))


@query(f"{WITH} SELECT bout_id, self, round((3 * p + q) / 4, 6) AS by_probability, round(1 / (1 + exp(-(3 * {LOGIT.format('p')} + {LOGIT.format('q')}) / 4)), 6) AS by_logit FROM pred")
def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.predictions(spark, sf_dir)
    return P.rounded(rows.select("bout_id", "self", S.blend(["p", "q"], [3, 1]).alias("by_probability"), S.blend(["p", "q"], [3, 1], "logit").alias("by_logit")))
