"""Queries over prices, predictions and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation as E
from tidemark.operators import search as sequential
from tidemark.operators import boosting, features, history, many_fits, metrics, odds, ranks
from tidemark.plans import projection as P
from tidemark.plans.registry import query
from tidemark.session import cut, shared_dir

WITH = f"WITH {P.SQL}"
CLOSING = f"""{WITH}, last AS (SELECT bout_id, fighter, book, arg_max(moneyline, collected_at) AS moneyline, max(collected_at) AS collected_at FROM price GROUP BY 1, 2, 3),
    raw AS (SELECT *, CASE WHEN moneyline < 0 THEN -moneyline / (-moneyline + 100.0) ELSE 100.0 / (moneyline + 100.0) END AS raw_prob FROM last),
    fair AS (SELECT *, count(*) OVER (PARTITION BY bout_id, book) AS n_sides, raw_prob / sum(raw_prob) OVER (PARTITION BY bout_id, book) AS prob FROM raw),
    line AS (SELECT bout_id, fighter, median(prob) AS market_prob, count(*) AS n_books FROM fair GROUP BY 1, 2)"""


@query(f"{CLOSING} SELECT bout_id, fighter, book, moneyline, n_sides, round(raw_prob, 6) AS raw_prob, round(prob, 6) AS prob FROM fair")
def closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(odds.closing_prices(P.prices(spark, sf_dir)).drop("collected_at"))


@query(f"{CLOSING} SELECT bout_id, fighter, round(market_prob, 6) AS market_prob, n_books FROM line")
def closing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(odds.closing_line(P.prices(spark, sf_dir)))


def _metrics_sql(source: str, y: str, p: str, by: str = "", n: int = 10) -> str:
    """All metrics of a source by other means than the engine: one pass for the means, one for the bins."""
    edges = ", ".join(f"{i / n!r}::DOUBLE" for i in range(1, n))
    key, group, using = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    return f"""m AS (SELECT {key}count(*) AS n, round(avg((({p} > 0.5) = ({y} = 1))::INT), 6) AS accuracy, round(avg(-CASE WHEN {y} = 1 THEN ln(greatest({p}, 1e-15)) ELSE ln(1 - least({p}, 1 - 1e-15)) END), 6) AS log_loss, round(avg(({p} - {y}) ** 2), 6) AS brier FROM {source} {group}),
    bins AS (SELECT {key}len([e for e in [{edges}] if e < {p}]) AS b, count(*) AS c, avg({p}) AS mp, avg({y}) AS my FROM {source} GROUP BY ALL),
    cal AS (SELECT {key}round(sum(c * abs(mp - my)) / sum(c), 6) AS ece FROM bins {group})
    SELECT m.*, cal.ece FROM m JOIN cal {using}"""


@query(f"{CLOSING}, won AS (SELECT user_id AS fighter, (sum(value) = max(sum(value)) OVER (PARTITION BY user_id // 2))::INT AS y FROM events GROUP BY user_id), covered AS (SELECT y, market_prob AS p FROM line JOIN won USING (fighter)), " + _metrics_sql("covered", "y", "p"))
def market_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices name other pairs than the bouts do; here the side with the larger total value has won. Totals are summed once and compared
    with themselves: a second sum of the same values in another order may differ in its last digit, and a pair would have no winner."""
    total = P.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("self")).agg(F.sum("value").alias("v")).withColumn("bout_id", F.floor(F.col("self") / 2).cast("long"))
    sides = total.select("bout_id", "self", (F.col("v") == F.max("v").over(Window.partitionBy("bout_id"))).cast("int").alias("y"))
    covered = odds.market_baseline(sides, odds.closing_line(P.prices(spark, sf_dir)))
    return P.rounded(metrics.evaluate(covered, "y", "market_prob"))


@query(f"{WITH}, " + _metrics_sql("pred", "y", "p", "corner"))
def evaluate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(metrics.evaluate(P.predictions(spark, sf_dir), "y", "p", by=("corner",)))


@query(f"""{WITH}, e AS (SELECT unnest(range(10)) AS bin), b AS (SELECT len([e for e in [{", ".join(f"{i / 10!r}::DOUBLE" for i in range(1, 10))}] if e < r]) AS bin, count(*) AS n, avg(r) AS mp, avg(y) AS my FROM pred GROUP BY 1)
    SELECT CAST(bin AS INT) AS bin, bin / 10 AS lower, (bin + 1) / 10 AS upper, coalesce(n, 0) AS n, round(mp, 6) AS mean_pred, round(my, 6) AS mean_true FROM e LEFT JOIN b USING (bin)""")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(metrics.reliability(P.predictions(spark, sf_dir), "y", "r"))


@query(f"{WITH}, " + ", ".join(f"b{n} AS (SELECT {n} AS n_bins, len([e for e in [{', '.join(f'{i / n!r}::DOUBLE' for i in range(1, n))}] if e < p]) AS b, count(*) AS c, avg(p) AS mp, avg(y) AS my FROM pred GROUP BY ALL)" for n in (5, 10, 15, 20)) + " SELECT n_bins, round(sum(c * abs(mp - my)) / sum(c), 6) AS ece FROM (SELECT * FROM b5 UNION ALL SELECT * FROM b10 UNION ALL SELECT * FROM b15 UNION ALL SELECT * FROM b20) GROUP BY 1")
def ece_by_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(metrics.ece_by_bins(P.predictions(spark, sf_dir), "y", "p"))


@query(f"WITH {P.SQL}, {P.PRIOR}, x AS (SELECT pred.*, CASE WHEN last_day IS NULL THEN 'none before' WHEN prior.day - last_day <= 30 THEN '<=30' WHEN prior.day - last_day <= 120 THEN '(30, 120]' ELSE '>120' END AS bucket FROM pred JOIN prior USING (bout_id, self)), " + _metrics_sql("x", "y", "q", "bucket"))
def bucket_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = features.with_features(history.asof(history.bout_facts(P.bouts(spark, sf_dir)), stats=False), "days_since_last_fight")
    rows = P.predictions(spark, sf_dir).join(known.select("bout_id", "self", "days_since_last_fight"), ["bout_id", "self"])
    return P.rounded(metrics.evaluate_buckets(rows, "days_since_last_fight", (30, 120), "y", "q"))


@query(f"{WITH}, s AS (SELECT bout_id, sum(p) AS t FROM pred GROUP BY 1 HAVING count(*) = 2) SELECT round(max(abs(t - 1)), 6) AS max_deviation, round(avg(abs(t - 1)), 6) AS mean_deviation, count(*) AS pairs FROM s")
def pair_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(metrics.pair_deviation(P.predictions(spark, sf_dir)))


@query(f"{WITH} SELECT unnest(['p', 'p', 'q']) AS a, unnest(['q', 'r', 'r']) AS b, unnest([round(corr(p, q), 6), round(corr(p, r), 6), round(corr(q, r), 6)]) AS corr FROM pred")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(E.correlations(P.predictions(spark, sf_dir), ("p", "q", "r")))


@query(f"{WITH} SELECT unnest(['p', 'p', 'q']) AS a, unnest(['q', 'r', 'r']) AS b, unnest([round(corr(y - p, y - q), 6), round(corr(y - p, y - r), 6), round(corr(y - q, y - r), 6)]) AS corr FROM pred")
def residual_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(E.residual_correlations(P.predictions(spark, sf_dir), "y", ("p", "q", "r")))


LOSS = "-CASE WHEN y = 1 THEN ln(greatest({0}, 1e-15)) ELSE ln(1 - least({0}, 1 - 1e-15)) END"


@query(f"""{WITH}, l AS (SELECT *, {LOSS.format("p")} AS lp, {LOSS.format("q")} AS lq, {LOSS.format("r")} AS lr FROM pred)
    SELECT round(avg((NOT ((p > 0.5) = (q > 0.5) AND (q > 0.5) = (r > 0.5)))::INT), 6) AS disagreement, round(avg(least(lp, lq, lr)), 6) AS oracle_loss, round(avg((lp <= lq AND lp <= lr)::INT), 6) AS share_p,
    round(avg((lq < lp AND lq <= lr)::INT), 6) AS share_q, round(avg((lr < lp AND lr < lq)::INT), 6) AS share_r FROM l""")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(E.disagreement(P.predictions(spark, sf_dir), "y", ("p", "q", "r")))


@query(f"""{WITH}, g AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS i, a / 20.0::DOUBLE AS w0, (1 - a / 20.0::DOUBLE) * (b / 20.0::DOUBLE) AS w1, (1 - a / 20.0::DOUBLE) * (1 - b / 20.0::DOUBLE) AS w2 FROM range(21) t(a), range(21) u(b)),
    lg AS (SELECT y, {", ".join(f"ln(greatest(1e-6, least(1 - 1e-6, {c})) / (1 - greatest(1e-6, least(1 - 1e-6, {c})))) AS {n}" for c, n in (("p", "x0"), ("q", "x1"), ("r", "x2")))} FROM pred)
    SELECT CAST(i AS INT) AS i, round(avg(-CASE WHEN y = 1 THEN ln(greatest(s, 1e-15)) ELSE ln(1 - least(s, 1 - 1e-15)) END), 6) AS log_loss FROM (SELECT i, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2))) AS s FROM lg, g) GROUP BY 1""")
def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(E.blend_losses(P.predictions(spark, sf_dir), "y", ("p", "q", "r"), step=0.05).drop("weights"))


KS = """SELECT '{0}' AS feature, (SELECT max(abs(fa - fb)) FROM (SELECT v, (SELECT count(*) FROM pred a WHERE year(a.day) < 1996 AND a.{0} <= v) / (SELECT count(*) FROM pred WHERE year(day) < 1996) AS fa,
    (SELECT count(*) FROM pred b WHERE year(b.day) >= 1996 AND b.{0} <= v) / (SELECT count(*) FROM pred WHERE year(day) >= 1996) AS fb FROM (SELECT DISTINCT {0} AS v FROM pred))) AS d,
    count(*) FILTER (year(day) < 1996) AS n_a, count(*) FILTER (year(day) >= 1996) AS n_b, avg({0}) FILTER (year(day) < 1996) AS mean_a, avg({0}) FILTER (year(day) >= 1996) AS mean_b, stddev_pop({0}) FILTER (year(day) < 1996) AS std_a, stddev_pop({0}) FILTER (year(day) >= 1996) AS std_b FROM pred"""


@query(f"""{WITH}, k AS ({KS.format('p')} UNION ALL {KS.format('q')}), x AS (SELECT *, (m + 0.12 + 0.11 / m) * d AS x FROM (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) AS m FROM k))
    SELECT feature, round(d, 6) AS d, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b,
    round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(2 * power(-1, j - 1) * exp(-2 * j * j * x * x)) FROM range(1, 101) t(j)))) END, 6) AS p_value FROM x""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = E.ks_drift(P.predictions(spark, sf_dir), ("p", "q"), F.year("day") < 1996)
    return P.rounded(drift.select("feature", "d", "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "p_value"))


_QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
_QUANTILE_COLUMNS = {"l_extendedprice": "lineitem", "l_quantity": "lineitem", "l_tax": "lineitem"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, round(quantile_cont(CASE WHEN l_partkey % 7 <> 0 THEN {c} END, {p}), 6) AS quantile FROM lineitem" for c in _QUANTILE_COLUMNS for p in _QUANTILES))
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of columns with many, few and missing values."""
    lines = P.table(spark, sf_dir, "lineitem").select(*[F.when(F.col("l_partkey") % 7 != 0, F.col(c)).alias(c) for c in _QUANTILE_COLUMNS])
    return P.rounded(ranks.quantiles(lines, list(_QUANTILE_COLUMNS), _QUANTILES))


@query(f"""WITH {P.SQL}, {P.PRIOR}, x AS (SELECT p.bout_id, p.self, year(p.day) < 1996 AS early, p.wins / nullif(p.decided, 0) AS career_win_pct, p.fin / nullif(p.wins, 0) AS finish_rate FROM prior p JOIN sides s USING (bout_id, self) WHERE s.status = 'completed' AND s.won IS NOT NULL),
    m AS (SELECT median(career_win_pct) FILTER (early) AS a, median(finish_rate) FILTER (early) AS b FROM x)
    SELECT bout_id, self, round(coalesce(career_win_pct, a), 6) AS career_win_pct, round(coalesce(finish_rate, b), 6) AS finish_rate, CAST(career_win_pct IS NULL AS INT)::DOUBLE AS career_win_pct_missing, CAST(finish_rate IS NULL AS INT)::DOUBLE AS finish_rate_missing FROM x, m""")
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing features filled with the medians of the earlier years, in all years."""
    names = ("career_win_pct", "finish_rate")
    known = features.with_features(history.asof(history.bout_facts(P.bouts(spark, sf_dir)), stats=False), *names).where("status = 'completed' and won is not null")
    rows = known.select("bout_id", "self", "day", *names)
    filled = E.impute(rows.where(F.year("day") < 1996), rows, columns=names)[1]
    return P.rounded(filled.drop("day"))


@query(f"{WITH}, f AS (SELECT year(day) AS v, avg({LOSS.format('q')}) AS l FROM pred GROUP BY 1) SELECT round(corr(v, l), 6) AS trend, count(*) AS folds FROM f")
def fold_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(E.fold_trend(P.predictions(spark, sf_dir), "y", "q", F.year("day")))


@query()
def shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.predictions(spark, sf_dir).select("bout_id", "self", "y", "p")
    return P.rounded(metrics.evaluate(E.shuffled_labels(rows, "y"), "y", "p"))


@query()
def shuffle_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _training(spark, sf_dir)
    train, held = rows.where(F.year("day") < 1996).cache(), rows.where(F.year("day") >= 1996)
    return P.rounded(E.shuffle_test(train, held, columns, "self_won"))


@query()
def blend_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.predictions(spark, sf_dir).cache()
    return P.rounded(E.blend_comparison(rows.where(F.year("day") < 1996), rows.where(F.year("day") >= 1996), "y", ("p", "q", "r")))


@query()
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.permutation_null(P.predictions(spark, sf_dir).select("bout_id", "self", "y", "q"), "y", "q", 173)


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    columns = ["career_win_pct", "total_fights", "days_since_last_fight", "finish_rate"]
    known = features.with_features(history.asof(history.bout_facts(P.bouts(spark, sf_dir)), stats=False), *columns).where("status = 'completed' and won is not null")
    other = known.select("bout_id", F.col("self").alias("opp"), *[F.col(c).alias(f"o_{c}") for c in columns])
    rows = known.join(other, ["bout_id", "opp"])
    return rows.select("bout_id", "day", "self", F.col("won").alias("self_won"), *[(F.col(c) - F.col(f"o_{c}")).alias(f"diff_{c}") for c in columns]), [f"diff_{c}" for c in columns]


@query()
def lr_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions over all differences for every year from 1993, fitted together."""
    rows, columns = _matrix(spark, sf_dir)
    return P.rounded(many_fits.fold_losses(cut(rows), "self_won", {"all": columns, "four": columns[:4]}, [1993, 1994, 1995, 1996, 1997, 1998]))


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Both rows of every decided bout with the differences of all numeric features, missing ones left missing, and the columns' names."""
    from tidemark.operators import matrix
    from tidemark.plans.feature_queries import _by_bout

    rows = matrix.differential(matrix.symmetrize(_by_bout(spark, sf_dir)), keep=("bout_id", "day", "source_corner"))
    return rows, [c for c in rows.columns if c.startswith("diff_")]


@query()
def gbt_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over all differences, missing values as they are, for every year from 1995; all years' models grow together. Of each
    year the metrics, and by how much the two probabilities of a bout miss 1."""
    rows, columns = _matrix(spark, sf_dir)
    oof = cut(boosting.out_of_fold(cut(rows), columns, "self_won", [1995, 1996, 1997, 1998], params=boosting.Params(trees=10)))
    pairs = oof.groupBy("val_year", "bout_id").agg(F.abs(F.sum("p") - 1).alias("miss")).groupBy("val_year").agg(F.max("miss").alias("max_pair_miss"), F.avg("miss").alias("mean_pair_miss"))
    return P.rounded(metrics.evaluate(oof, "self_won", "p", by=("val_year",)).join(pairs, "val_year"))


@query()
def gbt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses of a short sequential search over boosted trees, judged by two years."""
    rows, columns = _matrix(spark, sf_dir)
    space = {"trees": sequential.Real(2, 6, whole=True), "depth": sequential.Real(1, 3, whole=True), "rate": sequential.Real(0.05, 0.5, log=True), "least": (5, 20, 80)}
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    E.search_boosted(cut(rows), columns, "self_won", [1996, 1997], path, "short", space=space, n=6, batch=3, warm_up=3)
    return P.rounded(sequential.trials(spark, path, "short"))


#: Groups of differences that are added and left out.
GROUPS = {"experience": ("diff_total_fights", "diff_avg_fight_time_seconds", "diff_title_fight_experience"), "finishing": ("diff_finish_rate", "diff_ko_loss_rate", "diff_sub_loss_rate"), "body": ("diff_age", "diff_height_cm", "diff_reach_cm")}


@query()
def feature_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative, leave-one-out, added and single-column differences of the mean fold loss, all models from the same scans."""
    rows, _ = _matrix(spark, sf_dir)
    return P.rounded(many_fits.deltas(cut(rows), "self_won", ["diff_career_win_pct", "diff_slpm", "diff_sapm"], GROUPS, [1996, 1997, 1998]))


#: Ends of the bins of the first splits.
EDGES = {"diff_career_win_pct": [-0.3, -0.1, 0.0, 0.1, 0.3], "diff_total_fights": [-6.0, -2.0, 0.0, 2.0, 6.0], "diff_days_since_last_fight": [-90.0, -20.0, 0.0, 20.0, 90.0], "diff_finish_rate": [-0.2, 0.0, 0.2]}
_BINS = " UNION ALL ".join(f"SELECT bout_id, self, y, '{c}' AS c, {i} AS i, CASE WHEN {c} IS NOT NULL THEN len([e for e in {e} if e < {c}]) END AS b FROM x" for i, (c, e) in enumerate(EDGES.items()))
_GRID = " UNION ALL ".join(f"SELECT '{c}' AS c, k, d FROM range({len(e) + 1}) t(k), (VALUES (true), (false)) u(d)" for c, e in EDGES.items())


def _split_sql(name: str, rows: str) -> str:
    """The best split of each node of `rows` (node, bout_id, self, y) as the table `name`."""
    left = "(o.b <= s.k OR (o.b IS NULL AND s.d))"
    weight = lambda g, h: f"power({g}, 2) / ({h} + 1)"
    return f"""{name}_all AS (SELECT node, sum(0.5 - y) AS g, count(*) * 0.25 AS h, count(*) AS n FROM {rows} GROUP BY 1),
    {name}_side AS (SELECT r.node, o.c, o.i, s.k, s.d, count(*) FILTER (o.b IS NULL) AS gaps, coalesce(sum(0.5 - r.y) FILTER ({left}), 0) AS gl, count(*) FILTER ({left}) * 0.25 AS hl, count(*) FILTER ({left}) AS nl FROM {rows} r JOIN long o USING (bout_id, self) JOIN grid s ON s.c = o.c GROUP BY ALL),
    {name}_gain AS (SELECT *, {weight("gl", "hl")} + {weight("g - gl", "h - hl")} - {weight("g", "h")} AS gain FROM {name}_side JOIN {name}_all USING (node) WHERE nl >= 20 AND n - nl >= 20 AND (d OR gaps > 0)),
    {name} AS (SELECT node, arg_max({{'c': c, 'k': k, 'd': d, 'gain': gain}}, (gain, -i, -k, d)) AS s FROM {name}_gain WHERE gain > 0 GROUP BY node)"""


@query(f"""WITH {P.SQL}, {P.PRIOR}, f AS (SELECT *, wins / nullif(decided, 0) AS career_win_pct, bouts AS total_fights, day - last_day AS days_since_last_fight, fin / nullif(wins, 0) AS finish_rate FROM prior),
    x AS (SELECT s.bout_id, s.self, s.won AS y, {", ".join(f"a.{c[5:]} - b.{c[5:]} AS {c}" for c in EDGES)} FROM sides s JOIN f a ON a.bout_id = s.bout_id AND a.self = s.self JOIN f b ON b.bout_id = s.bout_id AND b.self = s.opp WHERE s.status = 'completed' AND s.won IS NOT NULL),
    long AS MATERIALIZED ({_BINS}), grid AS ({_GRID}), top AS (SELECT 1 AS node, bout_id, self, y FROM x), {_split_sql("one", "top")},
    low AS (SELECT CASE WHEN (o.b <= one.s.k OR (o.b IS NULL AND one.s.d)) THEN 2 ELSE 3 END AS node, o.bout_id, o.self, o.y FROM long o, one WHERE o.c = one.s.c), {_split_sql("two", "low")}
    SELECT CAST(node AS INT) AS node, s.c AS feature, CAST(s.k AS INT) AS last_bin, s.d AS missing_left, round(s.gain, 6) AS gain FROM (FROM one UNION ALL FROM two)""")
def first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of a first tree of depth 2 over four differences with missing values."""
    rows, _ = _training(spark, sf_dir)
    model = boosting.fit(rows, list(EDGES), "self_won", [boosting.Params(trees=1, depth=2)], edges=EDGES)
    found = [(n, c, b, left, float(model.trees[0]["gain"][n])) for n, c, b, left in model.splits()[0]]
    return P.rounded(spark.createDataFrame(found, "node int, feature string, last_bin int, missing_left boolean, gain double"))


@query()
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.predictions(spark, sf_dir).cache()
    fit, held = rows.where(F.year("day") < 1996), rows.where(F.year("day") >= 1996)
    methods = {"uncalibrated": F.col("q"), "platt": E.platt(fit, "y", "q")(F.col("q")), "isotonic": E.isotonic(fit, "y", "q")(F.col("q"))}
    return P.rounded(E.compare(held, "y", methods))


@query(f"""{WITH} SELECT bout_id, fighter, collected_at, round(CASE WHEN moneyline < 0 THEN -moneyline / (-moneyline + 100.0) ELSE 100.0 / (moneyline + 100.0) END, 6) AS implied, strftime(CAST(collected_at AS DATE), '%Y-%m-%dT12:00:00Z') AS asked,
    collected_at BETWEEN CAST(CAST(collected_at AS DATE) AS TIMESTAMP) - INTERVAL 6 HOURS AND CAST(CAST(collected_at AS DATE) AS TIMESTAMP) + INTERVAL 36 HOURS AND extract(hour FROM collected_at) < 12 AS morning FROM price""")
def price_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("collected_at").cast("date")
    return P.rounded(P.prices(spark, sf_dir).select("bout_id", "fighter", "collected_at", S.implied_probability("moneyline").alias("implied"), S.snapshot_time(day).alias("asked"), (S.in_event_window("collected_at", day) & (F.hour("collected_at") < 12)).alias("morning")))
