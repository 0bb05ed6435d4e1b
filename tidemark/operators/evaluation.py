"""Models and their evaluation: folds, baselines, calibration, blends, audits.

Fits go through MLlib, so rows stay distributed; loops run over folds, configurations or features, never over rows.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import boosting, matrix, metrics, ranks
from tidemark.operators import search as sequential
from tidemark.session import cut

# Models -------------------------------------------------------------------------------------------------------------------------


def impute(train: DataFrame, *others: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Missing values become the exact median of the training rows, and <c>_missing says where."""
    medians = ranks.medians(train, columns)
    fill = lambda df: df.withColumns({**{f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}, **{c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in columns}})
    return [fill(df) for df in (train, *others)]


def logistic(columns: Sequence[str], rows: int, label: str = "self_won", c: float = 1.0) -> Pipeline:
    """Standardised columns, no intercept: on mirrored rows the two probabilities of a bout then add up to 1. c is the inverse strength
    of the ridge penalty on the sum of losses."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, fitIntercept=False, standardization=False, regParam=1 / (c * max(rows, 1)), elasticNetParam=0.0, maxIter=100),
    ])


def boosted(columns: Sequence[str], label: str = "self_won", **params) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), GBTClassifier(labelCol=label, seed=42, **{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **params})])


def predict(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "_raw", "rawPrediction", "probability", "prediction")


def top_features(model: PipelineModel, columns: Sequence[str], n: int = 10) -> list[tuple[str, float]]:
    """The n columns with the largest absolute coefficient or importance."""
    last = model.stages[-1]
    weights = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(zip(columns, map(float, weights)), key=lambda x: (-abs(x[1]), x[0]))[:n]


def out_of_fold(df: DataFrame, columns: Sequence[str], build, *, warm_up: int, label: str = "self_won", day: str = "day", name: str = "p") -> DataFrame:
    """Predictions for every year after the warm-up from models of the years before. build(columns, rows) gives an unfitted pipeline."""
    out = None
    for year in matrix.fold_years(df, warm_up, day=day):
        train, val = matrix.fold(df, year, day=day)
        train, val = impute(train, val, columns=columns)
        every = [*columns, *[f"{c}_missing" for c in columns]]
        rows = train.where(F.col(label).isNotNull())
        one = predict(build(every, rows.count()).fit(rows), val, name).withColumn("val_year", F.lit(year))
        out = one if out is None else out.unionByName(one)
    return out.drop(*[f"{c}_missing" for c in columns])


#: What the search over boosted trees draws from.
BOOSTED_SPACE = {"trees": sequential.Real(5, 60, whole=True), "depth": sequential.Real(1, 5, whole=True), "rate": sequential.Real(0.02, 0.3, log=True), "ridge": sequential.Real(0.01, 20.0, log=True), "least": sequential.Real(5, 80, log=True, whole=True)}


def search_boosted(df: DataFrame, columns: Sequence[str], label: str, years: Sequence[int], path: str, run: str, *, space=BOOSTED_SPACE, day: str = "day", **options) -> tuple[dict, float]:
    """The parameters of boosted trees with the least mean log loss over the years, each judged by models of the years before. The models of
    a round's trials and folds grow together; losses are kept at `path`, from where a stopped search goes on. options: of search.search."""
    y = F.year(F.col(day))
    edges = boosting.edges_of(df.where(y < max(years)), columns)

    def judge(params: list[dict], some: list[int]) -> list[list[float]]:
        of = [(t, year) for t in range(len(params)) for year in some]
        member = F.filter(F.array(*[F.when(y < year, F.lit(i)) for i, (_, year) in enumerate(of)]), lambda x: x.isNotNull())
        model = boosting.fit(df.where(y < max(some)), columns, label, [boosting.Params(**params[t]) for t, _ in of], member=member, edges=edges)
        which = F.filter(F.array(*[F.when(y == year, F.lit(i)) for i, (_, year) in enumerate(of)]), lambda x: x.isNotNull())
        held = df.where(y.isin(list(some)) & F.col(label).isNotNull()).withColumn("_which", F.explode(which))
        losses = {r["_which"]: r["l"] for r in boosting.predict(model, held, "_p", which=F.col("_which")).groupBy("_which").agg(metrics.log_loss(label, "_p").alias("l")).collect()}
        return [[losses.get(of.index((t, year)), math.log(2)) for year in some] for t in range(len(params))]

    return sequential.search(df.sparkSession, path, run, space, list(years), judge, **options)


# Calibration --------------------------------------------------------------------------------------------------------------------


def newton(df: DataFrame, y: str, xs: Sequence[Column], *, intercept: bool = True, ridge: float = 0.0, steps: int = 50) -> list[float]:
    """The weights of a logistic regression of few columns (the intercept last, without penalty), by Newton's steps on sums: each step is
    one aggregation. ridge: the penalty on the mean loss, half the weights' squares times it."""
    values = [*xs, *([F.lit(1.0)] if intercept else [])]
    rows = cut(df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(values)]))
    d, w = len(values), np.zeros(len(values))
    penalty = np.array([ridge] * len(xs) + [0.0] * (d - len(xs)))
    for _ in range(steps):
        p = S.sigmoid(sum((F.col(f"_x{i}") * float(w[i]) for i in range(d)), F.lit(0.0)))
        bend = [F.avg(p * (1 - p) * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(d) for j in range(i + 1)]
        got = [x or 0.0 for x in rows.agg(*[F.avg((p - F.col("_y")) * F.col(f"_x{i}")) for i in range(d)], *bend).first()]
        curve, at = np.zeros((d, d)), d
        for i in range(d):
            for j in range(i + 1):
                curve[i, j] = curve[j, i] = got[at]
                at += 1
        step = np.linalg.lstsq(curve + np.diag(penalty), np.array(got[:d]) + penalty * w, rcond=None)[0]
        w = w - step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return [float(x) for x in w]


def platt_weights(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    """Slope and intercept of a logistic map of the logit."""
    a, b = newton(df, y, [S.logit(p)])
    return a, b


def platt(df: DataFrame, y: str, p: str):
    """A column function: a logistic map of the logit, symmetrised."""
    a, b = platt_weights(df, y, p)
    return lambda q: S.symmetric(lambda c: S.sigmoid(S.logit(c) * a + b), q)


def isotonic(df: DataFrame, y: str, p: str):
    """A column function: the increasing step-free map through MLlib's knots, clipped outside, symmetrised."""
    model = IsotonicRegression(labelCol="_y", featuresCol="_x").fit(df.select(F.col(p).alias("_x"), F.col(y).cast("double").alias("_y")))
    xs, ys = list(map(float, model.boundaries)), list(map(float, model.predictions))
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(v).alias("y")) for x, v in zip(xs, ys)])

    def at(c: Column) -> Column:
        low = F.element_at(F.filter(knots, lambda k: k["x"] <= c), -1)
        high = F.get(F.filter(knots, lambda k: k["x"] >= c), F.lit(0))
        between = F.when(high["x"] == low["x"], low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (c - low["x"]) / (high["x"] - low["x"]))
        return F.when(c <= xs[0], ys[0]).when(c >= xs[-1], ys[-1]).otherwise(between)

    return lambda q: S.symmetric(at, q)


def compare(df: DataFrame, y: str, methods: dict[str, Column], bout: str = "bout_id") -> DataFrame:
    """Per method: n, accuracy, log_loss, brier, ece, max_deviation of pairs, and the differences from the first method."""
    rows = df.select(bout, F.col(y).alias("_y"), F.inline(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("_p")) for m, c in methods.items()])))
    scores = metrics.evaluate(rows, "_y", "_p", by=("method",))
    pairs = rows.groupBy("method", bout).agg(F.sum("_p").alias("_s"), F.count("*").alias("_n")).where("_n = 2").groupBy("method").agg(F.max(F.abs(F.col("_s") - 1)).alias("max_pair_dev"))
    out = scores.join(pairs, "method", "left")
    first = out.where(F.col("method") == next(iter(methods))).select(F.col("log_loss").alias("_l0"), F.col("ece").alias("_e0"))
    return out.crossJoin(F.broadcast(first)).withColumns({"d_log_loss": F.col("log_loss") - F.col("_l0"), "d_ece": F.col("ece") - F.col("_e0")}).drop("_l0", "_e0")


def _least(frame: DataFrame, gates: dict[str, str], careful: str, margin: float) -> str | None:
    """The method of the frame with the least loss among those that pass every gate; a method for which `careful` holds must win by the
    margin."""
    passed = frame.where(" AND ".join(f"({g})" for g in gates.values()))
    first = passed.orderBy(F.col("log_loss") + F.when(F.expr(careful), margin).otherwise(0.0), F.expr(careful), "method").select("method").first()
    return first[0] if first else None


def choose_calibrator(comparison: DataFrame, *, deviation: float = 1.5, ece: float = 0.005, loss: float = 0.001, margin: float = 0.001) -> str | None:
    """The calibrator that passes all gates against the uncalibrated row, or None; the more flexible one must win by the margin."""
    raw = comparison.where("method = 'uncalibrated'").select(F.col("max_pair_dev").alias("raw_dev"))
    gates = {
        "a calibrator": "method <> 'uncalibrated'",
        "symmetry": f"max_pair_dev <= {deviation} * raw_dev",
        "better calibration": f"d_ece <= {-ece}",
        "no worse loss": f"d_log_loss <= {loss}",
    }
    return _least(comparison.crossJoin(F.broadcast(raw)), gates, "method = 'isotonic'", margin)


def choose_blend(comparison: DataFrame, *, deviation: float = 1.5, ece: float = 0.005, gain: float = 0.002, margin: float = 0.001) -> str | None:
    """The blend (rows with n_components) that passes all gates against the best single model, or None; a stacker must win by the margin."""
    single = comparison.where("n_components = 1").agg(*[F.min_by(c, "log_loss").alias(f"one_{c}") for c in ("max_pair_dev", "ece", "log_loss")])
    gates = {
        "a blend": "n_components > 1",
        "symmetry": f"max_pair_dev <= {deviation} * one_max_pair_dev",
        "calibration": f"ece <= one_ece + {ece}",
        "gain": f"log_loss <= one_log_loss - {gain}",
    }
    return _least(comparison.crossJoin(F.broadcast(single)), gates, "method LIKE 'stacker%'", margin)


# Ensembles ----------------------------------------------------------------------------------------------------------------------


def align(*frames: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Predictions of several models side by side; fails when it is read if labels disagree or a key repeats."""
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        out = out.join(f.withColumnRenamed(label, f"_y{i}"), list(keys))
        out = out.where(F.assert_true(F.col(label).eqNullSafe(F.col(f"_y{i}")), F.lit("labels disagree")).isNull()).drop(f"_y{i}")
    own = F.count("*").over(Window.partitionBy(*keys))
    return out.withColumn("_n", own).where(F.assert_true(F.col("_n") == 1, F.lit("a key repeats")).isNull()).drop("_n")


def simplex(n: int, step: float) -> Iterator[tuple[float, ...]]:
    """Weight vectors by breaking a stick: each weight but the last takes a share of the grid from what the ones before have left."""
    shares = [i * step for i in range(round(1 / step) + 1)]
    for broken in itertools.product(shares, repeat=n - 1):
        left = list(itertools.accumulate((1 - x for x in broken), operator.mul, initial=1.0))
        yield (*map(operator.mul, left, broken), left[-1])


def stacker(df: DataFrame, y: str, ps: Sequence[str], *, intercept: bool = True):
    """A column function of the models' probabilities: logistic regression on their logits, hardly penalised."""
    weights = newton(df, y, [S.logit(p) for p in ps], intercept=intercept, ridge=1e-6)
    start = weights[len(ps)] if intercept else 0.0
    return lambda *qs: S.sigmoid(sum((S.logit(q) * w for q, w in zip(qs, weights)), F.lit(start)))


def blend_comparison(fit: DataFrame, held: DataFrame, y: str, ps: Sequence[str], *, step: float = 0.05, bout: str = "bout_id") -> DataFrame:
    """The table that choose_blend reads: on the held rows each model alone, their mean, the best blends of the fitted rows in both
    spaces, and the stackers; n_components says how many models take part."""
    methods, n = {p: F.col(p) for p in ps}, dict.fromkeys(ps, 1)
    methods["mean"] = sum((F.col(p) for p in ps), F.lit(0.0)) / len(ps)
    for space in ("logit", "probability"):
        weights = best_weights(blend_losses(fit, y, ps, step, space)).first()["weights"]
        mixed = sum(((S.logit(p) if space == "logit" else F.col(p)) * w for p, w in zip(ps, weights)), F.lit(0.0))
        methods[f"blend_{space}"], n[f"blend_{space}"] = (S.sigmoid(mixed) if space == "logit" else mixed), max(2, sum(w > 0 for w in weights))
    for intercept in (True, False):
        methods["stacker" + ("" if intercept else "_plain")] = stacker(fit, y, ps, intercept=intercept)(*ps)
    count = F.create_map(*[F.lit(x) for m in methods for x in (m, n.get(m, len(ps)))])
    return compare(held, y, methods, bout).withColumn("n_components", F.element_at(count, F.col("method")))


#: Rows that blend_losses mixes at once: what a weight vector needs of them stays in the processor's cache.
BLOCK = 4096


def blend_losses(df: DataFrame, y: str, ps: Sequence[str], step: float = 0.05, space: str = "logit") -> DataFrame:
    """Mean log loss of every weight vector: i, weights, log_loss. The grid is a bounded table. Each task mixes its rows in blocks by every
    vector and gives the sums alone, so rows are never expanded by the grid."""
    weights = list(simplex(len(ps), step))
    x = [S.logit(p) if space == "logit" else F.col(p).cast("double") for p in ps]
    rows = df.select(F.coalesce(F.col(y) == 1, F.lit(False)).alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])

    def losses(won: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
        """The sum of the losses by vector; missing probabilities count as S.clip counts them."""
        out = np.empty(len(weights))
        sign, low = np.where(won, -1.0, 1.0), np.where(won, 1e-15, 1.0 - (1.0 - 1e-15))
        for i, w in enumerate(weights):
            mixed = sum(map(operator.mul, xs[1:], w[1:]), xs[0] * w[0])
            if space == "logit":  # logits are clipped before they are mixed, so the loss is finite
                out[i] = np.log(1.0 + np.exp(mixed * sign)).sum()
            else:
                mixed = np.fmin(mixed, 1.0 - 1e-15)
                out[i] = -np.log(np.maximum(np.where(won, mixed, 1.0 - mixed), low)).sum()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(weights))
        for batch in batches:
            won, *xs = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            n += len(won)
            for at in range(0, len(won), BLOCK):
                total += losses(won[at : at + BLOCK], [v[at : at + BLOCK] for v in xs])
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(weights), dtype=np.int32), "s": total, "n": np.full(len(weights), n)})

    sums = rows.mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("log_loss"))
    grid = df.sparkSession.createDataFrame([(i, list(w)) for i, w in enumerate(weights)], "i int, weights array<double>")
    return sums.join(F.broadcast(grid), "i").select("i", "weights", "log_loss")


def best_weights(losses: DataFrame) -> DataFrame:
    """The weight vector with the least loss; the earlier one of equals."""
    return losses.agg(F.min_by("weights", F.struct("log_loss", "i")).alias("weights"), F.min("log_loss").alias("log_loss"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def residual_correlations(df: DataFrame, y: str, ps: Sequence[str]) -> DataFrame:
    return correlations(df.select(*[(F.col(y) - F.col(p)).alias(p) for p in ps]), ps)


def disagreement(df: DataFrame, y: str, ps: Sequence[str]) -> DataFrame:
    """One row: the share of rows on which not all models pick the same side, the loss of an oracle that always takes the best model, and
    how often each is the best (share_<p>; the first of equals)."""
    picks = F.size(F.array_distinct(F.array(*[(F.col(p) > 0.5) for p in ps])))
    losses = F.array(*[S.log_loss(y, p) for p in ps])
    best = F.array_position(losses, F.array_min(losses))
    return df.agg(F.avg((picks > 1).cast("double")).alias("disagreement"), F.avg(F.array_min(losses)).alias("oracle_loss"), *[F.avg((best == i + 1).cast("double")).alias(f"share_{p}") for i, p in enumerate(ps)])


# Audits -------------------------------------------------------------------------------------------------------------------------


def corner_rates(bouts: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """How often red wins among decided bouts."""
    return bouts.where("winner is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("winner") == F.col("red")).cast("double")).alias("red_rate"))


def corner_baseline(train: DataFrame, held: DataFrame, label: str, *, corner: str = "corner", by: Sequence[str] = ()) -> DataFrame:
    """How good it is to know the corner alone: each corner's share of wins in train, as the probability of its rows in held."""
    rates = train.groupBy(corner).agg(F.avg(label).alias("_rate"))
    return metrics.evaluate(held.join(F.broadcast(rates), corner), label, "_rate", by=by)  # a row per corner


def top_configs(scores: DataFrame, metric: str, params: Sequence[str], n: int = 10) -> DataFrame:
    """The n configurations with the smallest metric; for each parameter, whether the value is at an edge of those tried: then the grid
    may not hold the best one."""
    ends = scores.agg(*[f(p).alias(f"{p}_{f.__name__}") for p in params for f in (F.min, F.max)]).first()
    edge = {f"{p}_on_edge": F.col(p).isin(ends[f"{p}_min"], ends[f"{p}_max"]) for p in params}
    return scores.withColumns(edge).orderBy(metric, *params).limit(n)


def shuffled_labels(df: DataFrame, label: str, *, seed: int = 42, by: str | None = None) -> DataFrame:
    """df with its labels dealt anew over all rows: rows are numbered in the order of one hash of the key and labels in the order of
    another, and equal numbers meet. The key (`by`, or all columns) should differ between rows. Numbers are running ones inside hash
    buckets, so no task sees all rows."""
    key = F.col(by) if by else F.xxhash64(*[F.col(c) for c in df.columns])
    kept = df.select(F.struct(*df.columns).alias("_row"), key.alias("_k"))
    rows = numbered(kept, seed, by=("_k",))
    labels = numbered(df.select(key.alias("_k"), F.col(label).alias("_label")), seed + 1, by=("_k",)).select("_i", "_label")
    joined = rows.join(labels, "_i")
    return joined.select(*[F.col("_label").alias(c) if c == label else F.col(f"_row.{c}").alias(c) for c in df.columns])


def shuffle_test(train: DataFrame, held: DataFrame, columns: Sequence[str], label: str, *, seed: int = 42, by: str | None = None) -> DataFrame:
    """A model fitted on labels dealt anew, judged on the held rows' real labels: what it can still tell has leaked."""
    rows, held = impute(shuffled_labels(train, label, seed=seed, by=by), held, columns=columns)
    every = [*columns, *[f"{c}_missing" for c in columns]]
    return metrics.evaluate(predict(logistic(every, rows.count(), label).fit(rows), held), label, "p")


def ks_drift(df: DataFrame, columns: Sequence[str], side: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per column between rows with side true (n_a) and false (n_b): d, p_value, mean and standard
    deviation of both. The distribution functions are running sums over lanes of values (ranks.steps), so no task sees a column."""
    long = ranks.long_values(df, columns, side.alias("_a")).where("_a is not null")
    one = lambda s: F.when(F.col("_a") == s, F.col("value"))
    stats = long.groupBy("feature").agg(*[f(one(s)).alias(f"{n}_{k}") for s, k in ((True, "a"), (False, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.stddev_pop, "std"))])
    steps = ranks.steps(long.select("feature", "value", F.col("_a").cast("long").alias("a"), (~F.col("_a")).cast("long").alias("b")), "a", "b").join(F.broadcast(stats), "feature")
    d = steps.groupBy("feature").agg(F.max(F.abs(F.col("a_upto") / F.col("n_a") - F.col("b_upto") / F.col("n_b"))).alias("d"))
    out = d.join(stats, "feature")
    m = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    x = (m + 0.12 + 0.11 / m) * F.col("d")
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))
    return out.withColumn("p_value", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))))


def numbered(df: DataFrame, seed: int = 0, rows: int = 100_000, by: Sequence[str] | None = None) -> DataFrame:
    """df with _i, from 0 without gaps: a running number inside hash buckets (of the columns `by`, all by default) of some `rows` rows,
    behind the buckets before."""
    total, by = df.count(), tuple(by or df.columns)
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in by])
    dealt = df.withColumn("_b", F.pmod(key, F.lit(max(8, -(-total // rows)))))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_many"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 7), *[F.col(c) for c in by]), *by))
    return dealt.join(F.broadcast(offsets), "_b").withColumn("_i", F.col("_before") + own - 1).drop("_b", "_before")


def permutation_null(df: DataFrame, y: str, p: str, n: int, *, draws: int = 2000, seed: int = 42, n_bins: int = 10) -> DataFrame:
    """Calibration errors of `draws` random subsets of n different rows: draw, ece. A draw takes random row numbers one by one and skips
    those that it has, so only draws times some n numbers meet the rows, not draws times all rows."""
    rows = numbered(df.select(F.col(y).alias("_y"), F.col(p).alias("_p")), seed)
    total = df.count()
    tries = int(n * 1.5) + 50 if total >= 4 * n else 40 * max(total, 1)
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try"))
    picks = picks.withColumn("_i", F.pmod(F.xxhash64("draw", "_try", F.lit(seed)), F.lit(max(total, 1)))).groupBy("draw", "_i").agg(F.min("_try").alias("_try"))
    taken = picks.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy("_try"))).where(F.col("_r") <= n)
    return metrics.evaluate(taken.join(rows, "_i"), "_y", "_p", by=("draw",), n_bins=n_bins).select("draw", "ece")


def against_null(null: DataFrame, ece: float) -> DataFrame:
    """One row: 95th percentile of the null and the share of draws at least as bad."""
    p95 = ranks.quantiles(null, ["ece"], [0.95]).select(F.col("quantile").alias("p95"))
    return p95.join(null.agg(F.avg((F.col("ece") >= ece).cast("double")).alias("p_value")))


def fold_trend(df: DataFrame, y: str, p: str, year: Column | str = "val_year") -> DataFrame:
    """Correlation of the year with its mean log loss."""
    per = df.groupBy(S.col(year).cast("double").alias("_y")).agg(metrics.log_loss(y, p).alias("_l"))
    return per.agg(F.corr("_y", "_l").alias("trend"), F.count("*").alias("folds"))


def gate(buckets: DataFrame, names: Sequence[str], baseline: float, *, least: int = 150, multiple: float = 1.5) -> bool:
    """Whether one of the named buckets that is large enough is badly calibrated (one row per bucket)."""
    rows = buckets.where(F.col("bucket").isin(*names) & (F.col("n") >= least)).collect()
    return any(r["ece"] >= multiple * baseline and not math.isnan(r["ece"]) for r in rows)
