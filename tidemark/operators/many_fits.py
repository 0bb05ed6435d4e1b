"""Many ridge logistic regressions from the same scans.

A specification names columns and a fold; a row names the folds that it teaches. Every pass over the rows adds up, for all
specifications at once, the gradient and the curvature of their losses: in each task as matrix products over batches, then in a tree of
partial sums, so what comes together is one matrix for each specification, whatever the number of rows or tasks. Newton's steps on
these sums need some six passes for all models together, where single fits need as many each.

Missing values become the exact median of a fold's rows and add an indicator column, and columns are standardised over a fold's rows, as
evaluation.impute and evaluation.logistic do for one model. There is no intercept, so on mirrored rows the two probabilities of a bout
add up to 1. Defined cases: rows with a null label teach nothing; a column without spread in a fold has the weight 0; a fold without
rows gives weights of 0, hence probabilities of one half.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import ranks
from tidemark.session import cut

#: Partial sums of a specification that are added up together, and the most of Newton's steps.
BRANCHES, STEPS = 32, 25


@dataclass(frozen=True)
class Spec:
    """A name, the columns used, the fold learned from, and the inverse strength of the ridge penalty on the sum of losses."""

    name: str
    columns: tuple[str, ...]
    fold: int = 0
    c: float = 1.0


@dataclass
class Fits:
    """Fitted specifications: weights of the standardised columns and, behind them, of their indicators; and what a fold's rows are like."""

    columns: tuple[str, ...]
    specs: tuple[Spec, ...]
    medians: np.ndarray  # (fold, column)
    means: np.ndarray  # (fold, 2 * column)
    scales: np.ndarray  # (fold, 2 * column); 0 without spread
    weights: np.ndarray  # (spec, 2 * column)

    def coefficients(self, i: int) -> dict[str, float]:
        """The weights of a specification's columns and indicators, by name."""
        d = len(self.columns)
        names = [*self.columns, *[f"{c}_missing" for c in self.columns]]
        return {n: float(w) for j, (n, w) in enumerate(zip(names, self.weights[i])) if self.columns[j % d] in self.specs[i].columns}


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(columns)]) if columns else np.zeros((batch.num_rows, 0))


def _members(batch: pa.RecordBatch, at: int, folds: int) -> np.ndarray:
    """(row, fold): whether the row teaches the fold."""
    lists = batch.column(at)
    out = np.zeros((batch.num_rows, folds), dtype=bool)
    rows = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    out[rows, lists.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def _summed(parts: DataFrame) -> pd.DataFrame:
    """Rows (key, part, sums array<double>) added up by key: first those of a part in each of BRANCHES branches, then the branches."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "part": [0], "sums": [np.sum(np.stack(frame["sums"].to_numpy()), axis=0)]})

    schema = "key int, part int, sums array<double>"
    return parts.groupBy("key", "part").applyInPandas(add, schema).groupBy("key").applyInPandas(add, schema).toPandas()


def _pass(rows: DataFrame, width: int, keys: int, work) -> np.ndarray:
    """(key, width): the sums over all rows of what work(batch) gives as such an array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width))
        for batch in batches:
            total += work(batch)
        part = int.from_bytes(np.random.default_rng().bytes(2), "little") % BRANCHES  # any branch will do: a sum is a sum
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(keys, dtype=np.int32)), pa.array(np.full(keys, part, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["key", "part", "sums"])

    got = _summed(rows.mapInArrow(read, "key int, part int, sums array<double>"))
    out = np.zeros((keys, width))
    if len(got):
        out[got["key"]] = np.stack(got["sums"].to_numpy())
    return out


def _standard(x: np.ndarray, medians: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    gaps = np.isnan(x)
    both = np.hstack([np.where(gaps, medians, x), gaps.astype(float)])
    return np.where(scales > 0, (both - means) / np.where(scales > 0, scales, 1), 0.0)


def fit(df: DataFrame, label: str, specs: Sequence[Spec], *, member: Column | None = None) -> Fits:
    """All specifications. member: the numbers of the folds that a row teaches, an array; fold 0 alone by default."""
    columns = tuple(dict.fromkeys(c for s in specs for c in s.columns))
    d, folds = len(columns), max(s.fold for s in specs) + 1
    of = F.array(F.lit(0)) if member is None else member
    rows = cut(df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)], F.col(label).cast("double").alias("y"), of.cast("array<int>").alias("folds")))
    # A median for each column and fold, through one table of (column and fold, value).
    each = rows.select(F.explode("folds").alias("_k"), *[f"x{j}" for j in range(d)])
    apart = [F.when(F.col("_k") == k, F.col(f"x{j}")).alias(f"{k}.{j}") for k in range(folds) for j in range(d)]
    found = ranks.medians(each.select(*apart).toDF(*[f"m{k}_{j}" for k in range(folds) for j in range(d)]), [f"m{k}_{j}" for k in range(folds) for j in range(d)])
    medians = np.array([[found[f"m{k}_{j}"] or 0.0 for j in range(d)] for k in range(folds)])

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, of = _matrix(batch, d), _members(batch, d + 1, folds)
        out = np.zeros((folds, 1 + 4 * d))
        for k in range(folds):
            own = x[of[:, k]]
            gaps = np.isnan(own)
            both = np.hstack([np.where(gaps, medians[k], own) - medians[k], gaps.astype(float)])
            out[k] = np.concatenate([[len(own)], both.sum(axis=0), (both**2).sum(axis=0)])
        return out

    sums = _pass(rows, 1 + 4 * d, folds, moments)
    n = np.maximum(sums[:, :1], 1)
    means, squares = sums[:, 1 : 1 + 2 * d] / n, sums[:, 1 + 2 * d :] / n
    spread = np.maximum(squares - means**2, 0) * n / np.maximum(n - 1, 1)
    scales = np.where(spread > 1e-24, np.sqrt(spread), 0.0)
    means = means + np.hstack([medians, np.zeros_like(medians)])
    used = np.array([[c in s.columns for c in columns] * 2 for s in specs])
    weights, open_ = np.zeros((len(specs), 2 * d)), np.ones(len(specs), dtype=bool)
    for _ in range(STEPS):
        now, live = weights.copy(), np.flatnonzero(open_)

        def slopes(batch: pa.RecordBatch) -> np.ndarray:
            x, y, of = _matrix(batch, d), batch.column(d).to_numpy(zero_copy_only=False), _members(batch, d + 1, folds)
            out = np.zeros((len(specs), 2 * d + 4 * d * d))
            ready = {}
            for i in live.tolist():
                k = specs[i].fold
                if k not in ready:
                    ready[k] = _standard(x[of[:, k]], medians[k], means[k], scales[k]), y[of[:, k]]
                z, own = ready[k]
                p = 1 / (1 + np.exp(-(z @ now[i])))
                out[i] = np.concatenate([z.T @ (p - own), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            return out

        sums = _pass(rows, 2 * d + 4 * d * d, len(specs), slopes)
        for i in live.tolist():
            on = np.flatnonzero(used[i] & (scales[specs[i].fold] > 0))
            slope = sums[i, : 2 * d][on] + now[i][on] / specs[i].c
            bend = sums[i, 2 * d :].reshape(2 * d, 2 * d)[np.ix_(on, on)] + np.eye(len(on)) / specs[i].c
            step = np.linalg.solve(bend, slope) if len(on) else np.zeros(0)
            longest = np.abs(step).max(initial=0.0)
            weights[i][on] = now[i][on] - step * min(1.0, 5.0 / max(longest, 1e-12))
            open_[i] = longest > 1e-9
        if not open_.any():
            break
    return Fits(columns, tuple(specs), medians, means, scales, weights)


def predict(fits: Fits, df: DataFrame, which: Column | None = None) -> DataFrame:
    """df with _ps: the probability by each specification whose number is in the array `which` (all by default), else null."""
    every = range(len(fits.specs))
    chosen = F.array(*map(F.lit, every)) if which is None else which

    def p(i: int) -> Column:
        k, d = fits.specs[i].fold, len(fits.columns)
        total = F.lit(0.0)
        for j, c in enumerate(fits.columns):
            v = F.col(c).cast("double")
            gap = v.isNull() | F.isnan(v)
            for at, value in ((j, F.when(gap, float(fits.medians[k][j])).otherwise(v)), (d + j, gap.cast("double"))):
                if fits.weights[i][at] and fits.scales[k][at]:
                    total = total + (value - float(fits.means[k][at])) * float(fits.weights[i][at] / fits.scales[k][at])
        return F.when(F.array_contains(chosen, i), S.sigmoid(total))

    return df.withColumn("_ps", F.array(*[p(i) for i in every]))


def fold_losses(df: DataFrame, label: str, subsets: Mapping[str, Sequence[str]], years: Sequence[int], *, day: str = "day", c: float = 1.0) -> DataFrame:
    """(name, val_year, n, log_loss) of each named subset of columns in each of the years, by models of the years before; all of them
    from the same scans."""
    y = F.year(F.col(day))
    specs = [Spec(name, tuple(columns), k, c) for name, columns in subsets.items() for k in range(len(years))]
    member = F.filter(F.array(*[F.when(y < year, F.lit(k)) for k, year in enumerate(years)]), lambda x: x.isNotNull())
    fits = fit(df.where(y < max(years)), label, specs, member=member)
    held = df.where(y.isin(list(years)) & F.col(label).isNotNull()).withColumn("_k", F.array_position(F.array(*map(F.lit, years)), y) - 1)
    which = F.filter(F.array(*[F.when(F.col("_k") == s.fold, F.lit(i)) for i, s in enumerate(specs)]), lambda x: x.isNotNull())
    rows = predict(fits, held, which).select(y.alias("val_year"), F.col(label).alias("_y"), F.posexplode("_ps").alias("_i", "_p")).where("_p is not null")
    names = F.array(*[F.lit(s.name) for s in specs])
    return rows.groupBy(F.get(names, F.col("_i")).alias("name"), "val_year").agg(F.count("*").alias("n"), F.avg(S.log_loss("_y", "_p")).alias("log_loss"))


def deltas(df: DataFrame, label: str, base: Sequence[str], groups: Mapping[str, Sequence[str]], years: Sequence[int], *, day: str = "day", c: float = 1.0) -> DataFrame:
    """(kind, name, log_loss, delta): mean fold losses and their differences. Kinds: `base` and `all` columns; `cumulative`, the base with
    the groups up to this one, against the step before; `without`, all columns but the group's, against all; `added`, the base and the
    group, and `single`, the base and one column of a group, against the base."""
    base, every = list(base), list(dict.fromkeys([*base, *[x for g in groups.values() for x in g]]))
    subsets, against = {("base", "base"): base, ("all", "all"): every}, {}
    before = base
    for g, own in groups.items():
        subsets["cumulative", g], against["cumulative", g] = list(dict.fromkeys([*before, *own])), ("cumulative", list(groups)[list(groups).index(g) - 1]) if before is not base else ("base", "base")
        before = subsets["cumulative", g]
        subsets["without", g], against["without", g] = [x for x in every if x not in own], ("all", "all")
        subsets["added", g], against["added", g] = list(dict.fromkeys([*base, *own])), ("base", "base")
        for x in own:
            subsets["single", x], against["single", x] = list(dict.fromkeys([*base, x])), ("base", "base")
    losses = fold_losses(df, label, {f"{k}\t{n}": v for (k, n), v in subsets.items()}, years, day=day, c=c)
    mean = {tuple(r["name"].split("\t")): r["l"] for r in losses.groupBy("name").agg(F.avg("log_loss").alias("l")).collect()}
    table = [(k, n, mean.get((k, n)), mean[k, n] - mean[against[k, n]] if (k, n) in against and (k, n) in mean else None) for k, n in subsets]
    return df.sparkSession.createDataFrame(table, "kind string, name string, log_loss double, delta double")
