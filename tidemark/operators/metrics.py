"""Scores of probabilities: all metrics of a set of predictions come from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def accuracy(y: str, p: str) -> Column:
    """p = 0.5 predicts 0."""
    return F.avg(((F.col(p) > 0.5) == (F.col(y) == 1)).cast("double"))


def log_loss(y: str, p: str) -> Column:
    return F.avg(S.log_loss(y, p))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def bins(df: DataFrame, y: str, p: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Per group and filled bin: bin, n, mean_pred, mean_true."""
    return df.groupBy(*by, S.edges_below(p, n).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("mean_true"))


def evaluate(df: DataFrame, y: str = "y", p: str = "p", *, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Per group: n, accuracy, log_loss, brier, ece. The bins carry the sums of the other metrics, so rows are read once."""
    per_bin = df.groupBy(*by, S.edges_below(p, n_bins).alias("_bin")).agg(F.count("*").alias("_n"), F.sum(F.col(p)).alias("_p"), F.sum(F.col(y).cast("double")).alias("_y"), F.sum(((F.col(p) > 0.5) == (F.col(y) == 1)).cast("double")).alias("_hit"), F.sum(S.log_loss(y, p)).alias("_ll"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_br"))
    n = F.sum("_n")
    return per_bin.groupBy(*by).agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum("_hit") / n).alias("accuracy"), (F.sum("_ll") / n).alias("log_loss"), (F.sum("_br") / n).alias("brier"), (F.sum(F.abs(F.col("_p") - F.col("_y"))) / n).alias("ece"))


def reliability(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """One row per bin, empty ones too: bin, lower, upper, n, mean_pred, mean_true."""
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / n_bins).alias("lower"), ((F.col("id") + 1) / n_bins).alias("upper"))
    return every.join(bins(df, y, p, n_bins), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece_by_bins(df: DataFrame, y: str = "y", p: str = "p", counts: Sequence[int] = (5, 10, 15, 20)) -> DataFrame:
    """Calibration error for several numbers of bins."""
    index = [F.struct(F.lit(n).alias("n_bins"), S.edges_below(p, n).alias("bin")) for n in counts]
    rows = df.select(F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.inline(F.array(*index)))
    per = rows.groupBy("n_bins", "bin").agg(F.count("*").alias("n"), F.sum("_p").alias("_p"), F.sum("_y").alias("_y"))
    return per.groupBy("n_bins").agg((F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("n")).alias("ece"))


def bucket(c: str, edges: Sequence[float], missing: str = "none before") -> Column:
    """Right-closed buckets (a, b] by name; null is a bucket of its own."""
    out = F.lit(f">{edges[-1]:g}")
    low = [None, *edges[:-1]]
    for a, b in reversed(list(zip(low, edges))):
        out = F.when(F.col(c) <= b, f"<={b:g}" if a is None else f"({a:g}, {b:g}]").otherwise(out)
    return F.when(F.col(c).isNull(), missing).otherwise(out)


def evaluate_buckets(df: DataFrame, c: str, edges: Sequence[float], y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    return evaluate(df.withColumn("bucket", bucket(c, edges)), y, p, by=("bucket",), n_bins=n_bins)


def pair_deviation(df: DataFrame, p: str = "p", bout: str = "bout_id") -> DataFrame:
    """How far the two probabilities of a bout are from adding up to 1, at most and on average."""
    pairs = df.groupBy(bout).agg(F.sum(p).alias("_s"), F.count("*").alias("_n")).where("_n = 2")
    return pairs.agg(F.max(F.abs(F.col("_s") - 1)).alias("max_deviation"), F.avg(F.abs(F.col("_s") - 1)).alias("mean_deviation"), F.count("*").alias("pairs"))
