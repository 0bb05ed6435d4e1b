"""Exact order statistics and distribution tests in which no task sees all values of a column.

quantiles: the values between a column's least and greatest are counted in CELLS equal cells; a running sum over the cells tells in which
one each wanted rank lies. That cell, between the least and greatest value found in it, is cut into cells again, and so on, until it
holds EDGE_ROWS values or equal ones; only these few are sorted. Every round is one grouped aggregation with partial sums in each task,
over all columns and all wanted ranks at once, and a round keeps at most a cell of each wanted rank.

steps: equal values are summed up first; distinct values are dealt into lanes of about the same number of rows between approximate
quantiles, and the sums of the lanes before are added to the running sums inside each lane.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Cells of a range in a round, values that are sorted, and lanes of a column.
CELLS, EDGE_ROWS, LANES = 1024, 1000, 256


def long_values(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """(feature, value) of all values that are there (neither null nor NaN), with the columns in keep."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keep, each).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _cell(value: str = "value") -> Column:
    wide = F.col("_high") - F.col("_low")
    return F.when(wide > 0, F.least(F.lit(CELLS - 1), F.floor((F.col(value) - F.col("_low")) / wide * CELLS))).otherwise(0).cast("int")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, by: str = "feature") -> DataFrame:
    """(feature, prob, quantile) of each column: the value at rank prob * (n - 1), between two values in proportion. A column without
    values has none (null). The values are read once for each round."""
    values = cut(long_values(df, columns))
    ends = values.groupBy("feature").agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    at = F.col("prob") * (F.col("_n") - 1)
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    ranks = ends.select("feature", "_n", "_low", "_high", asked).select("*", F.explode(F.array_distinct(F.array(F.floor(at).cast("long"), F.ceil(at).cast("long")))).alias("_rank"))
    # One row for each wanted rank; the ranks are columns x probs x 2.
    state = cut(ranks.select("feature", "_rank", "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_held")).distinct())
    while True:
        open_ = state.where((F.col("_held") > EDGE_ROWS) & (F.col("_low") < F.col("_high")))
        ranges = open_.select("feature", "_low", "_high", "_before").distinct()  # many ranks may share a cell
        if ranges.isEmpty():
            break
        met = values.join(F.broadcast(ranges), "feature").where(F.col("value").between(F.col("_low"), F.col("_high")))
        cells = met.groupBy("feature", "_low", "_high", "_before", _cell().alias("_cell")).agg(F.count("*").alias("_c"), F.min("value").alias("_least"), F.max("value").alias("_most"))
        own = Window.partitionBy("feature", "_low", "_high").orderBy("_cell")  # CELLS rows at most
        run = cells.withColumn("_upto", F.col("_before") + F.sum("_c").over(own))
        found = open_.alias("s").join(run.alias("r"), ["feature", "_low", "_high", "_before"]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        finer = found.select("feature", "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_held"))
        state = cut(state.where((F.col("_held") <= EDGE_ROWS) | (F.col("_low") >= F.col("_high"))).unionByName(finer).coalesce(1))  # a row for each wanted rank
    flat = state.where(F.col("_low") >= F.col("_high")).select("feature", "_rank", F.col("_low").alias("_v"))
    rest = state.where(F.col("_low") < F.col("_high"))
    some = values.join(F.broadcast(rest), "feature").where(F.col("value").between(F.col("_low"), F.col("_high"))).groupBy("feature", "_rank", "_before").agg(F.array_sort(F.collect_list("value")).alias("_some"))
    exact = cut(flat.unionByName(some.select("feature", "_rank", F.get("_some", (F.col("_rank") - F.col("_before")).cast("int")).alias("_v"))))
    point = ranks.select("feature", "prob", "_n").distinct().withColumns({"_f": F.floor(at).cast("long"), "_c": F.ceil(at).cast("long"), "_share": at - F.floor(at)})
    low, high = (exact.select("feature", F.col("_rank").alias(k), F.col("_v").alias(f"_v{k}")) for k in ("_f", "_c"))
    known = point.join(low, ["feature", "_f"]).join(high, ["feature", "_c"]).select("feature", "prob", (F.col("_v_f") + (F.col("_v_c") - F.col("_v_f")) * F.col("_share")).alias("quantile"))
    every = df.sparkSession.createDataFrame([(c, float(p)) for c in columns for p in probs], "feature string, prob double")
    return every.join(known, ["feature", "prob"], "left").withColumnRenamed("feature", by)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column; one number a column."""
    return {r["feature"]: r["quantile"] for r in quantiles(df, columns, [0.5]).collect()}


def steps(values: DataFrame, *sums: str) -> DataFrame:
    """Running sums: values (feature, value, and numbers to be summed) to a row for each distinct value of a feature, with <s>_upto, the sum
    over all values up to it, in place of the numbers."""
    once = cut(values.groupBy("feature", "value").agg(*[F.sum(s).alias(s) for s in sums]))
    ends = once.groupBy("feature").agg(F.percentile_approx("value", [i / LANES for i in range(1, LANES)], 10 * LANES).alias("_ends"))
    dealt = once.join(F.broadcast(ends), "feature").withColumn("_lane", F.size(F.filter("_ends", lambda e: e < F.col("value")))).drop("_ends")
    lanes = dealt.groupBy("feature", "_lane").agg(*[F.sum(s).alias(f"_l_{s}") for s in sums])
    before = Window.partitionBy("feature").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)  # LANES rows at most
    offsets = lanes.select("feature", "_lane", *[F.coalesce(F.sum(f"_l_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy("feature", "_lane").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(offsets, ["feature", "_lane"]).select("feature", "value", *[(F.col(f"_b_{s}") + F.sum(s).over(inside)).alias(f"{s}_upto") for s in sums])
