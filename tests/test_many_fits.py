"""Many logistic fits from the same scans against single fits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, many_fits
from tidemark.operators.many_fits import Spec


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(1200):
        a, b = rng.gauss(0, 2), rng.gauss(1, 1)
        out.append((i, 2000 + i % 4, a, b if rng.random() > 0.2 else None, rng.choice([None, 0.0, 3.0]), 1.0, None if i % 100 == 0 else int(rng.random() < 1 / (1 + np.exp(-(0.8 * a - 0.5 * b))))))
    return spark.createDataFrame(out, "i long, yr int, a double, b double, c double, flat double, y int").withColumn("day", F.make_date("yr", F.lit(2), F.lit(3))).cache()


def single(df, columns, c=1.0):
    """The same fit by itself: impute, standardise, Newton's steps over one matrix."""
    data = df.where("y is not null").select(*columns, "y").toPandas()
    x = data[list(columns)].to_numpy(dtype=float)
    gaps = np.isnan(x)
    both = np.hstack([np.where(gaps, np.nanmedian(x, axis=0), x), gaps.astype(float)])
    std = both.std(axis=0, ddof=1)
    z, y, w = np.where(std > 1e-12, (both - both.mean(axis=0)) / np.where(std > 1e-12, std, 1), 0), data["y"].to_numpy(), np.zeros(both.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(len(w)) / c, z.T @ (p - y) + w / c)
    return dict(zip([*columns, *[f"{n}_missing" for n in columns]], w))


def test_each_equals_its_single_fit(rows):
    specs = [Spec("ab", ("a", "b"), 0), Spec("all", ("a", "b", "c", "flat"), 1), Spec("c", ("c",), 0, 0.1), Spec("a", ("a",), 1)]
    member = F.when(F.col("yr") < 2002, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    fits = many_fits.fit(rows.repartition(5), "y", specs, member=member)
    for i, s in enumerate(specs):
        want = single(rows.where("yr < 2002") if s.fold == 0 else rows, s.columns, s.c)
        assert fits.coefficients(i) == pytest.approx(want, abs=1e-6), s.name


def test_the_library_pipeline_agrees(rows):
    train = rows.where("y is not null")
    filled = evaluation.impute(train, columns=["a", "b"])[0]
    model = evaluation.logistic(["a", "b", "a_missing", "b_missing"], train.count(), "y").fit(filled)
    got = many_fits.fit(train, "y", [Spec("ab", ("a", "b"))]).coefficients(0)
    assert [got[n] for n in ("a", "b", "a_missing", "b_missing")] == pytest.approx(list(model.stages[-1].coefficients), abs=2e-4)


def test_predictions_and_losses(rows, spark):
    fits = many_fits.fit(rows, "y", [Spec("ab", ("a", "b")), Spec("a", ("a",))])
    got = many_fits.predict(fits, rows, F.array(F.lit(1))).select("_ps").first()[0]
    assert got[0] is None and 0 < got[1] < 1
    losses = many_fits.fold_losses(rows, "y", {"ab": ["a", "b"], "none": ["flat"]}, [2002, 2003]).collect()
    by = {(r["name"], r["val_year"]): r["log_loss"] for r in losses}
    assert len(by) == 4 and by["none", 2002] == pytest.approx(np.log(2)) and by["ab", 2003] < 0.6
    assert {r["n"] for r in losses if r["val_year"] == 2002} == {rows.where("yr = 2002 and y is not null").count()}


def test_deltas(rows):
    table = {(r["kind"], r["name"]): (r["log_loss"], r["delta"]) for r in many_fits.deltas(rows, "y", ["a"], {"second": ["b"], "noise": ["c", "flat"]}, [2002, 2003]).collect()}
    assert set(table) == {("base", "base"), ("all", "all"), *[(k, g) for k in ("cumulative", "without", "added") for g in ("second", "noise")], ("single", "b"), ("single", "c"), ("single", "flat")}
    assert table["base", "base"][1] is None and table["added", "second"] == table["cumulative", "second"] == table["single", "b"]
    assert table["added", "second"][1] < 0 < table["without", "second"][1] and table["single", "flat"][1] == pytest.approx(0, abs=1e-9)
    assert table["cumulative", "noise"][0] == pytest.approx(table["all", "all"][0])


def test_no_rows(rows):
    fits = many_fits.fit(rows.limit(0), "y", [Spec("ab", ("a", "b"))])
    assert {round(r["_ps"][0], 12) for r in many_fits.predict(fits, rows).collect()} == {0.5}
