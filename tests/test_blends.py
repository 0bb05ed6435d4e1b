"""Losses of many weight vectors over the same rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation


@pytest.mark.parametrize("space", ["logit", "probability"])
def test_losses_of_weight_vectors(spark, monkeypatch, space):
    """Against one row and vector at a time by the column functions, over several blocks and with missing and certain probabilities."""
    monkeypatch.setattr(evaluation, "BLOCK", 7)
    some = [(i % 3 % 2, (i * 37 % 101) / 100, (i * 17 % 97) / 96) for i in range(60)] + [(1, 0.0, 0.0), (0, 1.0, 1.0), (1, None, 0.3), (0, 0.2, None)]
    rows = spark.createDataFrame(some, "y int, a double, b double").repartition(3)
    weights = list(evaluation.simplex(2, 0.25))
    x = [S.logit(c) if space == "logit" else F.col(c) for c in ("a", "b")]
    mixed = [sum((c * w for c, w in zip(x, ws)), F.lit(0.0)) for ws in weights]
    want = rows.agg(*[F.avg(S.log_loss("y", S.sigmoid(m) if space == "logit" else m)) for m in mixed]).first()
    got = {r["i"]: r for r in evaluation.blend_losses(rows, "y", ["a", "b"], 0.25, space).collect()}
    assert len(got) == len(weights) == 5
    for i, w in enumerate(weights):
        assert got[i]["weights"] == pytest.approx(w) and math.isclose(got[i]["log_loss"], want[i], rel_tol=1e-9)


def test_rows_are_not_expanded_by_the_grid(spark):
    rows = spark.range(0).select(F.lit(1).alias("y"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b"))
    losses = evaluation.blend_losses(rows, "y", ["a", "b"])
    plan = losses._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan
    assert losses.count() == 0
