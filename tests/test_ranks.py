"""Order statistics in rounds against sorted lists."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, ranks


def plain(values, p):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return None
    at = p * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


@pytest.mark.parametrize("cells, edge", [(1024, 1000), (16, 3)])
def test_quantiles(spark, monkeypatch, cells, edge):
    monkeypatch.setattr(ranks, "CELLS", cells)
    monkeypatch.setattr(ranks, "EDGE_ROWS", edge)
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1) ** 5, float(rng.randrange(3)), None, rng.choice([None, float("nan"), 1e18 * rng.random()]), 5.0) for _ in range(400)] + [(1e9, 2.0, None, -1e18, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["feature"], r["prob"]): r["quantile"] for r in ranks.quantiles(df, list("abcde"), probs).collect()}
    assert len(got) == 25
    for i, c in enumerate("abcde"):
        for p in probs:
            want = plain([r[i] for r in rows], p)
            assert got[c, p] == (want if want is None else pytest.approx(want, rel=1e-12)), (c, p)
    assert ranks.medians(df.limit(0), ["a"]) == {"a": None}


def test_no_task_sorts_a_column(spark, monkeypatch):
    """What is collected for a rank is no more than EDGE_ROWS values, however many there are."""
    monkeypatch.setattr(ranks, "EDGE_ROWS", 50)
    df = spark.range(20_000).select((F.col("id") * 0.5).alias("a"), F.lit(1.0).alias("b"))
    got = {r["feature"]: r["quantile"] for r in ranks.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": 4999.75, "b": 1.0}


@pytest.mark.parametrize("lanes", [256, 3])
def test_steps(spark, monkeypatch, lanes):
    monkeypatch.setattr(ranks, "LANES", lanes)
    rng = random.Random(1)
    rows = [(rng.choice("xy"), float(rng.randrange(60)), rng.randrange(3)) for _ in range(500)]
    got = {(r["feature"], r["value"]): r["n_upto"] for r in ranks.steps(spark.createDataFrame(rows, "feature string, value double, n long"), "n").collect()}
    assert got == {(f, v): sum(n for g, w, n in rows if g == f and w <= v) for f, v, _ in rows}


def test_labels_are_dealt_over_all_rows(spark):
    rows = spark.range(4000).select("id", (F.col("id") < 2000).cast("int").alias("y"))
    got = evaluation.shuffled_labels(rows, "y", by="id").collect()
    assert Counter(r["y"] for r in got) == {0: 2000, 1: 2000} and len({r["id"] for r in got}) == 4000
    low = sum(r["y"] for r in got if r["id"] < 2000)
    assert 850 < low < 1150
    assert evaluation.shuffled_labels(rows, "y", by="id").exceptAll(spark.createDataFrame([(r["id"], r["y"]) for r in got], "id long, y int")).isEmpty()
    other = evaluation.shuffled_labels(rows, "y", by="id", seed=5).collect()
    assert {(r["id"], r["y"]) for r in other} != {(r["id"], r["y"]) for r in got}
