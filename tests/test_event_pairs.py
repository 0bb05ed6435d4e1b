"""Announced events beside held ones, on days with many of both."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.operators import quality

KIND = "event_id long, name string, day date, source_url string, page_id long"


def test_pairs_of_names_are_scored_once_and_groups_expanded_whole(spark, monkeypatch):
    """Names meet on many days, but each distinct pair is scored once; groups of several packs lose no pair and repeat none."""
    names = {True: ("Night: Abe vs. Bo 2", "Gala", "Open 70"), False: ("Night: Abe vs. Bo", "Open 7")}
    rows = [(i, names[i % 3 == 0][i % len(names[i % 3 == 0])], datetime.date(2024, 5, 1) + datetime.timedelta(days=i // 60), f"u{i}" if i % 3 == 0 else None, i) for i in range(600)]
    rows += [(600, None, datetime.date(2024, 5, 1), None, 600), (601, "Open 7", None, None, 601), (3, "Open 70", datetime.date(2024, 5, 1), "u3", 3)]
    want = sorted((a[0], a[1], a[2], b[0], b[1], b[2], s) for a in rows for b in rows if a[1] and a[2] and not a[3] and b[3] and abs((a[2] - b[2]).days) <= 1 and (s := round(similarity.weighted_ratio(a[1], b[1]), 1)) >= 70)
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b, *, once=False):
        @F.pandas_udf("double")
        def score(x: pd.Series, y: pd.Series) -> pd.Series:
            calls.add(len(x))
            return pd.Series([similarity.weighted_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

        return (score.asNondeterministic() if once else score)(a, b)

    monkeypatch.setattr(quality.similarity, "weighted", counted)
    monkeypatch.setattr(quality, "PACK", 4, raising=False)
    got = sorted(map(tuple, quality.duplicate_events(spark.createDataFrame(rows, KIND)).collect()))
    assert got == want and len(want) > 2000
    assert calls.value == 6
