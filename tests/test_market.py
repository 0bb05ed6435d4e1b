"""The market's baseline over many files of events."""

from __future__ import annotations

import datetime

from tidemark.plans.evaluation_queries import market_baseline


def test_totals_are_summed_once(spark, tmp_path):
    """A total that is summed twice, in two orders, need not equal itself, and then no side of a pair wins."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), i % 20, ("view", "click")[i % 3 % 2], [0.1, 1e9, 0.7, 1e-3, 33.33][i * 7 % 5] + i % 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    out = market_baseline(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sum(value") == 1
    assert out.collect()[0]["n"] == 20
