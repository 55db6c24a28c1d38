"""Summaries of amounts: the exact median without a task that holds all values."""

import statistics

from pyspark.sql import functions as F

from tarnlake.operators import metrics


def summary(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(3)
    return metrics.funding_summary(df, F.col("v"))


def test_median_is_exact_over_ranges(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 7 + [9.0], [float(x * 7919 % 1001) for x in range(1000)], [float(x * x % 97) for x in range(501)], [-0.5, float("inf"), 2.25, float("-inf")]):
        got = summary(spark, [[v, None] for v in values] + [[None], []]).first()
        assert got.median_recorded_funding == (statistics.median(values) if values else None)
        assert (got.records_with_funding, got.records_missing_funding, got.minimum_recorded_funding, got.maximum_recorded_funding) == (len(values), 2, min(values, default=None), max(values, default=None))


def test_no_task_gathers_all_values(spark):
    plan = summary(spark, [[1.0], [2.0]])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median" in plan and "percentile" not in plan and "median(" not in plan
