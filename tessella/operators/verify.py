"""Checks of one result against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """total_a, total_b and whether they are equal."""
    x, y = a.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_a")), b.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_b"))
    return x.crossJoin(y).withColumn("equal", F.col("total_a") == F.col("total_b"))  # a row each


def per_query(a: DataFrame, b: DataFrame) -> DataFrame:
    """compared queries, mismatches and the sum of absolute differences; a query that one lacks counts as 0 there."""
    both = a.select("qid", F.col("cnt").alias("x")).join(b.select("qid", F.col("cnt").alias("y")), "qid", "full")
    diff = F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))
    return both.agg(F.count("*").alias("compared"), F.count_if(diff > 0).alias("mismatches"), F.coalesce(F.sum(diff), F.lit(0)).cast("long").alias("abs_diff"))


COUNTERS = ("query_count", "node_visits", "leaf_visits", "rect_tests", "child_pushes")


def counters_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(counter, value_a, value_b, equal) of the five counters of two plans of one search, a row each."""
    x, y = (t.select(F.expr(f"stack({len(COUNTERS)}, {', '.join(f"'{c}', {c}" for c in COUNTERS)}) AS (counter, {v})")) for t, v in ((a, "value_a"), (b, "value_b")))
    return x.join(y, "counter").withColumn("equal", F.col("value_a") == F.col("value_b"))
