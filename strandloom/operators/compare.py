"""Comparing two result sets by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_anti(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Names found by one side only, and which side."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(a, b, "a").unionAll(only(b, a, "b"))


def diff_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Names on either side, on the first only, on the second only: one aggregation over tagged names."""
    tagged = a.select(key, F.lit(1).alias("side")).unionAll(b.select(key, F.lit(2).alias("side")))
    sides = tagged.groupBy(key).agg(F.bit_or("side").alias("sides"))
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return sides.agg(F.count("*").alias("n_union"), count(F.col("sides") == 1).alias("n_only_a"), count(F.col("sides") == 2).alias("n_only_b"))


def last_wins(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The row that comes last in `order`, for each key."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *values)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in (order, *values)])
