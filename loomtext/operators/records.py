"""Joins of records that describe the same things."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge_records(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join by key; a column of both takes the right value unless it is null."""
    r = right.select(F.col(key), *(F.col(c).alias(f"_r_{c}") for c in right.columns if c != key))
    both = left.join(r, key, "left")
    merged = [F.coalesce(f"_r_{c}", c).alias(c) if c in right.columns and c != key else F.col(c) for c in left.columns]
    return both.select(*merged, *(F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns))


def column_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For each common column: rows compared, null-safe mismatches, first key."""
    columns = [c for c in a.columns if c in b.columns and c != key]
    both = a.alias("a").join(b.alias("b"), key)
    checks = F.array(*(F.struct(F.lit(c).alias("column"), (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("differs")) for c in columns))
    rows = both.select(F.col(key).alias("_key"), F.explode(checks).alias("x"))
    return rows.groupBy("x.column").agg(F.count("*").alias("compared"), F.count_if("x.differs").alias("mismatches"), F.min(F.when(F.col("x.differs"), F.col("_key"))).alias("first_id"))
