"""Row numbers over whole tables without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.stored import written


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """A global row number (from 1): rows are dealt by ranges of the order and sorted in each, and
    written with their places there; the sizes of the ranges, one number each, are summed."""
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select("*", *((x if isinstance(x, Column) else F.col(x)).alias(k) for k, x in zip(keys, order, strict=True)))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()))  # range << 33 | place
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    every = sizes.agg(F.collect_list(F.struct("_range", "_n")).alias("x")).select(F.explode_outer("x").alias("r"), "x")  # as many as ranges
    before = every.select(F.col("r._range").alias("_range"), F.aggregate(F.filter("x", lambda y: y["_range"] < F.col("r._range")), F.lit(0).cast("long"), lambda s, y: s + y["_n"]).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return placed.withColumn("_range", part).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + inside + 1).alias(name))


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in an explicit order. Partial minima come
    first, so a key that holds a third of the rows is no task of its own."""
    keys = [key] if isinstance(key, str) else key
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first).select("_first.*")


def running(counts: DataFrame, value: str, count: str, *by: str) -> DataFrame:
    """Adds before (the sum of ``count`` of smaller values) and total, within each
    group. The rows are written in ranges of the values: a range sums its own rows,
    and only the ranges' sums are run through, so no group is one sort."""
    ranges = written(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy(*by, "_range").agg(F.sum(count).alias("_sum"))
    group = [F.lit(0), *by]
    earlier = F.sum("_sum").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(earlier, F.lit(0)).alias("_earlier"), F.sum("_sum").over(W.partitionBy(*group)).alias("total"))
    inside = F.sum(count).over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_g{i}"))
    rows = ranges.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, same)
    return rows.select(*counts.columns, (F.col("_earlier") + F.col("_inside")).alias("before"), "total")


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group and their rank (Spark prunes early)."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
