"""Profiles of tables: missing values, statistics, outliers, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.stored import written
from .ranking import running


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row and column: (column, value as double)."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values and their share in percent, per column, in one pass."""
    columns = columns or df.columns
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(columns)))
    return sums.select("n", F.explode(rows).alias("x")).select("x.column", "x.missing", F.round(F.col("x.missing") * 100 / F.col("n"), 2).alias("percent"))


def quantiles(df: DataFrame, column: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Of each group the interpolated quantiles of the known values, by counts of
    equal values: no group's values meet in one buffer."""
    return counted_quantiles(df.groupBy(*by, F.col(column).cast("double").alias("value")).agg(F.count("*").alias("c")), shares, *by)


def counted_quantiles(counts: DataFrame, shares: dict[str, float], *by: str) -> DataFrame:
    """The same from counts (value, c) of each group."""
    known = counts.where("value is not null").select(*by, F.col("value").alias("_v"), F.col("c").alias("_c"))
    placed = running(known, "_v", "_c", *by)

    def at(place: Column) -> Column:
        here = (F.col("before") <= place) & (place < F.col("before") + F.col("_c"))
        return F.max(F.when(here, F.col("_v")))

    out = placed.groupBy(*by)
    parts = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * share
        parts += [at(F.floor(place)).alias(f"_l_{name}"), at(F.ceil(place)).alias(f"_h_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    values = {n: (1 - F.col(f"_f_{n}")) * F.col(f"_l_{n}") + F.col(f"_f_{n}") * F.col(f"_h_{n}") for n in shares}
    return out.agg(*parts).select(*by, *(v.alias(n) for n, v in values.items()))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, missing, mean, median, mode (the least on a tie), min, max, quartiles,
    IQR, sample deviation, and fences of 1.5 IQR with the rows outside them."""
    counts = written(long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("c")))
    value, c = F.col("value"), F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0)
    stats = counts.groupBy("column").agg(
        F.sum(c).alias("n"), F.sum(F.when(value.isNull(), F.col("c")).otherwise(0)).alias("missing"), (F.sum(value * c) / F.sum(c)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min_by("value", F.when(value.isNotNull(), F.struct(-F.col("c"), value))).alias("mode"),
    )
    inner = counted_quantiles(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "column")
    fences = stats.join(inner, "column", "left").withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("low", F.col("q1") - 1.5 * F.col("iqr")).withColumn("high", F.col("q3") + 1.5 * F.col("iqr"))
    fences = written(fences.coalesce(1))  # a row for each column
    far = counts.join(F.broadcast(fences.select("column", "low", "high", "mean", F.col("n").alias("_n"))), "column").groupBy("column").agg(
        F.sum(F.when((value < F.col("low")) | (value > F.col("high")), c).otherwise(0)).alias("outliers"),
        F.when(F.max("_n") > 1, F.sqrt(F.sum(c * (value - F.col("mean")) * (value - F.col("mean"))) / (F.max("_n") - 1))).alias("std"),
    )
    return fences.join(F.broadcast(far), "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, nulls as a value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations of all pairs over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(*(F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """value and its average rank: from the values' counts, so ties cost one row."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("ties"))
    return running(counts, "value", "ties").select("value", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks over rows where both are known."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ra = average_rank(both, "a").select(F.col("value").alias("a"), F.col("rank").alias("ra"))
    rb = average_rank(both, "b").select(F.col("value").alias("b"), F.col("rank").alias("rb"))
    return both.join(ra, "a").join(rb, "b").agg(F.corr("ra", "rb").alias("rho"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0) and n of equal-width bins; the last is closed, empty ones stay."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    filled = df.where(F.col(column).isNotNull()).join(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Five numbers of each group."""
    ends = df.groupBy(group).agg(F.min(column).alias("min"), F.max(column).alias("max"))
    inner = quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group).withColumnRenamed(group, "_group")
    return ends.join(inner, F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "min", "q1", "median", "q3", "max")


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The value at place n div 2 (from 0) of the sorted column, by counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    placed = running(counts, "value", "c").where("before + c > floor(total / 2)")
    return placed.agg(F.min("value").alias("upper_median"))
