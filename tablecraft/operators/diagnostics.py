"""Business diagnostics: category gaps, elasticity, concentration, stock thresholds, column answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecraft.operators.charts import value_counts
from tablecraft.operators.lookup import beside
from tablecraft.operators.profile import normality, numeric_stats
from tablecraft.operators.projection import as_number
from tablecraft.operators.quantiles import column_quantiles
from tablecraft.operators.statistics import pair_strength


def _sums(df: DataFrame, category: str, measure: str) -> DataFrame:
    v = as_number(df, measure)
    return df.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("c")).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.avg(v).alias("m"), F.count(v).alias("n"))


def category_gap(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Top and bottom category by total and the gap in percent of the top."""
    one = _sums(df, category, measure).agg(
        F.max_by(F.struct("c", "s", "m", "n"), F.struct("s", "c")).alias("hi"),
        F.min_by(F.struct("c", "s", "m", "n"), F.struct("s", "c")).alias("lo"),
    )
    gap = (F.col("hi.s") - F.col("lo.s")) * 100 / F.greatest(F.col("hi.s"), F.lit(1.0))
    return one.select(
        F.col("hi.c").alias("top"), F.col("hi.s").alias("top_sum"), F.col("hi.m").alias("top_mean"), F.col("hi.n").alias("top_n"),
        F.col("lo.c").alias("bottom"), F.col("lo.s").alias("bottom_sum"), F.col("lo.m").alias("bottom_mean"),
        F.col("lo.n").alias("bottom_n"), gap.alias("gap_pct"))


def elasticity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two measures, its class and the shift a ten percent change suggests."""
    r = F.col("r")
    kind = F.when(r > 0.5, "strong positive").when(r < -0.3, "inverse").otherwise("moderate or decoupled")
    return pair_strength(df, a, b).select("n", "r", kind.alias("relation"), F.abs(r * 10).alias("shift_pct"))


def concentration(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Share of the total held by the largest and the smallest category."""
    one = _sums(df, category, measure).agg(
        F.sum("s").alias("total"), F.max_by("c", F.struct("s", "c")).alias("top"), F.max("s").alias("hi"),
        F.min_by("c", F.struct("s", "c")).alias("bottom"), F.min("s").alias("lo"))
    base = F.greatest(F.col("total"), F.lit(1.0))
    return one.select("top", (F.col("hi") * 100 / base).alias("top_share_pct"), "bottom",
                      (F.col("lo") * 100 / base).alias("bottom_share_pct"))


def stock_thresholds(df: DataFrame, column: str) -> DataFrame:
    """Reorder figures: lower quartile, median, upper quartile."""
    q = column_quantiles(df.select(as_number(df, column).alias("v")), ["v"], [0.25, 0.5, 0.75])["v"]
    return df.agg(F.count(as_number(df, column)).alias("n")).select(
        "n", *[F.lit(x).cast("double").alias(n) for x, n in zip(q, ("p25", "median", "p75"))])


def column_summary(df: DataFrame, measure: str, category: str) -> DataFrame:
    """One row answering the usual questions on a measure and a category."""
    stats = numeric_stats(df, [measure]).select(
        (F.col("mean") * F.col("count")).alias("sum"), "mean", "median", "min", "max", "count", "outlier_count",
        F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, F.col("count")), F.lit(0.0)).alias("outlier_pct"))
    shape = normality(df, [measure]).select("skewness", "kurtosis")
    top = value_counts(df, category, 1).select(
        F.col("value").alias("top_category"), F.col("count").alias("top_count"), F.col("share_pct").alias("top_share_pct"))
    return beside(stats, shape, top)
