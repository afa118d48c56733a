"""Outliers by quartile fences or z-scores: one statistics pass, then literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.operators.lookup import attach
from tablecraft.operators.projection import as_number, numeric_columns, rows_of
from tablecraft.operators.quantiles import column_quantiles, group_quantiles
from tablecraft.operators.statistics import varies

Bounds = Mapping[str, tuple[float, float, float]]


def fit_bounds(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
               threshold: float | None = None, approx: bool = False) -> Bounds:
    """``column -> (low, high, median)``; columns without spread or data are left out.

    Methods: iqr, zscore (sample deviation), and the two element-at-rank variants floor_index and
    zscore_pop, which need at least four numbers.
    """
    names = list(columns or numeric_columns(df))
    numbers = df.select(*[as_number(df, c).alias(c) for c in names])
    limit = threshold if threshold is not None else (1.5 if method in ("iqr", "floor_index") else 3.0)
    out = {}
    if method in ("zscore", "zscore_pop"):
        dev = F.stddev_samp if method == "zscore" else F.stddev_pop
        row = numbers.agg(
            *[F.struct(F.avg(c).alias("m"), F.when(varies(F.col(c)), dev(c)).alias("s"), F.count(c).alias("n")).alias(c) for c in names]
        ).first()
        for c in names:
            m, s, n = row[c]
            if method == "zscore_pop" and n >= 4:
                out[c] = (m - limit * (s or 1.0), m + limit * (s or 1.0), m)
            elif method == "zscore" and s:
                out[c] = (m - limit * s, m + limit * s, m)
        return out
    if method == "floor_index":
        counts = numbers.agg(*[F.count(c).alias(c) for c in names]).first()
        for c in names:
            n = counts[c]
            if n >= 4:
                probs = [int(n * 0.25) / (n - 1), 0.5, int(n * 0.75) / (n - 1)]
                q1, med, q3 = column_quantiles(numbers, [c], probs, approx=approx)[c]
                out[c] = (q1 - limit * (q3 - q1), q3 + limit * (q3 - q1), med)
        return out
    for c, q in column_quantiles(numbers, names, [0.25, 0.5, 0.75], approx=approx).items():
        if q:
            q1, med, q3 = q
            out[c] = (q1 - limit * (q3 - q1), q3 + limit * (q3 - q1), med)
    return out


def outside(df: DataFrame, column: str, bounds: Bounds) -> Column:
    lo, hi, _ = bounds[column]
    v = as_number(df, column)
    return F.coalesce((v < lo) | (v > hi), F.lit(False))


def any_outside(df: DataFrame, bounds: Bounds) -> Column:
    return reduce(lambda a, b: a | b, [outside(df, c, bounds) for c in bounds], F.lit(False))


def detect_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
                    threshold: float | None = None) -> DataFrame:
    """``column, outliers, min_outlier, max_outlier`` plus the row ``(any)`` counting distinct outlier rows."""
    bounds = fit_bounds(df, columns, method, threshold)
    per = [
        F.struct(
            F.count_if(outside(df, c, bounds)).alias("outliers"),
            F.min(F.when(outside(df, c, bounds), as_number(df, c))).alias("min_outlier"),
            F.max(F.when(outside(df, c, bounds), as_number(df, c))).alias("max_outlier"),
        ).alias(c)
        for c in bounds
    ]
    whole = F.struct(
        F.count_if(any_outside(df, bounds)).alias("outliers"),
        F.lit(None).cast("double").alias("min_outlier"),
        F.lit(None).cast("double").alias("max_outlier"),
    ).alias("(any)")
    wide = df.agg(*per, whole)
    return rows_of(wide, wide.columns)


def outlier_rows(df: DataFrame, key: str, columns: Sequence[str] | None = None, method: str = "iqr",
                 threshold: float | None = None) -> DataFrame:
    """``column, key`` of every outlier cell, one scan."""
    bounds = fit_bounds(df, columns, method, threshold)
    beyond = F.array_compact(F.array(*[F.when(outside(df, c, bounds), F.lit(c)) for c in bounds]))
    return df.select(F.explode(beyond).alias("column"), F.col(key))


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
                    threshold: float | None = None) -> DataFrame:
    """Drop rows outside any column's bounds; rows with gaps stay. All bounds come from the input."""
    bounds = fit_bounds(df, columns, method, threshold)
    return df.filter(~any_outside(df, bounds))


def treat_outliers(df: DataFrame, action: str = "cap", columns: Sequence[str] | None = None, method: str = "iqr",
                   threshold: float | None = None) -> DataFrame:
    """cap to the bounds, null, or median."""
    bounds = fit_bounds(df, columns, method, threshold)
    changes = {}
    for c, (lo, hi, med) in bounds.items():
        v = as_number(df, c)
        mask = outside(df, c, bounds)
        if action == "cap":
            changes[c] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))
        elif action == "null":
            changes[c] = F.when(~mask, v)
        elif action == "median":
            changes[c] = F.when(mask, F.lit(med)).otherwise(v)
        else:
            raise ValueError(f"unknown action {action!r}")
    return df.withColumns(changes) if changes else df


def flag_group_outliers(df: DataFrame, by: str, column: str, threshold: float = 1.5) -> DataFrame:
    """Add ``low, high, is_outlier`` with fences of each group."""
    q = group_quantiles(df.withColumn("_v", as_number(df, column)), [by], "_v", [0.25, 0.75])
    span = F.col("q")[1] - F.col("q")[0]
    fences = q.select(
        by, (F.col("q")[0] - threshold * span).alias("low"), (F.col("q")[1] + threshold * span).alias("high")
    )
    v = as_number(df, column)
    joined = attach(df, fences, [by])
    return joined.withColumn(
        "is_outlier", F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False))
    )
