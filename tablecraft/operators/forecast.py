"""Trend fits and forecasts over ordered series, for one series or many at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.operators.lookup import attach_figures
from tablecraft.operators.ordering import row_index
from tablecraft.operators.projection import as_number, numeric_columns

Z95 = 1.96
# Fixed value: names that suggest a time axis. ---------------------------------------------------
TIME_NAME = r"(?i)date|time|year|month|day|period|timestamp|week"


def series(df: DataFrame, order_by: Sequence[str], y: str, partition_by: Sequence[str] = (),
           buckets: int | None = None) -> DataFrame:
    """Keys, ``t`` (position from 0) and ``y`` of the rows holding a number."""
    rows = df.select(*dict.fromkeys([*partition_by, *order_by]), as_number(df, y).alias("y")).filter("y is not null")
    return row_index(rows, order_by, partition_by, "t", buckets)


def fit_trends(points: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per series and model: fitted on u = (t - center) / scale with y shifted by its mean.

    value(t) = level + slope * u + curve * u * u; ``r2`` is clamped to [0, 1] and ``sigma`` is the
    population deviation of the residuals. The quadratic model needs five points.
    """
    keys = list(partition_by)
    flat = F.min("y") == F.max("y")
    base = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(flat, F.min("y")).otherwise(F.avg("y")).alias("mean"))
    base = base.select(
        *keys, "n", "mean", ((F.col("n") - 1) / 2).alias("center"), F.greatest((F.col("n") - 1) / 2, F.lit(1.0)).alias("scale")
    )
    u = (F.col("t") - F.col("center")) / F.col("scale")
    joined = attach_figures(points, base, keys).withColumn("u", u).withColumn("d", F.col("y") - F.col("mean"))
    u2 = F.col("u") * F.col("u")
    sums = joined.groupBy(*keys, "n", "mean", "center", "scale").agg(
        F.sum(u2).alias("s2"),
        F.sum(u2 * u2).alias("s4"),
        F.sum(F.col("u") * F.col("d")).alias("sud"),
        F.sum(u2 * F.col("d")).alias("su2d"),
        F.sum(F.col("d") * F.col("d")).alias("sdd"),
    )
    # The grid is symmetric around its center, so odd power sums vanish and the fit is closed-form.
    s0 = F.col("n").cast("double")
    slope = F.coalesce(F.try_divide(F.col("sud"), F.col("s2")), F.lit(0.0))
    curve = F.coalesce(F.try_divide(s0 * F.col("su2d"), s0 * F.col("s4") - F.col("s2") * F.col("s2")), F.lit(0.0))
    lift = -curve * F.col("s2") / s0
    sse_linear = F.greatest(F.col("sdd") - slope * F.col("sud"), F.lit(0.0))
    sse_poly = F.greatest(F.col("sdd") - slope * F.col("sud") - curve * F.col("su2d"), F.lit(0.0))

    def model(name, sse, level, curvature):
        r2 = F.when(F.col("sdd") > 0, F.least(F.greatest(1 - F.try_divide(sse, F.col("sdd")), F.lit(0.0)), F.lit(1.0)))
        return F.struct(
            F.lit(name).alias("model"),
            F.coalesce(r2, F.lit(1.0)).alias("r2"),
            F.when(F.col("n") > 2, F.sqrt(sse / s0)).otherwise(0.0).alias("sigma"),
            sse.alias("sse"),
            level.alias("level"),
            slope.alias("slope"),
            curvature.alias("curve"),
        )

    models = F.array(
        model("linear", sse_linear, F.col("mean"), F.lit(0.0)), model("poly", sse_poly, F.col("mean") + lift, curve)
    )
    usable = F.filter(models, lambda m: (m["model"] == "linear") | (F.col("n") >= 5))
    return sums.select(*keys, "n", "center", "scale", "s2", F.inline(usable))


def value_at(t) -> F.Column:
    u = (t - F.col("center")) / F.col("scale")
    return F.col("level") + F.col("slope") * u + F.col("curve") * u * u


def trend_table(fits: DataFrame) -> DataFrame:
    """Fits in plain terms: slope per step and value at t = 0 of the linear part."""
    per_step = F.col("slope") / F.col("scale")
    return fits.withColumns({"per_step": per_step, "at_zero": value_at(F.lit(0.0))})


def best_model(fits: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """The model with the highest R2 to four digits; the linear one wins ties."""
    keys = list(partition_by)
    row = F.struct(*[F.col(c) for c in fits.columns if c not in keys])
    rank = F.struct(F.round("r2", 4).alias("r2"), (F.col("model") == "linear").alias("linear"))
    return fits.groupBy(*keys).agg(F.max_by(row, rank).alias("m")).filter("m is not null").select(*keys, "m.*")


def forecast(best: DataFrame, periods: int = 6) -> DataFrame:
    """Future steps with a band of 1.96 residual deviations."""
    ahead = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    value = value_at(F.col("n") - 1 + F.col("step"))
    return ahead.withColumns({
        "predicted": value,
        "upper_bound": value + Z95 * F.col("sigma"),
        "lower_bound": value - Z95 * F.col("sigma"),
    })


def last_dates(points: DataFrame, when: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Last date of each series and its distance in days from the one before."""
    keys = list(partition_by)
    dated = points.withColumn("_d", F.col(when).cast("date"))
    sizes = dated.groupBy(*keys).agg(F.max("t").alias("_t"))
    tail = attach_figures(dated, sizes, keys).filter(F.col("t") >= F.col("_t") - 1)
    return tail.groupBy(*keys).agg(
        F.max(F.when(F.col("t") == F.col("_t"), F.col("_d"))).alias("last_date"),
        F.max(F.when(F.col("t") == F.col("_t") - 1, F.col("_d"))).alias("previous_date"),
    ).withColumn("gap_days", F.datediff("last_date", "previous_date"))


def date_labels(future: DataFrame, dates: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Label future steps with extrapolated dates: last date plus the last gap times the step."""
    keys = list(partition_by)
    label = F.coalesce(
        F.date_format(F.date_add("last_date", (F.col("gap_days") * F.col("step")).cast("int")), "yyyy-MM-dd"),
        F.concat(F.lit("Forecast +"), F.col("step").cast("string")),
    )
    return attach_figures(future, dates.select(*keys, "last_date", "gap_days"), keys, "left").withColumn("label", label)


def parses_as_dates(df: DataFrame, column: str, share: float = 0.7) -> bool:
    from tablecraft.functions.cells import parse_date

    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(parse_date(column)).alias("d")).first()
    return row["n"] > 0 and row["d"] > share * row["n"]


def trend_direction(points: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Percent change from the first to the last point; up or down beyond two percent."""
    keys = list(partition_by)
    ends = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("y", "t").alias("first"), F.max_by("y", "t").alias("last")
    )
    change = F.coalesce(F.try_divide((F.col("last") - F.col("first")) * 100, F.abs("first")), F.lit(0.0))
    return ends.withColumn("pct_change", change).withColumn(
        "direction",
        F.when(F.col("pct_change") > 2, "upward").when(F.col("pct_change") < -2, "downward").otherwise("stable"),
    )


def interval_forecast(fits: DataFrame, periods: int = 5) -> DataFrame:
    """Linear forecast with prediction intervals that widen away from the middle of the series."""
    linear = fits.filter("model = 'linear'").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    s = F.sqrt(F.col("sse") / F.greatest(F.lit(1), F.col("n") - 2))
    u = (F.col("n") - 1 + F.col("step") - F.col("center")) / F.col("scale")
    margin = Z95 * s * F.sqrt(1 + 1 / F.col("n") + F.coalesce(F.try_divide(u * u, F.col("s2")), F.lit(0.0)))
    value = F.col("level") + F.col("slope") * u
    return linear.withColumns({"predicted": value, "lower_bound": value - margin, "upper_bound": value + margin})


def fitted_history(points: DataFrame, best: DataFrame, partition_by: Sequence[str] = (), shown: int = 60) -> DataFrame:
    """Every n // 60-th point with its trend value and one-deviation band."""
    joined = attach_figures(points, best, list(partition_by))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / shown))
    kept = joined.filter(F.col("t") % stride == 0)
    value = value_at(F.col("t"))
    return kept.withColumns({
        "trend": value, "upper_band": value + F.col("sigma"), "lower_band": value - F.col("sigma")
    })


def detect_axes(df: DataFrame, value: str | None = None, when: str | None = None) -> tuple[str | None, str | None]:
    """Value and date columns for a forecast: the first numeric one and the first with a time-like name."""
    numbers = numeric_columns(df)
    if value not in numbers:
        readable = numbers or [c for c in df.columns if df.select(as_number(df, c).alias("v")).filter("v is not null").limit(1).count()]
        value = next((c for c in readable if c != when), None)
    if not when or when == value:
        others = [c for c in df.columns if c != value]
        when = next((c for c in others if re.search(TIME_NAME, c)), others[0] if others else None)
    return value, when
