"""Chart-ready aggregates: grouped measures, histograms, box plots, shares, running steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.cells import text
from tablecraft.operators.lookup import attach, attach_figures, beside
from tablecraft.operators.projection import as_number, is_numeric
from tablecraft.operators.quantiles import column_quantiles, group_quantiles
from tablecraft.operators.typing_ops import value_table
from tablecraft.session import materialize

TOP_K = 25


def _measure(agg: str, value: Column) -> Column:
    """Sum of nothing is 0, every other aggregate of nothing is null."""
    return {
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)),
        "avg": lambda: F.avg(value),
        "mean": lambda: F.avg(value),
        "count": lambda: F.count(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
    }[agg.lower()]()


def group_measure(df: DataFrame, dim: str, measure: str | None = None, agg: str = "mean", k: int = TOP_K) -> DataFrame:
    """``dim, value``: the measure is read as a number; unknown aggregates mean mean; top ``k`` groups."""
    rows = df.filter(F.col(dim).isNotNull())
    if measure is None:
        out = rows.groupBy(dim).agg(F.count(F.lit(1)).alias("value"))
    elif agg == "median":
        values = rows.select(dim, as_number(rows, measure, scale_percent=False).alias("_v"))
        out = group_quantiles(values, [dim], "_v", [0.5]).select(dim, F.col("q")[0].alias("value"))
    else:
        kind = agg if agg in ("count", "sum", "mean", "min", "max") else "mean"
        out = rows.groupBy(dim).agg(_measure(kind, as_number(rows, measure, scale_percent=False)).alias("value"))
    return out.orderBy(F.col("value").desc_nulls_last(), dim).limit(k)


def has_numbers(df: DataFrame, measure: str) -> bool:
    return not df.select(as_number(df, measure, False).alias("n")).filter("n IS NOT NULL").isEmpty()


def chart_query(df: DataFrame, x: str, y: str, agg: str = "SUM", group_by: str | None = None,
                line_y: str | None = None, k: int = TOP_K, null_label: str | None = None) -> DataFrame:
    """Aggregate ``y`` (and ``line_y``) by ``x`` [, ``group_by``]; falls back to COUNT for a text measure."""
    keys = [c for c in (x, group_by) if c]
    kind = agg.lower()
    if kind != "count" and not is_numeric(df, y) and not has_numbers(df, y):
        kind = "count"
    value = (lambda c: F.col(c)) if kind == "count" else (lambda c: as_number(df, c, False))
    if null_label is None:
        rows = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    else:
        rows = df.withColumns({c: F.coalesce(text(c), F.lit(null_label)) for c in keys})
    measures = [_measure(kind, value(c)).alias(n) for c, n in ((y, "value"), (line_y, "line_value")) if c]
    out = rows.groupBy(*keys).agg(*measures)
    return out.orderBy(F.col("value").desc_nulls_last(), *keys).limit(k)


def kpi(df: DataFrame, column: str, agg: str = "SUM") -> DataFrame:
    kind = agg.lower()
    if kind != "count" and not is_numeric(df, column) and not has_numbers(df, column):
        kind = "count"
    value = F.col(column) if kind == "count" else as_number(df, column, False)
    return df.agg(_measure(kind, value).alias("value"))


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values with their share (in percent) of the non-null cells."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(text(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = df.agg(F.count(column).alias("n")).first()["n"]
    return counts.orderBy(F.desc("count"), "value").limit(k).withColumn(
        "share_pct", F.col("count") * 100.0 / F.lit(max(total, 1))
    )


def _distinct_up_to(values: DataFrame, limit: int, estimate: int | None = None) -> int:
    """Distinct values, exact below ``limit``; a clearly larger estimate saves the distinct shuffle."""
    if estimate is None:
        estimate = values.agg(F.approx_count_distinct("v").alias("d")).first()["d"]
    return limit if estimate > 10 * limit + 100 else values.distinct().limit(limit).count()


def histogram(df: DataFrame, column: str, bins: int | None = None, max_bins: int = 20) -> DataFrame:
    """``bin, bin_start, bin_end, count`` with equal widths; the last bin is closed, empty bins are kept.

    Without ``bins`` the number is min(max_bins, distinct values).
    """
    values = df.select(as_number(df, column, False).alias("v")).filter(F.col("v").isNotNull())
    stats = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.approx_count_distinct("v").alias("d")).first()
    lo, hi = stats["lo"], stats["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    if bins is None:
        bins = max(1, _distinct_up_to(values, max_bins, stats["d"]))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col("v") - F.lit(lo)) * bins / F.lit(hi - lo)).cast("int"), F.lit(bins - 1))
    counts = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram_stats(df: DataFrame, column: str) -> DataFrame:
    """The one-row statistics shown next to a column histogram."""
    v = as_number(df, column, False)
    med, q1, q3 = column_quantiles(df.select(v.alias("v")), ["v"], [0.5, 0.25, 0.75])["v"] or [None] * 3
    return df.agg(
        F.avg(v).alias("mean"),
        F.lit(med).cast("double").alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q3).cast("double").alias("q3"),
        F.count(v).alias("count"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_distinct(v).alias("unique"),
    )


def chart_histogram(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Labelled 5 to 10 ranges of a numeric column, or the top values of a text column."""
    if not is_numeric(df, column) and not has_numbers(df, column):
        return value_counts(df, column, k).select(F.col("value").alias("label"), "count")
    values = df.select(as_number(df, column, False).alias("v")).filter(F.col("v").isNotNull())
    few = _distinct_up_to(values, 8)
    ranges = histogram(values, "v", bins=max(5, few) if few < 8 else 10)
    start, end = F.round("bin_start", 1), F.round("bin_end", 1)
    whole = (start == F.floor(start)) & (end == F.floor(end))
    label = F.when(whole, F.format_string("%d - %d", start.cast("bigint"), end.cast("bigint"))).otherwise(
        F.format_string("%.1f - %.1f", start, end))
    return ranges.select(label.alias("label"), "count", "bin_start", "bin_end")


def box_plot(df: DataFrame, measure: str, by: str | None = None, outliers: int = 10) -> DataFrame:
    """Whiskers inside 1.5 IQR, quartiles, mean and up to ten smallest outliers, per group."""
    keys = [by] if by else []
    rows = df.select(*keys, as_number(df, measure, False).alias("v")).dropna()
    q = group_quantiles(rows, keys, "v", [0.25, 0.5, 0.75]).select(
        *keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    fence = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - fence) & (F.col("v") <= F.col("q3") + fence)
    flagged = attach_figures(rows, q, keys).withColumn("inside", inside)
    stats = flagged.groupBy(*keys, "q1", "median", "q3").agg(
        F.coalesce(F.min(F.when(F.col("inside"), F.col("v"))), F.min("v")).alias("min"),
        F.coalesce(F.max(F.when(F.col("inside"), F.col("v"))), F.max("v")).alias("max"),
        F.avg("v").alias("mean"),
        F.count_if(~F.col("inside")).alias("n_outliers"),
    )
    # Distinct outlier values are counted first, so the ranked window sees each value once.
    values = flagged.filter(~F.col("inside")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    if by:
        # Spark keeps at most ``outliers`` rows per group and task before the shuffle.
        place = F.row_number().over(Window.partitionBy(by).orderBy("v"))
        smallest = values.withColumn("r", place).filter(F.col("r") <= outliers)
    else:
        smallest = values.orderBy("v").limit(outliers)
    lists = smallest.groupBy(*keys).agg(
        F.slice(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("v", F.least("n", F.lit(outliers)).cast("int").alias("n")))),
                    lambda e: F.array_repeat(e["v"], e["n"]),
                )
            ), 1, outliers,
        ).alias("outliers")
    )
    joined = stats.join(lists, by, "left") if by else beside(stats, lists)
    columns = ["min", "q1", "median", "q3", "max", "mean", "n_outliers"]
    return joined.select(
        F.col(by) if by else F.lit("Overall").alias("group"),
        *columns,
        F.coalesce("outliers", F.array().cast("array<double>")).alias("outliers"),
    )


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    v = as_number(df, column, False)
    q = column_quantiles(df.select(v.alias("v")), ["v"], [0.25, 0.5, 0.75])["v"] or [None] * 3
    return df.agg(
        F.min(v).alias("min"), *[F.lit(x).cast("double").alias(n) for x, n in zip(q, ("q1", "median", "q3"))],
        F.max(v).alias("max"),
    )


def waterfall(df: DataFrame, x: str, y: str, steps: int = 15) -> DataFrame:
    """Sums in key order with running start and end, closed by a Net Total row.

    The first ``steps`` keys are steps of their own; if there are more keys, one step Remaining holds their sum,
    so that the total covers every row.
    """
    every = materialize(
        df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.coalesce(F.sum(as_number(df, y, False)), F.lit(0.0)).alias("value")))
    sums = materialize(every.orderBy(x).limit(steps))
    # The window runs over at most ``steps`` rows.
    upto = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    walked = sums.withColumn("end", F.sum("value").over(upto)).select(
        text(x).alias("label"),
        "value",
        (F.col("end") - F.col("value")).alias("start"),
        "end",
        F.when(F.col("value") >= 0, "positive").otherwise("negative").alias("type"),
    )
    whole = beside(
        every.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")),
        sums.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("shown")))
    rest = F.col("value") - F.col("shown")
    remaining = whole.filter(F.col("keys") > steps).select(
        F.lit("Remaining").alias("label"), rest.alias("value"), F.col("shown").alias("start"), F.col("value").alias("end"),
        F.when(rest >= 0, "positive").otherwise("negative").alias("type"))
    total = whole.select(
        F.lit("Net Total").alias("label"), "value", F.lit(0.0).alias("start"), F.col("value").alias("end"),
        F.lit("total").alias("type"),
    )
    return walked.unionByName(remaining).unionByName(total)


def _top_sums(df: DataFrame, keys: Sequence[str], y: str | None, k: int) -> DataFrame:
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    total = F.coalesce(F.sum(as_number(df, y, False)), F.lit(0.0)) if y else F.count(F.lit(1))
    return rows.groupBy(*keys).agg(total.alias("value")).orderBy(F.desc("value"), *keys).limit(k)


def funnel(df: DataFrame, x: str, y: str | None = None, k: int = 10) -> DataFrame:
    """Largest stages with percent of the largest one."""
    top = _top_sums(df, [x], y, k)
    biggest = F.max("value").over(Window.partitionBy())  # at most k rows
    return top.withColumn("percentage", F.col("value") * 100.0 / F.when(biggest > 0, biggest).otherwise(1.0))


def treemap(df: DataFrame, x: str, y: str | None = None, group_by: str | None = None, k: int = TOP_K) -> DataFrame:
    """Largest tiles with percent of the shown total."""
    top = _top_sums(df, [c for c in (x, group_by) if c], y, k)
    shown = F.sum("value").over(Window.partitionBy())  # at most k rows
    return top.withColumn("share", F.col("value") * 100.0 / F.when(shown > 0, shown).otherwise(1.0))


def gauge(df: DataFrame, column: str) -> DataFrame:
    """Current total against a target a quarter above it."""
    v = as_number(df, column, False)
    base = df.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("current"), F.coalesce(F.avg(v), F.lit(0.0)).alias("average"))
    target = F.when(F.col("current") > 0, F.col("current") * 1.25).otherwise(100.0)
    return base.select(
        "current", target.alias("target"), F.lit(0.0).alias("min"), (target * 1.2).alias("max"),
        (F.col("current") * 100 / target).alias("percentage"), "average",
    )


def geo_map(df: DataFrame, region: str, y: str, k: int = 30) -> DataFrame:
    return _top_sums(df, [region], y, k)


def stacked_shares(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """Each series as percent of the absolute total of its x."""
    sums = df.groupBy(x, series).agg(F.coalesce(F.sum(as_number(df, y, False)), F.lit(0.0)).alias("value"))
    whole = sums.groupBy(x).agg(F.sum(F.abs("value")).alias("_whole"))
    return attach(sums, whole, [x], "inner").select(
        x, series, "value", F.coalesce(F.try_divide(F.abs("value") * 100, F.col("_whole")), F.lit(0.0)).alias("share")
    )


def series_matrix(df: DataFrame, x: str, series: str, y: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row per x and one column per series value, 0 where a combination is absent.

    All values of the series are columns, in order; the engine refuses more than ``spark.sql.pivotMaxValues`` of them.
    """
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = df.select(F.col(series).alias("value")).dropna().distinct().orderBy("value").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{series!r} has more than {most} values; name those wanted, or use stacked_shares")
        values = [r["value"] for r in found]
    pivoted = df.groupBy(x).pivot(series, list(values)).agg(F.sum(as_number(df, y, False)))
    return pivoted.fillna(0.0, subset=[str(v) for v in values])


def bubble_radius(df: DataFrame, column: str, low: float = 4.0, high: float = 25.0) -> DataFrame:
    """Min-max scaled radius; a constant column gives the smallest radius."""
    v = as_number(df, column, False)
    edge = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    span = F.lit(edge["hi"]) - F.lit(edge["lo"])
    scaled = F.try_divide(v - F.lit(edge["lo"]), span.cast("double"))
    return df.withColumn("radius", F.lit(low) + F.coalesce(scaled, F.lit(0.0)) * (high - low))


def label_totals(df: DataFrame, label: str, y: str | None = None, k: int = 12, width: int = 15,
                 null_label: str = "Unknown") -> DataFrame:
    """Sum (or count) by full label, missing labels under one name, largest first; ``label`` is shortened for showing only."""
    name = F.coalesce(text(label), F.lit(null_label))
    total = F.coalesce(F.sum(as_number(df, y)), F.lit(0.0)) if y else F.count(F.lit(1))
    top = df.groupBy(name.alias("full_label")).agg(total.alias("value")).orderBy(F.desc("value"), "full_label").limit(k)
    return top.select(F.substring("full_label", 1, width).alias("label"), "full_label", "value")


def line_points(df: DataFrame, x: str, y: str, ties: Sequence[str] = (), limit: int = 40) -> DataFrame:
    rows = df.select(x, as_number(df, y).alias("value"), *ties).filter(F.col("value").isNotNull())
    return rows.orderBy(x, *ties).limit(limit)


def point_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y")).dropna()


def chart_summary(points: DataFrame, label: str, value: str) -> DataFrame:
    """Totals and extremes of a chart result."""
    v = F.col(value)
    mean = points.agg(F.avg(v).alias("m")).first()["m"]
    best = F.struct(v, F.col(label).alias("l"))
    out = points.filter(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.max_by(F.col(label), best).alias("top"),
        F.max(v).alias("top_value"),
        F.min_by(F.col(label), best).alias("bottom"),
        F.min(v).alias("bottom_value"),
        (F.max(v) - F.min(v)).alias("range"),
        (F.count_if(v >= F.lit(mean)) * 100.0 / F.count(F.lit(1))).alias("above_mean_pct"),
    )
    base = F.greatest(F.col("total"), F.lit(1.0))
    return out.withColumn("top_share_pct", F.col("top_value") * 100 / base).withColumn(
        "bottom_share_pct", F.col("bottom_value") * 100 / base
    )


def multi_chart_summary(charts: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Per-chart totals plus grand total and the chart holding the overall largest value."""
    tagged = [
        points.select(
            F.lit(name).alias("chart"), text(label).alias("label"), F.col(value).cast("double").alias("value")
        )
        for name, (points, label, value) in charts.items()
    ]
    rows = reduce(DataFrame.unionByName, tagged).filter("value is not null")
    per_chart = rows.groupBy("chart").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.max_by("label", F.struct("value", "label")).alias("top"),
        F.max("value").alias("top_value"),
    )
    whole = Window.partitionBy()  # one row per chart
    return per_chart.withColumn("grand_total", F.sum("total").over(whole)).withColumn(
        "is_overall_top", F.col("top_value") == F.max("top_value").over(whole)
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values of each column, in long form."""
    columns = list(columns or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], columns, "column", "distinct")
    pairs = value_table(df, columns).filter("value is not null")
    found = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("distinct"))
