"""Trend and forecast queries over daily order totals and per-user event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import forecast
from tablecraft.plans.catalogue.registry import query, r, rounded

# Daily totals of all orders, and the value series of every event type.
DAILY = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1), p AS (SELECT day, y, row_number() OVER (ORDER BY day) - 1 AS t FROM d)"
TYPED = "p AS (SELECT event_type, event_id, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events)"


def daily(t):
    totals = t("orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return forecast.series(totals, ["day"], "total")


def typed(t):
    return forecast.series(t("events").select("event_type", "ts", "event_id", "value"), ["ts", "event_id"], "value", ["event_type"])


def quad_sql(keys: str, source: str = "p") -> str:
    """CTEs ``f``: centred linear and quadratic fits per key."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {k}n, mean, center, scale"
    return f"""b AS (SELECT {k}count(*) AS n, avg(y) AS mean, (count(*) - 1) / 2.0 AS center, greatest((count(*) - 1) / 2.0, 1.0) AS scale FROM {source} {f'GROUP BY {keys}' if keys else ''}),
u AS (SELECT {k}t, y, n, mean, center, scale, (t - center) / scale AS u, y - mean AS d FROM {source} JOIN b {on}),
s AS (SELECT {k}n, mean, center, scale, sum(u * u) AS s2, sum(u * u * u * u) AS s4, sum(u * d) AS sud, sum(u * u * d) AS su2d, sum(d * d) AS sdd FROM u {group}),
m AS (SELECT *, sud / s2 AS slope, (n * su2d) / (n * s4 - s2 * s2) AS curve FROM s),
f AS (SELECT *, -curve * s2 / n AS lift, sdd - slope * sud AS sse1, sdd - slope * sud - curve * su2d AS sse2 FROM m)"""


@query("fc01_linear_trend", f"""WITH {DAILY} SELECT 'linear' AS model, count(*) AS n, {r('regr_slope(y, t)')} AS per_step, {r('regr_intercept(y, t)', 2)} AS at_zero, {r('regr_r2(y, t)', 6)} AS r2 FROM p""")
def _(t):
    fits = forecast.trend_table(forecast.fit_trends(daily(t)).filter("model = 'linear'"))
    return fits.select("model", "n", F.round("per_step", 4).alias("per_step"), F.round("at_zero", 2).alias("at_zero"), F.round("r2", 6).alias("r2"))


@query("fc01_linear_trend_by_type", f"""WITH {TYPED} SELECT event_type, count(*) AS n, {r('regr_slope(y, t)', 7)} AS per_step, {r('regr_intercept(y, t)')} AS at_zero, {r('regr_r2(y, t)', 7)} AS r2 FROM p GROUP BY 1""")
def _(t):
    fits = forecast.trend_table(forecast.fit_trends(typed(t), ["event_type"]).filter("model = 'linear'"))
    return fits.select("event_type", "n", F.round("per_step", 7).alias("per_step"), F.round("at_zero", 4).alias("at_zero"), F.round("r2", 7).alias("r2"))


@query("fc02_quadratic_trend", f"""WITH {TYPED}, {quad_sql('event_type')}
SELECT event_type, n, {r('mean + lift')} AS level, {r('slope')} AS slope, {r('curve')} AS curve, {r('1 - sse2 / sdd', 7)} AS r2, {r('sqrt(sse2 / n)')} AS sigma FROM f""")
def _(t):
    fits = forecast.fit_trends(typed(t), ["event_type"]).filter("model = 'poly'")
    return fits.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("level", "slope", "curve", "sigma")], F.round("r2", 7).alias("r2"))


_BEST = "CASE WHEN round(1 - sse2 / sdd, 4) > round(1 - sse1 / sdd, 4) THEN 'poly' ELSE 'linear' END"


@query("fc03_best_model", f"WITH {TYPED}, {quad_sql('event_type')} SELECT event_type, {_BEST} AS model FROM f")
def _(t):
    return forecast.best_model(forecast.fit_trends(typed(t), ["event_type"]), ["event_type"]).select("event_type", "model")


@query("fc04_forecast", f"""WITH {DAILY}, {quad_sql('')},
g AS (SELECT *, {_BEST} = 'poly' AS q, unnest(range(1, 7)) AS step FROM f),
h AS (SELECT *, (n - 1 + step - center) / scale AS x, sqrt(CASE WHEN q THEN sse2 ELSE sse1 END / n) AS sigma FROM g),
v AS (SELECT step, sigma, CASE WHEN q THEN mean + lift + slope * x + curve * x * x ELSE mean + slope * x END AS v FROM h)
SELECT CAST(step AS INT) AS step, {r('v', 2)} AS predicted, {r('v + 1.96 * sigma', 2)} AS upper_bound, {r('v - 1.96 * sigma', 2)} AS lower_bound FROM v""")
def _(t):
    best = forecast.best_model(forecast.fit_trends(daily(t)))
    return rounded(forecast.forecast(best, 6).select("step", "predicted", "upper_bound", "lower_bound"), 2)


@query("fc05_date_labels", f"""WITH {DAILY}, e AS (SELECT max(day) AS last, (SELECT max(day) FROM d WHERE day < (SELECT max(day) FROM d)) AS prev FROM d)
SELECT CAST(step AS INT) AS step, strftime(last + CAST((last - prev) * step AS INT), '%Y-%m-%d') AS label FROM e, (SELECT unnest(range(1, 7)) AS step)""")
def _(t):
    points = daily(t)
    future = forecast.forecast(forecast.best_model(forecast.fit_trends(points)), 6)
    return forecast.date_labels(future, forecast.last_dates(points, "day")).select("step", "label")


_DIRECTION = "CASE WHEN c > 2 THEN 'upward' WHEN c < -2 THEN 'downward' ELSE 'stable' END AS direction"


@query("fc06_trend_direction", f"""WITH {TYPED}, e AS (SELECT event_type, count(*) AS n, arg_min(y, t) AS a, arg_max(y, t) AS b FROM p GROUP BY 1),
c AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE (b - a) * 100 / abs(a) END AS c FROM e)
SELECT event_type, n, a AS first, b AS last, {r('c')} AS pct_change, {_DIRECTION} FROM c""")
def _(t):
    return rounded(forecast.trend_direction(typed(t), ["event_type"]))


@query("fc07_prediction_interval", f"""WITH {DAILY},
l AS (SELECT count(*) AS n, regr_slope(y, t) AS m, regr_intercept(y, t) AS c, regr_sxx(y, t) AS sxx, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) AS sse FROM p),
v AS (SELECT step, c + m * (n - 1 + step) AS v, 1.96 * sqrt(sse / (n - 2)) * sqrt(1 + 1.0 / n + pow(n - 1 + step - (n - 1) / 2.0, 2) / sxx) AS w FROM l, (SELECT unnest(range(1, 6)) AS step))
SELECT CAST(step AS INT) AS step, {r('v', 2)} AS predicted, {r('v - w', 2)} AS lower_bound, {r('v + w', 2)} AS upper_bound FROM v""")
def _(t):
    return rounded(forecast.interval_forecast(forecast.fit_trends(daily(t)), 5).select("step", "predicted", "lower_bound", "upper_bound"), 2)


@query("fc08_fitted_history", f"""WITH {DAILY}, {quad_sql('')},
g AS (SELECT *, {_BEST} = 'poly' AS q FROM f),
v AS (SELECT day, t, y, CASE WHEN q THEN mean + lift + slope * ((t - center) / scale) + curve * ((t - center) / scale) * ((t - center) / scale) ELSE mean + slope * ((t - center) / scale) END AS v,
  sqrt(CASE WHEN q THEN sse2 ELSE sse1 END / n) AS sigma, greatest(1, n // 60) AS stride FROM p, g)
SELECT day, t, {r('y', 2)} AS y, {r('v', 2)} AS trend, {r('v + sigma', 2)} AS upper_band, {r('v - sigma', 2)} AS lower_band FROM v WHERE t % stride = 0""")
def _(t):
    points = daily(t)
    best = forecast.best_model(forecast.fit_trends(points))
    return rounded(forecast.fitted_history(points, best).select("day", "t", "y", "trend", "upper_band", "lower_band"), 2)


@query("fc09_detect_axes", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT 'n_orders' AS value_column, 'o_orderdate' AS date_column, count(*) AS n, {r('regr_slope(n_orders, t)', 6)} AS per_step FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS t FROM d)""")
def _(t):
    table = t("orders").groupBy(F.col("o_orderdate").cast("date").alias("o_orderdate")).agg(F.count(F.lit(1)).alias("n_orders"))
    value, when = forecast.detect_axes(table)
    fits = forecast.trend_table(forecast.fit_trends(forecast.series(table, [when], value)).filter("model = 'linear'"))
    return fits.select(F.lit(value).alias("value_column"), F.lit(when).alias("date_column"), "n", F.round("per_step", 6).alias("per_step"))
