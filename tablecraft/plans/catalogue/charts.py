"""Chart aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import charts
from tablecraft.plans.catalogue.registry import query, r, rounded
from tablecraft.plans.catalogue.tables import NUM, SCALED


def shipped(t):
    """Line items with the order priority and customer segment: the star the charts read."""
    items = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "l_linestatus")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    people = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).join(people, F.col("o_custkey") == F.col("c_custkey"))


SHIPPED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"

for _agg, _sql in (("count", "count(l_quantity)"), ("sum", "sum(l_quantity)"), ("mean", "avg(l_quantity)"),
                   ("median", "quantile_cont(l_quantity, 0.5)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)")):
    def _grouped(t, agg=_agg):
        return rounded(charts.group_measure(t("lineitem"), "l_suppkey", "l_quantity", agg))

    _value = _sql if _agg == "count" else r(_sql)
    query(f"ag01_groupby_{_agg}", f"SELECT l_suppkey, {_value} AS value FROM lineitem GROUP BY l_suppkey ORDER BY {_sql} DESC, l_suppkey LIMIT 25")(_grouped)


@query("ag01_groupby_text_measure", f"""
SELECT segment, {r(f"avg({NUM.format('balance_text')})")} AS value FROM dirty_customer WHERE segment IS NOT NULL
GROUP BY segment ORDER BY 2 DESC, 1 LIMIT 25""")
def _(t):
    return rounded(charts.group_measure(t("dirty_customer"), "segment", "balance_text", "average?"))


@query("ag01_groupby_rows", "SELECT priority, count(*) AS value FROM dirty_orders WHERE priority IS NOT NULL GROUP BY priority ORDER BY 2 DESC, 1 LIMIT 25")
def _(t):
    return charts.group_measure(t("dirty_orders"), "priority")


for _agg in ("SUM", "AVG", "COUNT", "MIN", "MAX"):
    _expr = f"{_agg.lower()}(l_extendedprice)"

    def _chart(t, agg=_agg):
        out = charts.chart_query(shipped(t), "c_mktsegment", "l_extendedprice", agg, group_by="l_returnflag")
        return rounded(out, 2)

    _value = _expr if _agg == "COUNT" else r(_expr, 2)
    query(f"ag02_chart_{_agg.lower()}", f"SELECT c_mktsegment, l_returnflag, {_value} AS value FROM {SHIPPED} GROUP BY 1, 2 ORDER BY {_expr} DESC, 1, 2 LIMIT 25")(_chart)


@query("ag03_dual_measure", f"""
SELECT o_orderpriority, {r('sum(l_extendedprice)', 2)} AS value, {r('sum(l_quantity)', 2)} AS line_value
FROM {SHIPPED} GROUP BY 1""")
def _(t):
    return rounded(charts.chart_query(shipped(t), "o_orderpriority", "l_extendedprice", "SUM", line_y="l_quantity"), 2)


@query("ag04_count_fallback", "SELECT o_orderpriority, count(o_orderstatus) AS value FROM orders GROUP BY 1")
def _(t):
    return charts.chart_query(t("orders"), "o_orderpriority", "o_orderstatus", "SUM")


for _agg in ("SUM", "AVG", "COUNT", "MIN", "MAX"):
    def _kpi(t, agg=_agg):
        return rounded(charts.kpi(t("lineitem"), "l_extendedprice", agg), 2)

    _expr = f"{_agg.lower()}(l_extendedprice)"
    query(f"ag05_kpi_{_agg.lower()}", f"SELECT {_expr if _agg == 'COUNT' else r(_expr, 2)} AS value FROM lineitem")(_kpi)


@query("ag06_value_counts", f"""
SELECT segment AS value, count(*) AS count, {r('count(*) * 100.0 / (SELECT count(segment) FROM dirty_customer)')} AS share_pct
FROM dirty_customer WHERE segment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return rounded(charts.value_counts(t("dirty_customer"), "segment", 10))


def _hist_sql(table: str, column: str, bins: str) -> str:
    return f"""
WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL),
s AS (SELECT min(v) AS lo, max(v) AS hi, {bins} AS n FROM v),
c AS (SELECT least(CAST(floor((v - lo) * n / (hi - lo)) AS INT), CAST(n - 1 AS INT)) AS bin, count(*) AS count FROM v, s GROUP BY 1),
b AS (SELECT CAST(unnest(range(n)) AS INT) AS bin, lo, hi, n FROM s)
SELECT b.bin, {r('lo + b.bin * ((hi - lo) / n)', 6)} AS bin_start, {r('lo + (b.bin + 1) * ((hi - lo) / n)', 6)} AS bin_end, coalesce(count, 0) AS count
FROM b LEFT JOIN c ON b.bin = c.bin"""


@query("ag07_histogram", _hist_sql("orders", "o_totalprice", "least(20, count(DISTINCT v))"))
def _(t):
    return rounded(charts.histogram(t("orders"), "o_totalprice"), 6)


@query("ag07_histogram_few_values", _hist_sql("lineitem", "l_linenumber", "least(20, count(DISTINCT v))"))
def _(t):
    return rounded(charts.histogram(t("lineitem"), "l_linenumber"), 6)


@query("ag07_histogram_stats", f"""
SELECT {r('avg(amount)')} AS mean, {r('quantile_cont(amount, 0.5)')} AS median, {r('min(amount)')} AS min, {r('max(amount)')} AS max,
  {r('stddev_samp(amount)')} AS std, {r('quantile_cont(amount, 0.25)')} AS q1, {r('quantile_cont(amount, 0.75)')} AS q3,
  count(amount) AS count, count(*) - count(amount) AS missing, count(DISTINCT amount) AS "unique" FROM dirty_orders""")
def _(t):
    return rounded(charts.histogram_stats(t("dirty_orders"), "amount"))


@query("ag08_chart_histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) * 10 / (hi - lo)) AS INT), 9) AS bin, count(*) AS count FROM lineitem, s GROUP BY 1),
e AS (SELECT bin, count, lo + bin * ((hi - lo) / 10) AS a, lo + (bin + 1) * ((hi - lo) / 10) AS b FROM c, s)
SELECT CASE WHEN round(a, 1) = floor(round(a, 1)) AND round(b, 1) = floor(round(b, 1)) THEN printf('%d - %d', CAST(round(a, 1) AS BIGINT), CAST(round(b, 1) AS BIGINT))
  ELSE printf('%.1f - %.1f', round(a, 1), round(b, 1)) END AS label, count, round(a, 6) + 0.0 AS bin_start, round(b, 6) + 0.0 AS bin_end FROM e""")
def _(t):
    return rounded(charts.chart_histogram(t("lineitem"), "l_extendedprice"), 6)


@query("ag08_chart_histogram_text", "SELECT c_mktsegment AS label, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return charts.chart_histogram(t("customer"), "c_mktsegment")


@query("ag09_eight_bins", _hist_sql("events", "value", "8"))
def _(t):
    return rounded(charts.histogram(t("events"), "value", bins=8), 6)


def _box_sql(key: str, value: str, table: str, label: str) -> str:
    return f"""
WITH q AS (SELECT {key} AS k, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM {table} GROUP BY 1),
f AS (SELECT q.*, x.{value} AS v, x.{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {table} x JOIN q ON {key} = k)
SELECT k AS {label}, {r('coalesce(min(CASE WHEN inside THEN v END), min(v))')} AS min, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r('coalesce(max(CASE WHEN inside THEN v END), max(v))')} AS max, {r('avg(v)')} AS mean, count(*) FILTER (WHERE NOT inside) AS n_outliers,
  coalesce(list_slice(list_sort(list(v) FILTER (WHERE NOT inside)), 1, 10), CAST([] AS DOUBLE[])) AS outliers
FROM f GROUP BY k, q1, median, q3"""


@query("ag10_box_plot", _box_sql("event_type", "value", "events", "event_type"))
def _(t):
    return rounded(charts.box_plot(t("events"), "value", "event_type"))


@query("ag11_box_plot_overall", _box_sql("'Overall'", "value", "events", '"group"'))
def _(t):
    return rounded(charts.box_plot(t("events"), "value"))


@query("ag12_five_numbers", f"""
SELECT {r('min(o_totalprice)')} AS min, {r('quantile_cont(o_totalprice, 0.25)')} AS q1, {r('quantile_cont(o_totalprice, 0.5)')} AS median,
  {r('quantile_cont(o_totalprice, 0.75)')} AS q3, {r('max(o_totalprice)')} AS max FROM orders""")
def _(t):
    return rounded(charts.five_numbers(t("orders"), "o_totalprice"))


@query("ag13_waterfall", f"""
WITH e AS (SELECT c_nationkey AS x, sum(c_acctbal) AS value FROM customer GROUP BY 1), g AS (SELECT * FROM e ORDER BY 1 LIMIT 15),
w AS (SELECT CAST(x AS VARCHAR) AS label, value, sum(value) OVER (ORDER BY x) AS run FROM g),
a AS (SELECT (SELECT sum(value) FROM g) AS shown, sum(value) AS value, count(*) AS keys FROM e)
SELECT label, {r('value', 2)} AS value, {r('run - value', 2)} AS start, {r('run', 2)} AS "end",
  CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS type FROM w
UNION ALL SELECT 'Remaining', {r('value - shown', 2)}, {r('shown', 2)}, {r('value', 2)}, CASE WHEN value >= shown THEN 'positive' ELSE 'negative' END FROM a WHERE keys > 15
UNION ALL SELECT 'Net Total', {r('value', 2)}, 0.0, {r('value', 2)}, 'total' FROM a""")
def _(t):
    return rounded(charts.waterfall(t("customer"), "c_nationkey", "c_acctbal"), 2)


@query("ag14_funnel", f"""
WITH g AS (SELECT p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT p_brand, {r('v', 2)} AS value, {r('v * 100 / (SELECT max(v) FROM g)', 2)} AS percentage FROM g""")
def _(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(charts.funnel(rows, "p_brand", "l_extendedprice"), 2)


@query("ag14_funnel_counts", f"""
WITH g AS (SELECT event_type, count(*) AS v FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT event_type, v AS value, {r('v * 100.0 / (SELECT max(v) FROM g)')} AS percentage FROM g""")
def _(t):
    return rounded(charts.funnel(t("events"), "event_type"))


@query("ag15_treemap", f"""
WITH g AS (SELECT p_brand, p_size, sum(p_retailprice) AS v FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25)
SELECT p_brand, p_size, {r('v', 2)} AS value, {r('v * 100 / (SELECT sum(v) FROM g)')} AS share FROM g""")
def _(t):
    out = charts.treemap(t("part"), "p_brand", "p_retailprice", "p_size")
    return out.select("p_brand", "p_size", F.round("value", 2).alias("value"), F.round("share", 4).alias("share"))


@query("ag16_gauge", f"""
WITH g AS (SELECT sum(o_totalprice) AS c, avg(o_totalprice) AS a FROM orders)
SELECT {r('c', 2)} AS current, {r('c * 1.25', 2)} AS target, CAST(0 AS DOUBLE) AS min, {r('c * 1.25 * 1.2', 2)} AS max, {r('80', 2)} AS percentage, {r('a', 2)} AS average FROM g""")
def _(t):
    return rounded(charts.gauge(t("orders"), "o_totalprice"), 2)


@query("ag17_geo_map", f"""
SELECT n_name, {r('sum(c_acctbal)', 2)} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 30""")
def _(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(charts.geo_map(rows, "n_name", "c_acctbal"), 2)


@query("ag19_stacked_shares", f"""
WITH g AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, {r('v', 2)} AS value, {r('abs(v) * 100 / sum(abs(v)) OVER (PARTITION BY c_nationkey)')} AS share FROM g""")
def _(t):
    out = charts.stacked_shares(t("customer"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return out.select("c_nationkey", "c_mktsegment", F.round("value", 2).alias("value"), F.round("share", 4).alias("share"))


@query("ag20_series_matrix", f"""
SELECT o_orderstatus, {", ".join(f"coalesce({r(f'sum(o_totalprice) FILTER (WHERE o_orderpriority = {chr(39)}{p}{chr(39)})', 2)}, 0.0) AS {chr(34)}{p}{chr(34)}"
  for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM orders GROUP BY 1""")
def _(t):
    return rounded(charts.series_matrix(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), 2)


@query("ag22_common_prefix", f"""
SELECT substr(concat('Order Priority ', o_orderpriority), 1, 15) AS label, concat('Order Priority ', o_orderpriority) AS full_label, {r('sum(o_totalprice)', 2)} AS value
FROM orders GROUP BY 1, 2 ORDER BY sum(o_totalprice) DESC, 2 LIMIT 12""")
def _(t):
    rows = t("orders").withColumn("name", F.concat(F.lit("Order Priority "), "o_orderpriority"))
    return rounded(charts.label_totals(rows, "name", "o_totalprice"), 2)


@query("ag20_fifty_series", f"""
SELECT l_returnflag, {", ".join(f"coalesce({r(f'sum(l_extendedprice) FILTER (WHERE l_quantity = {q})', 2)}, 0.0) AS {chr(34)}{q}{chr(34)}" for q in range(1, 51))}
FROM lineitem GROUP BY 1""")
def _(t):
    rows = t("lineitem").withColumn("quantity", F.col("l_quantity").cast("int"))
    return rounded(charts.series_matrix(rows, "l_returnflag", "quantity", "l_extendedprice"), 2)


@query("ag21_bubble_radius", f"""
SELECT s_suppkey, {r('4 + (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) * 21')} AS radius FROM supplier""")
def _(t):
    return rounded(charts.bubble_radius(t("supplier"), "s_acctbal").select("s_suppkey", "radius"))


@query("ag22_label_totals", f"""
SELECT substr(coalesce(active, 'Unknown'), 1, 2) AS label, coalesce(active, 'Unknown') AS full_label, {r(f"coalesce(sum({SCALED.format('balance_text')}), 0)", 2)} AS value
FROM dirty_customer GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 12""")
def _(t):
    return rounded(charts.label_totals(t("dirty_customer"), "active", "balance_text", width=2), 2)


@query("ag22_label_counts", "SELECT substr(coalesce(active, 'Other'), 1, 15) AS label, coalesce(active, 'Other') AS full_label, count(*) AS value FROM dirty_customer GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 8")
def _(t):
    return charts.label_totals(t("dirty_customer"), "active", k=8, null_label="Other")


@query("ag23_line_points", f"SELECT order_ts, {r('amount', 2)} AS value, order_id FROM dirty_orders WHERE amount IS NOT NULL ORDER BY order_ts, order_id LIMIT 40")
def _(t):
    return rounded(charts.line_points(t("dirty_orders"), "order_ts", "amount", ["order_id"]), 2)


@query("ag24_point_pairs", "SELECT amount AS x, CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS y FROM dirty_orders WHERE amount IS NOT NULL AND NOT isnan(ratio)")
def _(t):
    from tablecraft.operators.missing import nan_to_null

    return charts.point_pairs(nan_to_null(t("dirty_orders")), "amount", "ratio")


_SUMMARY = f"""
SELECT count(*) AS categories, {r('sum(v)', 2)} AS total, {r('avg(v)', 2)} AS mean, arg_max(k, v) AS top, {r('max(v)', 2)} AS top_value,
  arg_min(k, v) AS bottom, {r('min(v)', 2)} AS bottom_value, {r('max(v) - min(v)', 2)} AS range,
  {r('count(*) FILTER (WHERE v >= (SELECT avg(v) FROM g)) * 100.0 / count(*)', 2)} AS above_mean_pct,
  {r('max(v) * 100 / sum(v)', 2)} AS top_share_pct, {r('min(v) * 100 / sum(v)', 2)} AS bottom_share_pct FROM g"""


@query("ag25_chart_summary", f"""
WITH g AS (SELECT o_orderpriority AS k, sum(l_extendedprice) AS v FROM {SHIPPED} GROUP BY 1) {_SUMMARY}""")
def _(t):
    points = charts.chart_query(shipped(t), "o_orderpriority", "l_extendedprice")
    return rounded(charts.chart_summary(points, "o_orderpriority", "value"), 2)


@query("ag26_multi_chart_summary", f"""
WITH p AS (SELECT 'priority' AS chart, o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 2
  UNION ALL SELECT 'segment', c_mktsegment, sum(c_acctbal) FROM customer GROUP BY 2),
c AS (SELECT chart, count(*) AS points, sum(v) AS total, avg(v) AS mean, arg_max(k, v) AS top, max(v) AS top_value FROM p GROUP BY 1)
SELECT chart, points, {r('total', 2)} AS total, {r('mean', 2)} AS mean, top, {r('top_value', 2)} AS top_value,
  {r('sum(total) OVER ()', 2)} AS grand_total, top_value = max(top_value) OVER () AS is_overall_top FROM c""")
def _(t):
    a = charts.chart_query(t("orders"), "o_orderpriority", "o_totalprice")
    b = charts.chart_query(t("customer"), "c_mktsegment", "c_acctbal")
    return rounded(charts.multi_chart_summary({"priority": (a, "o_orderpriority", "value"), "segment": (b, "c_mktsegment", "value")}), 2)


_ORDER_COLUMNS = ("order_id", "cust_id", "order_ts", "amount", "priority", "ratio", "const_col", "empty_col")


@query("ag27_distinct_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM dirty_orders" for c in _ORDER_COLUMNS))
def _(t):
    return charts.distinct_counts(t.wide("dirty_orders"))


