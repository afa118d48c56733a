"""Profile, quality, suggestion, correlation and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import diagnostics, missing, profile, recommend, statistics, texts
from tablecraft.plans.catalogue.cleaning import _DIRTY_CELLS, date_sql, dominant_sql
from tablecraft.plans.catalogue.registry import query, r, rounded
from tablecraft.plans.catalogue.tables import SCALED, TRIM

FINITE = "o AS (SELECT * REPLACE (CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio) FROM dirty_orders)"
ORDER_COLUMNS = ("order_id", "cust_id", "order_ts", "amount", "priority", "ratio", "const_col", "empty_col")
ORDER_NUMBERS = ("order_id", "cust_id", "amount", "ratio", "const_col", "empty_col")


def finite_orders(t):
    return missing.nan_to_null(t.wide("dirty_orders"))


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def skew_sql(c: str) -> str:
    return f"CASE WHEN count({c}) > 2 AND var_pop({c}) > 0 THEN skewness({c}) END"


def stats_sql(c: str, table: str) -> str:
    """Select list of the number figures of one column; needs a one-row CTE ``q_<c>`` (q1, med, q3)."""
    v = f"CAST({c} AS DOUBLE)"
    return f"""count({v}) AS count, {r(f'avg({v})')} AS mean, {r(f'quantile_cont({v}, 0.5)')} AS median, {r(f'min({v})')} AS min, {r(f'max({v})')} AS max,
  {r(f'stddev_samp({v})')} AS std, {r(f'var_samp({v})', 2)} AS variance, {r(f'quantile_cont({v}, 0.25)')} AS q1, {r(f'quantile_cont({v}, 0.75)')} AS q3,
  {r(f'quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)')} AS iqr, {r(skew_sql(v))} AS skewness,
  count(*) FILTER (WHERE {v} = 0) AS zero_count, count(*) FILTER (WHERE {v} < 0) AS negative_count,
  (SELECT count(*) FROM {table}, (SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM {table}) WHERE {v} < a - 1.5 * (b - a) OR {v} > b + 1.5 * (b - a)) AS outlier_count"""


def _stats_rounded(df):
    """Four digits, two for variances."""
    return rounded(df.withColumn("variance", F.round("variance", 2))) if "variance" in df.columns else rounded(df)


# Profiles ------------------------------------------------------------------------------------------

def _meta_sql(c: str) -> str:
    label = {"order_ts": "Datetime", "priority": "Text"}.get(c, "Integer" if c in ("order_id", "cust_id", "const_col") else "Float")
    number = c in ORDER_NUMBERS
    top = "CAST(NULL AS VARCHAR)" if number else f"(SELECT CAST({c} AS VARCHAR) FROM o WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    figures = [f"{r(f.format(c=c))}" if number else "CAST(NULL AS DOUBLE)" for f in (
        "avg({c})", "quantile_cont({c}, 0.5)", "min({c})", "max({c})", "stddev_samp({c})")]
    return f"""SELECT '{c}' AS "column", '{label}' AS type, count(*) AS "rows", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct,
  count(DISTINCT {c}) AS "unique", {top} AS top, {figures[0]} AS mean, {figures[1]} AS median, {figures[2]} AS min, {figures[3]} AS max, {figures[4]} AS std FROM o"""


@query("pr01_metadata_profile", f"WITH {FINITE} {union(map(_meta_sql, ORDER_COLUMNS))}")
def _(t):
    return rounded(profile.metadata_profile(finite_orders(t)))


WIDE = """w AS (SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS priority, CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'No' END AS is_open FROM orders)"""


def wide_orders(t):
    return t.wide("orders").select(
        F.col("o_orderkey").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("No").alias("is_open"))


_KIND = {"order_id": "id_like", "order_date": "datetime", "amount": "numeric", "priority": "categorical", "is_open": "boolean"}
_NO_STATS = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "median", "min", "max", "std", "variance", "q1", "q3", "iqr", "skewness")) + \
    ", " + ", ".join(f"CAST(NULL AS BIGINT) AS {n}" for n in ("zero_count", "negative_count", "outlier_count"))


def _full_sql(c: str) -> str:
    stats = stats_sql(c, "w").replace(f"count(CAST({c} AS DOUBLE)) AS count, ", "", 1) if c == "amount" else _NO_STATS
    dates = "min(order_date) AS min_date, max(order_date) AS max_date, CAST(datediff('day', CAST(min(order_date) AS DATE), CAST(max(order_date) AS DATE)) AS INT) AS range_days" \
        if c == "order_date" else "CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date, CAST(NULL AS INT) AS range_days"
    flags = "count(*) FILTER (WHERE lower(is_open) = 'yes') AS true_count, count(*) FILTER (WHERE lower(is_open) = 'no') AS false_count" \
        if c == "is_open" else "CAST(NULL AS BIGINT) AS true_count, CAST(NULL AS BIGINT) AS false_count"
    return f"""SELECT '{c}' AS "column", '{_KIND[c]}' AS semantic_type, count(*) AS "rows", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {stats}, {dates}, {flags} FROM w"""


@query("pr02_full_profile", f"WITH {WIDE} {union(map(_full_sql, _KIND))}")
def _(t):
    return _stats_rounded(profile.full_profile(wide_orders(t)))


@query("pr02_top_categories", f"WITH {WIDE}, " + f"""
c AS ({union(f"SELECT '{c}' AS k, {c} AS value FROM w" for c in ("order_date", "priority", "is_open"))}),
g AS (SELECT k, value, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, value) AS rank FROM c GROUP BY 1, 2)
SELECT k AS "column", CAST(rank AS INT) AS rank, value, n AS count, {r('n * 100.0 / (SELECT count(*) FROM w)')} AS percentage FROM g WHERE rank <= 10""".strip())
def _(t):
    return rounded(profile.top_categories(wide_orders(t)))


@query("pr03_structure_issues", """
SELECT 'empty_rows' AS issue, '*' AS "column", 0 AS count
UNION ALL SELECT 'empty_column', 'empty_col', count(*) FROM dirty_orders HAVING count(empty_col) = 0
UNION ALL SELECT 'constant_column', 'empty_col', count(*) FROM dirty_orders HAVING count(DISTINCT empty_col) <= 1
UNION ALL SELECT 'constant_column', 'const_col', count(*) FROM dirty_orders HAVING count(DISTINCT const_col) <= 1
UNION ALL SELECT 'constant_column', 'priority', count(*) FROM dirty_orders HAVING count(DISTINCT priority) <= 1""")
def _(t):
    return profile.structure_issues(t.wide("dirty_orders"))


def browser_sql(cell: str) -> str:
    """CTE ``pro``: one row per column with everything the browser profile holds."""
    t = TRIM.format("value")
    return dominant_sql(cell) + f""",
ws AS (SELECT "column", count(*) FILTER (WHERE {t} <> value) AS whitespace FROM c WHERE has GROUP BY 1),
cv AS (SELECT "column", count(*) FILTER (WHERE ways > 1) AS casing_groups FROM (
  SELECT "column", lower({t}) AS g, count(DISTINCT {t}) AS ways FROM c WHERE has GROUP BY 1, 2) GROUP BY 1),
num AS (SELECT "column", {SCALED.format('value')} AS v FROM c WHERE has AND type IN ('integer', 'float', 'currency', 'percentage')),
rk AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n FROM num WHERE v IS NOT NULL),
st AS (SELECT "column", max(n) AS numbers, min(v) AS min, max(v) AS max, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std_pop,
  max(v) FILTER (WHERE i = floor(n * 0.25)) AS q1, max(v) FILTER (WHERE i = floor(n * 0.75)) AS q3 FROM rk GROUP BY 1 HAVING count(*) >= 2),
ol AS (SELECT "column", count(*) FILTER (WHERE n >= 4 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS outliers FROM rk JOIN st USING ("column") GROUP BY 1),
pro AS (SELECT dom.*, coalesce(whitespace, 0) AS whitespace, coalesce(casing_groups, 0) AS casing_groups, coalesce(numbers, 0) AS numbers, min, max, mean, median, std_pop,
  coalesce(outliers, 0) AS outliers, coalesce(min < 0, false) AND regexp_matches("column", '(?i)(age|salary|price|revenue|cost|quantity|sales|units|count|score)') AS suspicious_negatives
  FROM dom LEFT JOIN ws USING ("column") LEFT JOIN cv USING ("column") LEFT JOIN st USING ("column") LEFT JOIN ol USING ("column"))"""


@query("pr04_browser_profile", f"""WITH {browser_sql(_DIRTY_CELLS).strip()}
SELECT * REPLACE ({r('min')} AS min, {r('max')} AS max, {r('mean')} AS mean, {r('median')} AS median, {r('std_pop')} AS std_pop) FROM pro""")
def _(t):
    return rounded(profile.browser_profile(t.wide("dirty_customer")))


@query("pr05_server_problems", f"""WITH {WIDE},
q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM w)
SELECT * FROM (
  SELECT 'missing_values' AS type, 'amount' AS "column", CASE WHEN round((count(*) - count(amount)) * 100.0 / count(*), 2) > 30 THEN 'high' ELSE 'medium' END AS severity, count(*) - count(amount) AS count FROM w
  UNION ALL SELECT 'outliers', 'amount', 'medium', (SELECT count(*) FROM w, q WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a))
  UNION ALL SELECT 'whitespace', 'priority', 'low', count(*) FILTER (WHERE regexp_matches(priority, '^\\s+|\\s+$|\\s{{2,}}')) FROM w
  UNION ALL SELECT 'duplicate_rows', NULL, 'medium', CAST(0 AS BIGINT)) WHERE count > 0""")
def _(t):
    return profile.server_problems(wide_orders(t))


_PROBLEMS = f"""
SELECT type, "column", severity, CAST(count AS BIGINT) AS count FROM (
  SELECT 'missing_values' AS type, "column", CASE WHEN nulls > 0.3 * "rows" THEN 'high' ELSE 'medium' END AS severity, nulls AS count FROM pro WHERE nulls > 0
  UNION ALL SELECT 'whitespace', "column", 'low', whitespace FROM pro WHERE whitespace > 0
  UNION ALL SELECT 'currency_format', "column", 'medium', n_currency FROM pro WHERE n_currency > 0 AND dominant_type <> 'text'
  UNION ALL SELECT 'inconsistent_categories', "column", 'medium', casing_groups FROM pro WHERE casing_groups > 0
  UNION ALL SELECT 'outliers', "column", 'low', outliers FROM pro WHERE outliers > 0
  UNION ALL SELECT 'suspicious_value', "column", 'high', 1 FROM pro WHERE suspicious_negatives
  UNION ALL SELECT 'empty_column', "column", 'high', "rows" FROM pro WHERE nulls = "rows"
  UNION ALL SELECT 'duplicate_rows', NULL, 'high', d FROM dup WHERE d > 0)"""
_DOUBLED_CELLS = _DIRTY_CELLS.replace("dirty_customer", "doubled_customer")
_DUP = f"""dup AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS d FROM (SELECT count(*) AS n FROM doubled_customer
  GROUP BY cust_id, {TRIM.format("coalesce(name, '')")}, {TRIM.format("coalesce(segment, '')")}, {TRIM.format("coalesce(balance_text, '')")}, email, coalesce(active, '')))"""


@query("pr05_browser_problems", f"WITH {browser_sql(_DOUBLED_CELLS).strip()}, {_DUP} {_PROBLEMS}")
def _(t):
    return profile.browser_problems(t.wide("doubled_customer"))


@query("pr06_score_server", f"""WITH {WIDE},
q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM w),
f AS (SELECT count(*) AS "rows", count(*) - count(amount) AS nulls, 0 AS duplicates,
  CASE WHEN round((count(*) - count(amount)) * 100.0 / count(*), 2) > 0 THEN 1 ELSE 0 END
  + CASE WHEN (SELECT count(*) FROM w, q WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a)) > 0 THEN 1 ELSE 0 END
  + CASE WHEN count(*) FILTER (WHERE regexp_matches(priority, '^\\s+|\\s+$|\\s{{2,}}')) > 0 THEN 1 ELSE 0 END AS problems FROM w)
SELECT "rows", nulls, CAST(duplicates AS BIGINT) AS duplicates, CAST(problems AS BIGINT) AS problems,
  CAST(greatest(5, round(100 - least(40, round(nulls * 100.0 / ("rows" * 5), 2) * 1.5) - least(25, duplicates * 50.0 / "rows") - least(15, problems * 2))) AS INT) AS score FROM f""")
def _(t):
    return profile.quality_score(wide_orders(t), "server")


@query("pr06_score_browser", f"""WITH {browser_sql(_DOUBLED_CELLS).strip()}, {_DUP},
s AS (SELECT max("rows") AS n, CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(whitespace) AS BIGINT) AS whitespace, count(*) FILTER (WHERE is_mixed) AS mixed, CAST(sum(outliers) AS BIGINT) AS outliers FROM pro)
SELECT n AS "rows", nulls, d AS duplicates, mixed, whitespace, outliers, CAST(greatest(10, least(100, round(100 - least(30, nulls * 80.0 / (n * 6)) - least(25, d * 60.0 / n)
  - least(15, mixed * 5) - least(10, whitespace * 40.0 / (n * 6)) - least(10, outliers)))) AS INT) AS score FROM s, dup""")
def _(t):
    return profile.quality_score(t.wide("doubled_customer"), "browser")


def _column_stats_sql(c: str) -> str:
    if c == "priority":
        return f"""SELECT '{c}' AS "column", 'categorical' AS type, count({c}) AS count, {", ".join("CAST(NULL AS DOUBLE) AS " + n for n in ("mean", "median", "min", "max", "range", "variance", "std", "q1", "q3", "iqr", "skewness"))},
  count(DISTINCT {c}) AS unique_count, (SELECT {c} FROM o WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_text, CAST(NULL AS DOUBLE) AS mode_number FROM o"""
    return f"""SELECT '{c}' AS "column", 'numeric' AS type, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
  {r(f'max({c}) - min({c})')} AS range, {r(f'var_samp({c})', 2)} AS variance, {r(f'stddev_samp({c})')} AS std, {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'quantile_cont({c}, 0.75)')} AS q3,
  {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr, {r(skew_sql(c))} AS skewness, CAST(NULL AS BIGINT) AS unique_count, CAST(NULL AS VARCHAR) AS mode_text,
  {r(f'(SELECT {c} FROM o WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)')} AS mode_number FROM o"""


@query("pr07_column_statistics", f"WITH {FINITE} {union(map(_column_stats_sql, ('amount', 'ratio', 'priority')))}")
def _(t):
    return _stats_rounded(profile.column_statistics(finite_orders(t), ["amount", "ratio", "priority", "nope"]))


@query("pr08_entropy", f"""WITH c AS ({union(f"SELECT '{c}' AS k, {c} AS v, count(*) AS n FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY 2" for c in ("name", "segment", "balance_text", "email", "active"))}),
p AS (SELECT k, n * 1.0 / sum(n) OVER (PARTITION BY k) AS p FROM c)
SELECT k AS "column", count(*) AS levels, {r('-sum(p * log2(p))')} AS bits, CASE WHEN -sum(p * log2(p)) > 2.5 THEN 'Uniform / High Diversity' ELSE 'Imbalanced / Low Diversity' END AS balance FROM p GROUP BY 1""")
def _(t):
    return rounded(profile.entropy(t.wide("dirty_customer")))


def _pop_skew(c: str) -> str:
    return f"skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1))"


@query("pr09_normality", f"""WITH n AS ({union(f"SELECT '{c}' AS k, count({c}) AS n, {_pop_skew(c)} AS s, kurtosis_pop({c}) AS u FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))})
SELECT k AS "column", n, {r('s')} AS skewness, {r('u')} AS kurtosis, CASE WHEN abs(s) < 0.5 AND abs(u) < 1 THEN 'Gaussian-like' WHEN s > 0.5 THEN 'Right-Skewed' ELSE 'Left-Skewed' END AS shape FROM n""")
def _(t):
    return rounded(profile.normality(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_MEASURES = ("price", "double_price", "quantity", "discount")


def _measures(t):
    return t("lineitem").select(F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * 2 + F.col("l_tax")).alias("double_price"),
                                F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


_M = "m AS (SELECT l_extendedprice AS price, l_extendedprice * 2 + l_tax AS double_price, l_quantity AS quantity, l_discount AS discount FROM lineitem)"
_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]


@query("pr10_multicollinearity", f"""WITH {_M}, p AS ({union(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM m" for a, b in _PAIRS)})
SELECT a, b, {r('r')} AS correlation FROM p WHERE r > 0.85""")
def _(t):
    return rounded(profile.multicollinearity(_measures(t)))


@query("pr11_smart_analytics", f"""WITH {browser_sql(_DOUBLED_CELLS).strip()}, {_DUP},
tops AS (SELECT "column", {TRIM.format('value')} AS v, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, {TRIM.format('value')}) AS i FROM c WHERE has GROUP BY 1, 2)
SELECT type, subject, CAST(value AS DOUBLE) AS value, detail FROM (
  SELECT 'outliers' AS type, "column" AS subject, outliers AS value, 'outside IQR bounds' AS detail FROM pro WHERE outliers > 0 AND dominant_type IN ('numeric', 'currency', 'percentage') AND min IS NOT NULL
  UNION ALL SELECT 'distribution', t."column", round(t.n * 100.0 / p."rows"), t.v FROM tops t JOIN pro p ON t."column" = p."column"
    WHERE t.i = 1 AND p.dominant_type IN ('categorical', 'binary') AND round(t.n * 100.0 / p."rows") >= 50
  UNION ALL SELECT 'duplicates', '*', d, 'duplicate rows' FROM dup WHERE d > 0)""")
def _(t):
    return profile.smart_analytics(t.wide("doubled_customer"))


def _facts_sql(table: str, columns: dict[str, str]) -> str:
    """CTE ``facts``: column -> number, date or text."""
    parts = []
    for i, (c, family) in enumerate(columns.items(), start=1):
        dates = f"(SELECT count(*) FROM {table} WHERE {date_sql(f'CAST({c} AS VARCHAR)')} IS NOT NULL AND length(CAST({c} AS VARCHAR)) >= 6)"
        kind = f"CASE WHEN {dates} > 0.7 * count(*) THEN 'date' ELSE 'text' END" if family == "text" else f"'{family}'"
        binary = f"count(DISTINCT {c}) <= 2 AND coalesce(bool_and({c} IN (0, 1)), true)" if family == "number" else "false"
        parts.append(f"""SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS position, count(*) AS "rows", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS d, {kind} AS family, {binary} AS is_binary FROM {table}""")
    return f"""facts AS ({union(parts)}),
kinds AS (SELECT *, CASE WHEN round(missing * 100.0 / greatest("rows", 1), 1) > 50 THEN 'too many missing' WHEN family <> 'number' AND d = "rows" THEN 'unique id'
  WHEN is_binary THEN 'Boolean-like' WHEN family = 'number' THEN 'Numeric' WHEN family = 'date' THEN 'DateTime' WHEN d <= 30 THEN 'Categorical'
  WHEN d <= 0.8 * "rows" THEN 'Text' ELSE 'too many values' END AS kind FROM facts),
axes AS (SELECT "column", position, CASE WHEN kind = 'Numeric' THEN 'y' WHEN kind IN ('Boolean-like', 'DateTime', 'Categorical', 'Text') THEN 'x' END AS axis,
  CAST(CASE kind WHEN 'Boolean-like' THEN 30 WHEN 'Numeric' THEN CASE WHEN d > 10 THEN 90 ELSE 70 END WHEN 'DateTime' THEN 100 WHEN 'Categorical' THEN 85 - d WHEN 'Text' THEN 40 END AS INT) AS score,
  kind, d AS distinct_count FROM kinds)"""


_ORDER_FAMILIES = {"order_id": "number", "cust_id": "number", "order_ts": "date", "amount": "number", "priority": "text", "ratio": "number", "const_col": "number", "empty_col": "number"}


@query("pr12_suggest_axes", f"WITH {FINITE}, {_facts_sql('o', _ORDER_FAMILIES)} SELECT * FROM axes")
def _(t):
    return profile.suggest_axes(finite_orders(t))


_CHART = """SELECT (SELECT "column" FROM axes WHERE axis = 'x' ORDER BY score DESC, position LIMIT 1) AS top_x,
  (SELECT "column" FROM axes WHERE axis = 'y' ORDER BY score DESC, position LIMIT 1) AS top_y,
  CASE WHEN h AND y >= 1 THEN 'line' WHEN y >= 2 AND x >= 1 THEN 'bar' WHEN y = 1 AND x >= 1 THEN
    CASE WHEN (SELECT distinct_count FROM axes WHERE axis = 'x' ORDER BY score DESC, position LIMIT 1) <= 8 THEN 'pie' ELSE 'bar' END ELSE 'bar' END AS chart, h AND y >= 1 AS forecast_eligible
FROM (SELECT count(*) FILTER (WHERE axis = 'x') AS x, count(*) FILTER (WHERE axis = 'y') AS y, bool_or(kind = 'DateTime') AS h FROM axes)"""


@query("pr12_suggest_chart", f"WITH {FINITE}, {_facts_sql('o', _ORDER_FAMILIES)} {_CHART}")
def _(t):
    return profile.suggest_chart(profile.suggest_axes(finite_orders(t)))


@query("pr12_suggest_chart_customer", f"WITH {_facts_sql('dirty_customer', {'segment': 'text', 'balance_text': 'text', 'email': 'text', 'active': 'text', 'cust_id': 'number'})} {_CHART}")
def _(t):
    return profile.suggest_chart(profile.suggest_axes(t.wide("dirty_customer").select("segment", "balance_text", "email", "active", "cust_id")))


@query("pr13_recommend_charts", f"""
WITH d AS (SELECT count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_totalprice) AS v FROM orders)
SELECT * FROM (SELECT 1 AS rank, 'rec_trend' AS id, 'line' AS chart, 'o_orderdate' AS x, 'sales_price' AS y, 'avg' AS aggregation, 'o_orderstatus' AS group_by FROM d WHERE s <= 8 AND v > 8
UNION ALL SELECT 2, 'rec_donut', 'doughnut', 'o_orderstatus', 'sales_price', 'sum', '' FROM d WHERE s <= 8
UNION ALL SELECT 3, 'rec_scatter', 'scatter', 'sales_price', 'o_custkey', 'none', 'o_orderstatus' FROM d WHERE v > 8)""")
def _(t):
    rows = t("orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("sales_price"), "o_orderdate", "o_orderpriority")
    return recommend.recommend_charts(rows, "sales_commercial")


_SUGGESTED = ("SELECT 1 AS rank, 'line' AS chart, 'order_date' AS x, 'amount' AS y", "SELECT 2, 'forecast', 'order_date', 'amount'", "SELECT 3, 'bar', 'order_id', 'amount'",
              "SELECT 4, 'pie', 'order_id', 'amount'", "SELECT 5, 'histogram', 'amount', NULL", "SELECT 6, 'box', 'order_id', 'amount'")


@query("pr14_suggest_charts", f"""WITH {WIDE}, s AS ({union(_SUGGESTED)})
SELECT * FROM s WHERE (SELECT count({SCALED.format('CAST(amount AS VARCHAR)')}) >= 0.7 * count(amount) FROM w) AND (SELECT count(TRY_CAST(order_date AS DATE)) >= 0.7 * count(*) FROM w)""")
def _(t):
    return recommend.suggest_charts(wide_orders(t))


_GALLERY = ("SELECT 1 AS rank, 'forecast' AS chart, 'order_date' AS x, 'amount' AS y", "SELECT 2, 'bar', 'order_id', 'amount'", "SELECT 3, 'line', 'order_date', 'amount'",
            "SELECT 4, 'area', 'order_id', 'amount'", "SELECT 5, 'donut', 'order_id', 'amount'", "SELECT 6, 'boxplot', 'order_id', 'amount'", "SELECT 7, 'histogram', 'amount', NULL")


@query("pr14_chart_gallery", f"""WITH {WIDE}, s AS ({union(_GALLERY)})
SELECT * FROM s WHERE (SELECT count(TRY_CAST(order_date AS DATE)) >= 0.7 * count(*) FROM w)""")
def _(t):
    return recommend.chart_gallery(wide_orders(t))


@query("pr15_target_suggestions", f"""WITH {WIDE}
SELECT * FROM (SELECT 'order_id' AS "column", CAST(1 AS BIGINT) AS position, 'regression or classification' AS reason, count(DISTINCT order_id) AS classes FROM w HAVING count(order_id) > 0.5 * count(*)
UNION ALL SELECT 'amount', 3, 'regression or classification', count(DISTINCT amount) FROM w HAVING count(amount) > 0.5 * count(*)
UNION ALL SELECT 'order_date', 2, 'classification', count(DISTINCT order_date) FROM w HAVING count(DISTINCT order_date) BETWEEN 2 AND 20
UNION ALL SELECT 'priority', 4, 'classification', count(DISTINCT priority) FROM w HAVING count(DISTINCT priority) BETWEEN 2 AND 20
UNION ALL SELECT 'is_open', 5, 'classification', count(DISTINCT is_open) FROM w HAVING count(DISTINCT is_open) BETWEEN 2 AND 20)""")
def _(t):
    return profile.target_suggestions(wide_orders(t))


def _before_after(t):
    before = t.wide("dirty_customer")
    after = texts.trim_text(missing.fill_text_gaps(before.filter("cust_id > 9"), ["active"]), ["segment"])
    return before, after


@query("pr16_dataset_diff", f"""
SELECT cust_id, 'active' AS "column", CAST(NULL AS VARCHAR) AS before, 'Unknown' AS after FROM dirty_customer WHERE cust_id > 9 AND active IS NULL
UNION ALL SELECT cust_id, 'segment', segment, {TRIM.format('segment')} FROM dirty_customer WHERE cust_id > 9 AND {TRIM.format('segment')} <> segment""")
def _(t):
    return profile.dataset_diff(*_before_after(t), "cust_id")


@query("pr16_diff_summary", f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE cust_id > 9) AS rows_after, count(*) FILTER (WHERE cust_id <= 9) AS rows_removed,
  count(*) FILTER (WHERE cust_id > 9 AND (active IS NULL OR {TRIM.format('segment')} <> segment)) AS rows_changed,
  count(*) FILTER (WHERE cust_id > 9 AND active IS NULL) + count(*) FILTER (WHERE cust_id > 9 AND {TRIM.format('segment')} <> segment) AS cells_changed,
  count(*) FILTER (WHERE cust_id > 9 AND active IS NULL) AS nulls_handled FROM dirty_customer""")
def _(t):
    return profile.diff_summary(*_before_after(t), "cust_id")


@query("pr17_version_diff", """
SELECT (SELECT count(*) FROM dirty_customer) AS prev_rows, (SELECT count(*) FROM doubled_customer) AS new_rows,
  (SELECT count(*) FROM doubled_customer) - (SELECT count(*) FROM dirty_customer) AS added_rows, 0 AS removed_rows, 'extra' AS new_columns, 'email' AS removed_columns,
  true AS is_update, 4 AS version""")
def _(t):
    return profile.version_diff(t.wide("dirty_customer"), t.wide("doubled_customer").drop("email").withColumn("extra", F.lit(1)), 3)


@query("pr18_cleaning_plan", f"""WITH {browser_sql(_DOUBLED_CELLS).strip()}, {_DUP},
pos AS (SELECT unnest(['cust_id', 'name', 'segment', 'balance_text', 'email', 'active']) AS "column", unnest(range(1, 7)) AS position),
s AS (SELECT 0 AS stage, 0 AS p, 'trim' AS action, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS detail FROM pro HAVING sum(whitespace) > 0
  UNION ALL SELECT 1, 0, 'drop_duplicates', NULL, NULL FROM dup WHERE d > 0
  UNION ALL SELECT 2, position * 10 + 2, 'to_numeric', "column", NULL FROM pro JOIN pos USING ("column") WHERE n_currency > 0
  UNION ALL SELECT 2, position * 10 + 3, 'normalize_categories', "column", NULL FROM pro JOIN pos USING ("column") WHERE casing_groups > 0
  UNION ALL SELECT 2, position * 10 + 4, 'impute', "column", CASE WHEN dominant_type IN ('numeric', 'currency', 'percentage') THEN 'median' ELSE 'mode' END FROM pro JOIN pos USING ("column") WHERE nulls > 0
  UNION ALL SELECT 2, position * 10 + 5, 'iso_dates', "column", NULL FROM pro JOIN pos USING ("column") WHERE dominant_type = 'date')
SELECT CAST(row_number() OVER (ORDER BY stage, p) AS INT) AS step, action, "column", detail FROM s""")
def _(t):
    return profile.cleaning_plan(t.wide("doubled_customer"))


def _analysis_sql(c: str) -> str:
    number = c in ORDER_NUMBERS
    figures = [r(f.format(c=c)) if number else "CAST(NULL AS DOUBLE)" for f in ("avg({c})", "stddev_samp({c})", "min({c})", "max({c})", "quantile_cont({c}, 0.5)")]
    return f"""SELECT '{c}' AS "column", count(*) AS "rows", 8 AS "columns", '{"numeric" if number else "categorical"}' AS family, count(*) - count({c}) AS missing,
  {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct, {figures[0]} AS mean, {figures[1]} AS std, {figures[2]} AS min, {figures[3]} AS max, {figures[4]} AS median FROM o"""


@query("pr19_dataset_analysis", f"WITH {FINITE} {union(map(_analysis_sql, ORDER_COLUMNS))}")
def _(t):
    return rounded(profile.dataset_analysis(finite_orders(t)))


# Correlation -----------------------------------------------------------------------------------------

_MATRIX = union([f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS value FROM m" for a in _MEASURES for b in _MEASURES])


@query("st01_correlation_matrix", f"WITH {_M} {_MATRIX}")
def _(t):
    return rounded(statistics.correlation_matrix(_measures(t)))


@query("ag18_heat_map", f"""WITH o AS (SELECT amount, const_col, CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio FROM dirty_orders)
{union(f"SELECT '{a}' AS x, '{b}' AS y, " + ("max(CAST(NULL AS DOUBLE))" if "const_col" in (a, b) else r(f"corr({a}, {b})")) + " AS value FROM o" for a in ("amount", "const_col", "ratio") for b in ("amount", "const_col", "ratio"))}""")
def _(t):
    return rounded(statistics.correlation_matrix(finite_orders(t).select("amount", "const_col", "ratio"), fill=None))


@query("st02_correlation_pairs", f"WITH {FINITE} {union(f"SELECT '{a}' AS a, '{b}' AS b, regr_count({a}, {b}) AS n, {r(f'corr({a}, {b})')} AS r FROM o" for a, b in (('order_id', 'amount'), ('order_id', 'ratio'), ('amount', 'ratio')))}")
def _(t):
    return rounded(statistics.correlation_pairs(finite_orders(t), ["order_id", "amount", "ratio"], min_n=3))


@query("st03_pair_strength", f"""SELECT count(*) AS n, {r('corr(l_quantity, l_extendedprice)')} AS r,
  CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.8 THEN 'Strong ' || d WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.5 THEN 'Moderate ' || d
    WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.2 THEN 'Weak ' || d ELSE 'Negligible / Uncorrelated' END AS strength
FROM lineitem, (SELECT CASE WHEN corr(l_quantity, l_extendedprice) >= 0 THEN 'Positive' ELSE 'Negative' END AS d FROM lineitem) GROUP BY d""")
def _(t):
    return rounded(statistics.pair_strength(t("lineitem"), "l_quantity", "l_extendedprice"))


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("st04_spearman", f"""WITH {_M}, k AS (SELECT {", ".join(f"{_rank(c)} AS {c}" for c in _MEASURES)} FROM m)
{union(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS r FROM k" for a, b in _PAIRS)}""")
def _(t):
    return rounded(statistics.spearman_pairs(_measures(t)))


@query("st05_trend_line", f"SELECT regr_count(amount, cust_id) AS n, {r('regr_slope(amount, cust_id)')} AS slope, {r('regr_intercept(amount, cust_id)')} AS intercept FROM dirty_orders")
def _(t):
    return rounded(statistics.trend_line(t.wide("dirty_orders"), "cust_id", "amount"))


# Diagnostics -------------------------------------------------------------------------------------------

_SUMS = "g AS (SELECT c_mktsegment AS c, sum(c_acctbal) AS s, avg(c_acctbal) AS m, count(c_acctbal) AS n FROM customer GROUP BY 1)"


@query("bd01_category_gap", f"""WITH {_SUMS}
SELECT h.c AS top, {r('h.s', 2)} AS top_sum, {r('h.m', 2)} AS top_mean, h.n AS top_n, l.c AS bottom, {r('l.s', 2)} AS bottom_sum, {r('l.m', 2)} AS bottom_mean, l.n AS bottom_n,
  {r('(h.s - l.s) * 100 / greatest(h.s, 1)', 2)} AS gap_pct FROM (SELECT * FROM g ORDER BY s DESC LIMIT 1) h, (SELECT * FROM g ORDER BY s LIMIT 1) l""")
def _(t):
    return rounded(diagnostics.category_gap(t("customer"), "c_mktsegment", "c_acctbal"), 2)


@query("bd02_elasticity", f"""SELECT count(*) AS n, {r('corr(l_quantity, l_extendedprice)')} AS r,
  CASE WHEN corr(l_quantity, l_extendedprice) > 0.5 THEN 'strong positive' WHEN corr(l_quantity, l_extendedprice) < -0.3 THEN 'inverse' ELSE 'moderate or decoupled' END AS relation,
  {r('abs(corr(l_quantity, l_extendedprice) * 10)')} AS shift_pct FROM lineitem""")
def _(t):
    return rounded(diagnostics.elasticity(t("lineitem"), "l_quantity", "l_extendedprice"))


@query("bd03_concentration", f"""WITH {_SUMS}
SELECT arg_max(c, s) AS top, {r('max(s) * 100 / sum(s)')} AS top_share_pct, arg_min(c, s) AS bottom, {r('min(s) * 100 / sum(s)')} AS bottom_share_pct FROM g""")
def _(t):
    return rounded(diagnostics.concentration(t("customer"), "c_mktsegment", "c_acctbal"))


@query("bd04_stock_thresholds", f"""SELECT count(*) AS n, {r('quantile_cont(l_quantity, 0.25)')} AS p25, {r('quantile_cont(l_quantity, 0.5)')} AS median, {r('quantile_cont(l_quantity, 0.75)')} AS p75 FROM lineitem""")
def _(t):
    return rounded(diagnostics.stock_thresholds(t("lineitem"), "l_quantity"))


@query("bd05_column_summary", f"""WITH b AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM dirty_orders),
x AS (SELECT amount, priority, amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) AS out FROM dirty_orders, b),
p AS (SELECT priority, count(*) AS n FROM dirty_orders WHERE priority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT {r('sum(amount)', 2)} AS sum, {r('avg(amount)', 2)} AS mean, {r('quantile_cont(amount, 0.5)', 2)} AS median, {r('min(amount)', 2)} AS min, {r('max(amount)', 2)} AS max, count(amount) AS count,
  count(*) FILTER (WHERE out) AS outlier_count, {r('count(*) FILTER (WHERE out) * 100.0 / count(amount)', 2)} AS outlier_pct, {r(_pop_skew('amount'), 2)} AS skewness, {r('kurtosis_pop(amount)', 2)} AS kurtosis,
  (SELECT priority FROM p) AS top_category, (SELECT n FROM p) AS top_count, {r('(SELECT n FROM p) * 100.0 / count(priority)', 2)} AS top_share_pct FROM x""")
def _(t):
    return rounded(diagnostics.column_summary(t.wide("dirty_orders"), "amount", "priority"), 2)


