"""Typing, missing-value, text, privacy and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions import cells
from tablecraft.operators import isolation, missing, outliers, texts, typing_ops
from tablecraft.plans import recipe
from tablecraft.plans.catalogue.registry import query, r, rounded
from tablecraft.plans.catalogue.tables import MISSING, NUM, SCALED, TRIM

TEXT_COLUMNS = ("name", "segment", "balance_text", "email", "active")
ALL_COLUMNS = ("cust_id", *TEXT_COLUMNS)


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Types ---------------------------------------------------------------------------------------------

def date_sql(c: str) -> str:
    """Calendar date of a text cell, shape by shape."""
    return f"""TRY_CAST(CASE
  WHEN regexp_matches({c}, {_lit(cells.RX_DATE_YMD)}) THEN regexp_replace({c}, {_lit(cells.RX_DATE_YMD)}, '\\1-\\2-\\3')
  WHEN regexp_matches({c}, {_lit(cells.RX_DATE_MDY)}) THEN regexp_replace({c}, {_lit(cells.RX_DATE_MDY)}, '\\3-\\1-\\2')
  END AS DATE)"""


def type_sql(c: str) -> str:
    """Kind of a text cell; the first matching rule wins."""
    t = TRIM.format(c)
    rules = (("boolean", cells.RX_BOOLEAN), ("email", cells.RX_EMAIL), ("url", cells.RX_URL), ("phone", cells.RX_PHONE),
             ("currency", cells.RX_CURRENCY), ("percentage", cells.RX_PERCENT), ("integer", cells.RX_INTEGER),
             ("float", cells.RX_FLOAT))
    whens = " ".join(f"WHEN regexp_matches({t}, {_lit(p)}) THEN '{kind}'" for kind, p in rules)
    date = f"length({t}) >= 6 AND NOT regexp_matches({t}, '^\\d+$') AND {date_sql(t)} IS NOT NULL"
    return f"CASE WHEN {c} IS NULL OR {t} = '' OR regexp_matches({t}, {_lit(cells.RX_NULL_WORD)}) THEN 'null' {whens} WHEN {date} THEN 'date' ELSE 'string' END"


@query("ty01_parse_numeric", f"SELECT cust_id, {r(SCALED.format('balance_text'))} AS balance FROM dirty_customer")
def _(t):
    return rounded(t("dirty_customer").select("cust_id", cells.parse_numeric("balance_text").alias("balance")))


@query("ty02_to_numeric_strip", f"SELECT cust_id, {r(NUM.format('balance_text'))} AS balance FROM dirty_customer")
def _(t):
    return rounded(t("dirty_customer").select("cust_id", cells.to_numeric_strip("balance_text").alias("balance")))


def _kinds(t):
    """Every cell of the dirty customers, order dates and prices as text."""
    people = typing_ops.long_cells(t.wide("dirty_customer"))
    orders = t.wide("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_date"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")).alias("decimal"))
    return people.unionByName(typing_ops.long_cells(orders))


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM dirty_customer" for c in ALL_COLUMNS) + """
UNION ALL SELECT 'iso_date', strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT 'us_date', strftime(o_orderdate, '%m/%d/%Y') FROM orders
UNION ALL SELECT 'decimal', concat(CAST(o_orderkey AS VARCHAR), '.5') FROM orders"""


@query("ty03_infer_value_type", f"WITH cell AS ({_CELLS}) SELECT \"column\", value, {type_sql('value')} AS type FROM cell")
def _(t):
    return _kinds(t).withColumn("type", cells.infer_value_type("value"))


@query("ty04_is_valid_date", f"""WITH cell AS ({_CELLS}) SELECT "column", count(*) AS cells,
  count(*) FILTER (WHERE length({TRIM.format('value')}) >= 6 AND NOT regexp_matches({TRIM.format('value')}, '^\\d+$') AND {date_sql(TRIM.format('value'))} IS NOT NULL) AS dates
FROM cell GROUP BY 1""")
def _(t):
    return _kinds(t).groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.count_if(cells.is_valid_date("value")).alias("dates"))


def votes_sql(cell: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS n_{k}" for k in typing_ops.VALUE_TYPES)
    filled = " + ".join(f"n_{k}" for k in typing_ops.VALUE_TYPES[:-1])
    return f"""
c AS (SELECT "column", value, {type_sql('value')} AS type FROM ({cell})),
v AS (SELECT "column", {kinds}, count(DISTINCT CASE WHEN type <> 'null' THEN lower({TRIM.format('value')}) END) AS d FROM c GROUP BY 1),
n AS (SELECT *, {filled} AS f, n_integer + n_float + n_currency + n_percentage AS num FROM v),
b AS (SELECT *, CAST(round(num * 100.0 / f) AS INT) AS np, coalesce(CAST(round(d * 100.0 / f) AS INT), 0) AS u,
  CASE WHEN f = 0 THEN 'empty'
    WHEN round(num * 100.0 / f) >= 60 THEN CASE WHEN n_currency > n_integer AND n_currency > n_float THEN 'currency'
      WHEN n_percentage > n_integer AND n_percentage > n_float THEN 'percentage' WHEN n_integer >= n_float THEN 'integer' ELSE 'float' END
    WHEN n_date >= 0.6 * f THEN 'date' WHEN n_boolean >= 0.7 * f THEN 'boolean' WHEN n_email >= 0.5 * f THEN 'email'
    WHEN n_url >= 0.5 * f THEN 'url' WHEN n_phone >= 0.5 * f THEN 'phone' WHEN d = 2 AND f >= 2 THEN 'binary'
    WHEN d <= 15 AND d < 0.5 * f THEN 'categorical' ELSE 'string' END AS base FROM n),
k AS (SELECT *, CASE WHEN u > 95 AND f > 10 AND base IN ('string', 'integer') THEN 'id' ELSE base END AS p FROM b)
SELECT "column", p AS primary_type,
  CASE WHEN p IN ('integer', 'float', 'currency', 'percentage') THEN 'numeric' WHEN p IN ('email', 'phone') THEN 'contact'
    WHEN p = 'url' THEN 'web' WHEN p = 'categorical' THEN 'category' WHEN p = 'string' THEN 'text' ELSE p END AS category,
  CASE p WHEN 'empty' THEN 100 WHEN 'id' THEN 92 WHEN 'binary' THEN 95 WHEN 'categorical' THEN 90
    WHEN 'date' THEN CAST(round(n_date * 100.0 / f) AS INT) WHEN 'boolean' THEN CAST(round(n_boolean * 100.0 / f) AS INT)
    WHEN 'email' THEN CAST(round(n_email * 100.0 / f) AS INT) WHEN 'url' THEN CAST(round(n_url * 100.0 / f) AS INT)
    WHEN 'phone' THEN CAST(round(n_phone * 100.0 / f) AS INT) WHEN 'string' THEN CAST(round(n_string * 100.0 / f) AS INT) ELSE np END AS confidence,
  d AS distinct_count, u AS unique_ratio, {", ".join(f"n_{k}" for k in typing_ops.VALUE_TYPES)} FROM k"""


_DIRTY_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM dirty_customer" for c in ALL_COLUMNS)


@query("ty05_tell_column_type", "WITH " + votes_sql(_DIRTY_CELLS).strip())
def _(t):
    return typing_ops.tell_column_type(t.wide("dirty_customer"))


_SEMANTIC = f"""
c AS (SELECT "column", value, lower({TRIM.format('value')}) AS low FROM ({{cells}})),
v AS (SELECT "column", count(value) AS filled, count(DISTINCT value) AS distinct_count,
  count(*) FILTER (WHERE value IS NOT NULL AND low NOT IN ('true', 'false', '1', '0', 'yes', 'no', 't', 'f')) AS not_boolean,
  count({NUM.format('value')}) FILTER (WHERE NOT isnan({NUM.format('value')})) AS numbers,
  count(*) FILTER (WHERE value IS NOT NULL AND {date_sql(TRIM.format('value'))} IS NULL) AS not_dates FROM c GROUP BY 1)
SELECT "column", CASE WHEN filled = 0 THEN 'text'
  WHEN lower("column") IN ('id', 'identifier', 'uuid', 'guid', 'code') OR lower("column") LIKE '%\\_id' ESCAPE '\\' THEN 'id_like'
  WHEN not_boolean = 0 THEN 'boolean' WHEN numbers >= 0.8 * filled THEN 'numeric'
  WHEN regexp_matches(lower("column"), 'date|time|created|timestamp|year|month') AND not_dates = 0 THEN 'datetime'
  WHEN distinct_count < 0.25 * filled OR distinct_count <= 20 THEN 'categorical' ELSE 'text' END AS semantic_type, filled, distinct_count FROM v"""
_ORDER_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({e} AS VARCHAR) AS value FROM dirty_orders" for c, e in (
        ("order_id", "order_id"), ("order_date", "strftime(order_ts, '%Y-%m-%d')"), ("amount", "amount"), ("priority", "priority"), ("empty_col", "empty_col")))


@query("ty06_semantic_type", "WITH " + _SEMANTIC.replace("{cells}", _DIRTY_CELLS).strip())
def _(t):
    return typing_ops.semantic_type(t.wide("dirty_customer"))


@query("ty06_semantic_type_orders", "WITH " + _SEMANTIC.replace("{cells}", _ORDER_CELLS).strip())
def _(t):
    return typing_ops.semantic_type(t.wide("dirty_orders").select(
        "order_id", F.date_format("order_ts", "yyyy-MM-dd").alias("order_date"), "amount", "priority", "empty_col"))


def dominant_sql(cell: str) -> str:
    return f"""
c AS (SELECT "column", value, {type_sql('value')} AS type, value IS NOT NULL AND value <> '' AS has FROM ({cell})),
v AS (SELECT "column", count(*) AS "rows", count(*) FILTER (WHERE has) AS f,
  count(*) FILTER (WHERE has AND type IN ('integer', 'float')) AS n_num, count(*) FILTER (WHERE has AND type = 'currency') AS n_currency,
  count(*) FILTER (WHERE has AND type = 'percentage') AS n_percentage, count(*) FILTER (WHERE has AND type = 'date') AS n_date,
  count(*) FILTER (WHERE has AND type = 'boolean') AS n_boolean,
  count(*) FILTER (WHERE has AND type IN ('email', 'url', 'phone', 'string', 'null')) AS n_string,
  count(DISTINCT CASE WHEN has THEN {TRIM.format('value')} END) AS d FROM c GROUP BY 1),
w AS (SELECT *, f > 0 AND n_num + n_currency + n_percentage >= 0.7 * f AS is_num FROM v),
x AS (SELECT *, f > 0 AND NOT is_num AND n_date >= 0.7 * f AS is_date FROM w),
dom AS (SELECT "column", CASE WHEN d > 10 AND d = f AND regexp_matches("column", '(?i)(id|key|code|uuid|number|no)$') THEN 'id'
  WHEN f = 0 THEN 'text' WHEN is_num THEN CASE WHEN n_percentage > 0 THEN 'percentage' WHEN n_currency > 0 THEN 'currency' ELSE 'numeric' END
  WHEN is_date THEN 'date' WHEN n_boolean >= 0.7 * f THEN 'boolean' WHEN d = 2 THEN 'binary'
  WHEN d <= least(25, greatest(2, floor(f * 0.25))) THEN 'categorical' ELSE 'text' END AS dominant_type,
  "rows", "rows" - f AS nulls, d AS distinct_count, n_currency, n_percentage,
  (is_num AND (n_string > 0 OR (n_currency > 0 AND n_num > 0))) OR (is_date AND (n_string > 0 OR n_num > 0)) AS is_mixed FROM x)"""


@query("ty07_dominant_type", f"WITH {dominant_sql(_DIRTY_CELLS).strip()} SELECT * REPLACE (CASE WHEN \"column\" = 'active' THEN 'ignore' ELSE dominant_type END AS dominant_type) FROM dom")
def _(t):
    return typing_ops.dominant_type(t.wide("dirty_customer"), {"active": "ignore"})


@query("ty09_cast_columns", f"""
SELECT cust_id, CAST(round({NUM.format('balance_text')}) AS BIGINT) AS balance_text, CAST(NULL AS DOUBLE) AS name, CAST(cust_id AS VARCHAR) AS label,
  CAST(strptime('2020-01-' || lpad(CAST(cust_id % 28 + 1 AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE) AS day FROM dirty_customer""")
def _(t):
    rows = t("dirty_customer").select(
        "cust_id", "balance_text", "name", F.col("cust_id").alias("label"),
        F.concat(F.lit("2020-01-"), F.lpad((F.col("cust_id") % 28 + 1).cast("string"), 2, "0")).alias("day"))
    out = typing_ops.cast_columns(rows, {"balance_text": "Integer", "name": "Float", "label": "Text", "day": "Datetime", "nope": "Text"})
    return out.withColumn("day", F.col("day").cast("date"))


@query("ty10_cast_value", f"""
SELECT cust_id, CAST(round({SCALED.format('balance_text')}) AS BIGINT) AS balance_text,
  CASE lower(active) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS active, upper({TRIM.format('name')}) AS name, {TRIM.format('segment')} AS segment FROM dirty_customer""")
def _(t):
    kinds = {"balance_text": "integer", "active": "boolean", "name": "uppercase", "segment": "categorical"}
    return typing_ops.cast_value_columns(t("dirty_customer"), kinds).drop("email")


@query("ty10_cast_failures", f"""
SELECT 'balance_text' AS "column", count({SCALED.format('balance_text')}) AS converted, 0 AS cast_failed FROM dirty_customer
UNION ALL SELECT 'name', count({SCALED.format('name')}), count(*) FILTER (WHERE ({SCALED.format('name')}) IS NULL AND NOT {MISSING.format('name')}) FROM dirty_customer""")
def _(t):
    return typing_ops.cast_value_columns(t("dirty_customer"), {"balance_text": "numeric", "name": "numeric"}, count_failures=True)


@query("ty11_clean_numeric_column", f"SELECT cust_id, name, segment, {r(SCALED.format('balance_text'))} AS balance_text, email, active FROM dirty_customer")
def _(t):
    return rounded(typing_ops.clean_numeric_column(t("dirty_customer"), "balance_text"))


# Missing values ------------------------------------------------------------------------------------

@query("mv01_fill_mean", f"SELECT order_id, {r('coalesce(amount, (SELECT avg(amount) FROM dirty_orders))')} AS amount FROM dirty_orders")
def _(t):
    return rounded(missing.fill_missing(t("dirty_orders").select("order_id", "amount"), {"amount": "mean"}))


@query("mv02_fill_median", f"SELECT order_id, {r('coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty_orders))')} AS amount FROM dirty_orders")
def _(t):
    return rounded(missing.fill_missing(t("dirty_orders").select("order_id", "amount"), {"amount": "median"}))


@query("mv03_fill_mode", """
SELECT order_id, coalesce(priority, (SELECT priority FROM dirty_orders WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
  CAST(empty_col AS DOUBLE) AS empty_col FROM dirty_orders""")
def _(t):
    return missing.fill_missing(t("dirty_orders").select("order_id", "priority", "empty_col"), {"priority": "mode", "empty_col": "mode"})


@query("mv04_fill_zero", "SELECT order_id, coalesce(amount, 0) AS amount, coalesce(empty_col, 0) AS empty_col FROM dirty_orders")
def _(t):
    return missing.fill_missing(t("dirty_orders").select("order_id", "amount", "empty_col"), {"amount": "zero", "empty_col": "zero"})


@query("mv05_fill_constant", "SELECT order_id, coalesce(amount, 12.5) AS amount, coalesce(priority, 'none given') AS priority, empty_col FROM dirty_orders")
def _(t):
    rows = t("dirty_orders").select("order_id", "amount", "priority", "empty_col")
    return missing.fill_missing(rows, {"amount": "=12.5", "priority": "=none given", "empty_col": "=not a number"})


@query("mv06_fill_unknown", f"SELECT cust_id, CASE WHEN {MISSING.format('name')} THEN 'Unknown' ELSE name END AS name, coalesce(active, 'Unknown') AS active FROM dirty_customer")
def _(t):
    return missing.fill_text_gaps(t("dirty_customer").select("cust_id", "name", "active"), ["name", "active"])


_ALONG = "OVER (PARTITION BY user_id ORDER BY ts, event_id {0})"
_BACK = "OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"


def _gaps(t):
    return t("gappy_events").select("event_id", "ts", "user_id", "event_type", "value")


def _no_ts(df):
    return df.drop("ts")


@query("mv07_forward_fill", f"""
SELECT event_id, user_id, last_value(event_type IGNORE NULLS) {_ALONG.format('')} AS event_type,
  last_value(value IGNORE NULLS) {_ALONG.format('')} AS value FROM gappy_events""")
def _(t):
    return _no_ts(missing.forward_fill(_gaps(t), ["event_type", "value"], ["ts", "event_id"], ["user_id"]))


@query("mv07_forward_fill_whole_table", "SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value FROM gappy_events")
def _(t):
    return missing.forward_fill(t("gappy_events").select("event_id", "ts", "value"), ["value"], ["ts", "event_id"]).drop("ts")


@query("mv08_backward_fill", f"""
SELECT event_id, user_id, last_value(event_type IGNORE NULLS) {_BACK} AS event_type,
  last_value(value IGNORE NULLS) {_BACK} AS value FROM gappy_events""")
def _(t):
    return _no_ts(missing.backward_fill(_gaps(t), ["event_type", "value"], ["ts", "event_id"], ["user_id"]))


@query("mv09_fill_default", f"""
SELECT event_id, user_id, coalesce(last_value(event_type IGNORE NULLS) {_ALONG.format('')}, 'Unknown') AS event_type FROM gappy_events""")
def _(t):
    rows = _gaps(t).drop("value")
    return _no_ts(missing.forward_fill(rows, ["event_type"], ["ts", "event_id"], ["user_id"], default="Unknown"))


@query("mv10_bulk_fill", f"""
SELECT order_id, {r('coalesce(amount, (SELECT avg(amount) FROM dirty_orders))')} AS amount, coalesce(priority, 'Unknown') AS priority,
  const_col, empty_col FROM dirty_orders""")
def _(t):
    rows = t("dirty_orders").select("order_id", "amount", "priority", "const_col", "empty_col")
    return rounded(missing.bulk_fill(rows, "mean"))


@query("mv11_is_missing", "SELECT cust_id, " + ", ".join(f"{MISSING.format(c)} AS {c}" for c in TEXT_COLUMNS) + " FROM dirty_customer")
def _(t):
    return t("dirty_customer").select("cust_id", *[cells.is_missing(c).alias(c) for c in TEXT_COLUMNS])


@query("mv12_missing_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {MISSING.format(f'CAST({c} AS VARCHAR)')}) AS missing, "
    f"{r('count(*) FILTER (WHERE ' + MISSING.format(f'CAST({c} AS VARCHAR)') + ') * 100.0 / count(*)')} AS missing_pct FROM dirty_customer" for c in ALL_COLUMNS))
def _(t):
    return rounded(missing.missing_report(t("dirty_customer")))


# Text ----------------------------------------------------------------------------------------------

@query("tx01_trim", f"SELECT cust_id, {TRIM.format('name')} AS name, {TRIM.format('segment')} AS segment FROM dirty_customer")
def _(t):
    return texts.trim_text(t("dirty_customer").select("cust_id", "name", "segment"))


@query("tx01_changed_cells", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {TRIM.format(c)} <> {c}) AS changed FROM dirty_customer" for c in TEXT_COLUMNS))
def _(t):
    return texts.changed_cells(t("dirty_customer"), cells.trim_ws)


@query("tx02_squeeze", f"""
SELECT doc_id, CASE WHEN lower(x) IN ('nan', 'none') THEN NULL ELSE x END AS text
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\p{{Z}}]+$', '', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\p{{Z}}]+', ' ', 'g') AS x FROM documents)""")
def _(t):
    return texts.squeeze_text(t.wide("documents").select("doc_id", "text"))


@query("tx03_lower", "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(t):
    return texts.change_case(t("customer"), "lower")


@query("tx03_upper", "SELECT cust_id, upper(segment) AS segment FROM dirty_customer")
def _(t):
    return texts.change_case(t("dirty_customer").select("cust_id", "segment"), "upper")


@query("tx04_title", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type || '-o''neil world2x', '([A-Za-z]+|[^A-Za-z]+)', 1),
  lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))), '') AS label FROM part""")
def _(t):
    rows = t("part").select("p_partkey", F.concat("p_type", F.lit("-o'neil world2x")).alias("label"))
    return texts.change_case(rows, "title")


@query("tx04_title_word", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_type || ' o''neil world2x', ' '),
  lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))), ' ') AS label FROM part""")
def _(t):
    rows = t("part").select("p_partkey", F.concat("p_type", F.lit(" o'neil world2x")).alias("label"))
    return texts.change_case(rows, "word")


_CANON = f"""
v AS (SELECT {TRIM.format('segment')} AS variant, count(*) AS n FROM dirty_customer GROUP BY 1),
w AS (SELECT variant, n, first_value(variant) OVER (PARTITION BY lower(variant) ORDER BY n DESC, variant) AS canonical FROM v)"""


@query("tx05_normalize_categories", f"""WITH {_CANON.strip()}
SELECT cust_id, canonical AS segment FROM dirty_customer JOIN w ON variant = {TRIM.format('segment')}""")
def _(t):
    return texts.normalize_categories(t("dirty_customer").select("cust_id", "segment"), "segment")


@query("tx05_category_map", f"WITH {_CANON.strip()} SELECT variant, canonical, n FROM w")
def _(t):
    return texts.category_map(t("dirty_customer"), "segment")


@query("tx06_alias_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Industry' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    rows = t("customer").select("c_custkey", "c_mktsegment")
    return texts.map_categories(rows, "c_mktsegment", {"BUILDING": "Construction", "MACHINERY": "Industry"})


@query("tx06_department_alias", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'HR' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'IT' ELSE c_mktsegment END AS department FROM customer""")
def _(t):
    wording = F.create_map(*[F.lit(x) for kv in {"BUILDING": "human resources", "MACHINERY": " hr", "AUTOMOBILE": "Information  Technology"}.items() for x in kv])
    rows = t("customer").select("c_custkey", F.coalesce(F.try_element_at(wording, F.col("c_mktsegment")), "c_mktsegment").alias("department"))
    return rows.withColumn("department", texts.department_alias(F.col("department")))


@query("tx07_casing_variants", f"""
SELECT lower(v) AS value, count(*) AS variants, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT {TRIM.format('segment')} AS v, count(*) AS n FROM dirty_customer GROUP BY 1) GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return texts.casing_variants(t("dirty_customer"), "segment")


@query("tx08_iso_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS named, 'not a date' AS other FROM orders""")
def _(t):
    rows = t("orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
                              F.date_format("o_orderdate", "MMMM d, yyyy").alias("named"), F.lit("not a date").alias("other"))
    return texts.standardize_dates(rows, ["us", "named", "other"])


@query("tx09_whitespace_issues", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE regexp_matches({c}, '^\\s+|\\s+$|\\s{{2,}}')) AS issues FROM dirty_customer" for c in TEXT_COLUMNS))
def _(t):
    return texts.whitespace_issues(t("dirty_customer"))


@query("tx09_outer_whitespace", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {TRIM.format(c)} <> {c}) AS issues FROM dirty_customer" for c in TEXT_COLUMNS))
def _(t):
    return texts.whitespace_issues(t("dirty_customer"), strict=False)


def _mask_server(c: str) -> str:
    s = TRIM.format(c)
    return f"""CASE WHEN contains({s}, '@') THEN concat(substr(split_part({s}, '@', 1), 1, 2), '***@', split_part({s}, '@', 2))
  WHEN regexp_matches({s}, '\\d{{3,}}') THEN concat(substr({s}, 1, 2), '****', right({s}, 2)) ELSE concat('Anon_', substr(sha256({s}), 1, 8)) END"""


@query("tx11_mask_server", f"SELECT cust_id, {_mask_server('name')} AS name, {_mask_server('email')} AS email, segment FROM dirty_customer")
def _(t):
    return texts.mask_columns(t("dirty_customer").select("cust_id", "name", "email", "segment"), "server")


def _mask_browser(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR {c} = '' THEN {c}
  WHEN contains({c}, '@') THEN concat(CASE WHEN length(split_part({c}, '@', 1)) > 2 THEN substr({c}, 1, 2) || '***' ELSE '***' END, '@', split_part({c}, '@', 2))
  WHEN regexp_matches({c}, '^\\+?\\d[\\d\\s\\-()]{{6,}}$') THEN concat(substr({c}, 1, 3), '****', right({c}, 2))
  WHEN length({c}) > 4 THEN concat(substr({c}, 1, 2), repeat('*', least(6, length({c}) - 4)), right({c}, 2)) ELSE '***' END"""


@query("tx12_mask_browser", f"""
SELECT cust_id, {_mask_browser('name')} AS name, {_mask_browser('email')} AS email, {_mask_browser('phone')} AS phone, segment
FROM (SELECT cust_id, name, email, segment, '555-010-' || CAST(cust_id AS VARCHAR) AS phone FROM dirty_customer)""")
def _(t):
    rows = t("dirty_customer").select("cust_id", "name", "email", "segment", F.concat(F.lit("555-010-"), F.col("cust_id").cast("string")).alias("phone"))
    return texts.mask_columns(rows, "browser")


@query("tx13_mask_short", "SELECT cust_id, substr(sha256(name), 1, 8) AS name, '***@***.com' AS email FROM dirty_customer")
def _(t):
    return texts.mask_columns(t("dirty_customer").select("cust_id", "name", "email"), "short")


@query("tx14_redact_email", "SELECT cust_id, name, '[EMAIL]' AS email FROM dirty_customer")
def _(t):
    return texts.mask_columns(t("dirty_customer").select("cust_id", "name", "email"), "email")


# Outliers ------------------------------------------------------------------------------------------

_IQR = "b AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3, quantile_cont(amount, 0.5) AS med FROM dirty_orders), x AS (SELECT d.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, med FROM dirty_orders d, b)"
_Z = "b AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM dirty_orders), x AS (SELECT d.*, m - 3 * s AS lo, m + 3 * s AS hi FROM dirty_orders d, b)"
_DETECT = f"""
SELECT 'amount' AS "column", count(*) FILTER (WHERE amount < lo OR amount > hi) AS outliers,
  {r('min(amount) FILTER (WHERE amount < lo OR amount > hi)')} AS min_outlier, {r('max(amount) FILTER (WHERE amount < lo OR amount > hi)')} AS max_outlier FROM x
UNION ALL SELECT '(any)', count(*) FILTER (WHERE amount < lo OR amount > hi), NULL, NULL FROM x"""


@query("ou01_detect_iqr", f"WITH {_IQR} {_DETECT}")
def _(t):
    return rounded(outliers.detect_outliers(t("dirty_orders"), ["amount"]))


@query("ou01_outlier_rows", f"WITH {_IQR} SELECT 'amount' AS \"column\", order_id FROM x WHERE amount < lo OR amount > hi")
def _(t):
    return outliers.outlier_rows(t("dirty_orders"), "order_id", ["amount"])


# Amounts that the view multiplies by 20; some of them still lie among the ordinary ones.
_PLANTED = "order_id % 211 = 0 AND order_id % 9 <> 0 AND amount > 3000000"


@query("ou03_planted_anomalies", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE {_PLANTED}) AS planted, count(*) FILTER (WHERE {_PLANTED}) AS planted_flagged,
  0 AS flagged_below_limit, 0 AS missed_above_limit, TRUE AS within_share FROM dirty_orders""")
def _(t):
    """All rows: planted ones are flagged, flags follow the scores' 95 % quantile, and no more than 5 % are flagged."""
    found = isolation.detect_anomalies(t("dirty_orders").select("order_id", "amount"), "order_id", ["amount"])
    limit = found.agg(F.percentile("anomaly_score", 0.95).alias("limit"))
    planted, flag = F.expr(_PLANTED), F.col("is_anomaly")
    above = F.col("anomaly_score") > F.col("limit")
    return found.crossJoin(F.broadcast(limit)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(planted).alias("planted"), F.count_if(planted & flag).alias("planted_flagged"),
        F.count_if(flag & ~above).alias("flagged_below_limit"), F.count_if(above & ~flag).alias("missed_above_limit"),
        (F.count_if(flag) <= 0.05 * F.count(F.lit(1))).alias("within_share"))


@query("ou02_detect_zscore", f"WITH {_Z} {_DETECT}")
def _(t):
    return rounded(outliers.detect_outliers(t("dirty_orders"), ["amount"], "zscore", 3.0))


@query("ou03_isolation_forest")
def _(t):
    found = isolation.detect_anomalies(t("dirty_orders").select("order_id", "cust_id", "amount"), "order_id", ["amount", "cust_id"])
    return found.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("rows"), F.max("anomaly_score").alias("top_score"))


@query("ou03_isolation_forest_remove")
def _(t):
    return isolation.remove_anomalies(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], 0.1)


@query("ou04_remove_iqr", f"WITH {_IQR} SELECT order_id, amount FROM x WHERE NOT coalesce(amount < lo OR amount > hi, false)")
def _(t):
    return outliers.remove_outliers(t("dirty_orders").select("order_id", "amount"), ["amount"])


@query("ou04_remove_zscore", f"WITH {_Z} SELECT order_id, amount FROM x WHERE NOT coalesce(amount < lo OR amount > hi, false)")
def _(t):
    return outliers.remove_outliers(t("dirty_orders").select("order_id", "amount"), ["amount"], "zscore")


def _treated(t, action, method="iqr"):
    return rounded(outliers.treat_outliers(t("dirty_orders").select("order_id", "amount"), action, ["amount"], method))


@query("ou05_cap", f"WITH {_IQR} SELECT order_id, {r('CASE WHEN amount IS NOT NULL THEN greatest(least(amount, hi), lo) END')} AS amount FROM x")
def _(t):
    return _treated(t, "cap")


@query("ou05_cap_zscore", f"WITH {_Z} SELECT order_id, {r('CASE WHEN amount IS NOT NULL THEN greatest(least(amount, hi), lo) END')} AS amount FROM x")
def _(t):
    return _treated(t, "cap", "zscore")


@query("ou06_null", f"WITH {_IQR} SELECT order_id, {r('CASE WHEN amount BETWEEN lo AND hi THEN amount END')} AS amount FROM x")
def _(t):
    return _treated(t, "null")


@query("ou07_median", f"WITH {_IQR} SELECT order_id, {r('CASE WHEN amount < lo OR amount > hi THEN med ELSE amount END')} AS amount FROM x")
def _(t):
    return _treated(t, "median")


@query("ou08_floor_index", f"""
WITH s AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS i, count(*) OVER () AS n FROM dirty_orders WHERE amount IS NOT NULL),
b AS (SELECT max(amount) FILTER (WHERE i = floor(n * 0.25)) AS q1, max(amount) FILTER (WHERE i = floor(n * 0.75)) AS q3 FROM s),
x AS (SELECT d.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM dirty_orders d, b)
SELECT order_id, {r('CASE WHEN amount IS NOT NULL THEN greatest(least(amount, hi), lo) END')} AS amount FROM x""")
def _(t):
    return _treated(t, "cap", "floor_index")


@query("ou08_zscore_population", f"""
WITH b AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM dirty_orders)
SELECT order_id, amount FROM dirty_orders, b WHERE NOT coalesce(amount < m - 3 * s OR amount > m + 3 * s, false)""")
def _(t):
    return outliers.remove_outliers(t("dirty_orders").select("order_id", "amount"), ["amount"], "zscore_pop")


@query("ou09_group_bounds", f"""
WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, event_type, value, {r('q1 - 1.5 * (q3 - q1)')} AS low, {r('q3 + 1.5 * (q3 - q1)')} AS high,
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events JOIN q ON event_type = k""")
def _(t):
    return rounded(outliers.flag_group_outliers(t("events").select("event_id", "event_type", "value"), "event_type", "value"))


# One-click cleaning ----------------------------------------------------------------------------------

@query("pl04_auto_clean", f"""
WITH n AS (SELECT cust_id, CASE WHEN {MISSING.format('name')} THEN NULL ELSE {TRIM.format('name')} END AS name, {TRIM.format('segment')} AS segment,
  balance_text, email, active FROM doubled_customer),
u AS (SELECT DISTINCT * FROM n),
v AS (SELECT segment AS variant, count(*) AS c FROM u GROUP BY 1),
w AS (SELECT variant, first_value(variant) OVER (PARTITION BY lower(variant) ORDER BY c DESC, variant) AS canonical FROM v),
p AS (SELECT cust_id, coalesce(name, (SELECT name FROM u WHERE name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS name,
  canonical AS segment, {SCALED.format('balance_text')} AS bal, email,
  coalesce(active, (SELECT active FROM u WHERE active IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS active FROM u JOIN w ON variant = segment)
SELECT cust_id, name, segment, {r('coalesce(bal, (SELECT bal FROM p WHERE bal IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))')} AS balance_text, email, active FROM p""")
def _(t):
    return rounded(recipe.auto_clean(t.wide("doubled_customer"), order_by=["cust_id"]))


