"""Projection, filter, duplicate, join, sort and recipe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions import cells
from tablecraft.operators import dedup, filters, joining, ordering, projection
from tablecraft.plans import flagship, recipe
from tablecraft.plans.catalogue.registry import query, r, rounded

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NUM = "TRY_CAST(regexp_replace({0}, '[$€£₹¥,%\\s]', '', 'g') AS DOUBLE)"
SCALED = ("CASE WHEN regexp_replace({0}, '[$€£₹¥,\\s]', '', 'g') LIKE '%\\%' ESCAPE '\\' THEN "
          "TRY_CAST(regexp_replace({0}, '[$€£₹¥,%\\s]', '', 'g') AS DOUBLE) / 100 ELSE "
          "TRY_CAST(regexp_replace({0}, '[$€£₹¥,%\\s]', '', 'g') AS DOUBLE) END")
MISSING = "({0} IS NULL OR lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) IN ('', 'null', 'none', 'nan', 'n/a', 'na', '-'))"


@query("flagship", f"""WITH v AS (SELECT {TRIM.format('segment')} AS variant, count(*) AS n FROM dirty_customer GROUP BY 1),
w AS (SELECT variant, first_value(variant) OVER (PARTITION BY lower(variant) ORDER BY n DESC, variant) AS segment FROM v),
g AS (SELECT w.segment, n_name, sum(o_totalprice) AS v FROM orders JOIN dirty_customer d ON o_custkey = cust_id JOIN w ON variant = {TRIM.format('d.segment')}
  JOIN customer ON c_custkey = cust_id JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25)
SELECT segment, n_name, {r('v')} AS value, {r('v * 100 / (SELECT sum(v) FROM g)')} AS share FROM g""")
def _(t):
    return flagship.segment_totals(t.spark, t.sf_dir)


# Projections ---------------------------------------------------------------------------------------

@query("pj01_chart_points", "SELECT o_orderdate, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def _(t):
    return projection.chart_points(t("orders"), ["o_orderdate", "o_totalprice", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query("pj02_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return projection.drop_columns(t("orders"), ["o_orderdate", "o_orderpriority", "not_there"])


@query("pj03_rename_columns", "SELECT s_suppkey AS supplier, s_name AS label, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return projection.rename_columns(t("supplier"), {"s_suppkey": "supplier", "s_name": "label", "nope": "x"})


@query("pj04_reorder_columns", "SELECT c_mktsegment, c_custkey, c_acctbal, c_name, c_nationkey FROM customer")
def _(t):
    return projection.reorder_columns(t("customer"), ["c_mktsegment", "c_custkey", "c_acctbal", "c_name", "c_nationkey"])


for _op, _name, _sql in (
    ("+", "add", "l_extendedprice + l_tax"),
    ("-", "subtract", "l_extendedprice - l_tax"),
    ("*", "multiply", "l_extendedprice * l_discount"),
    ("/", "divide", "CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END"),
    ("%", "modulo", "CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice - l_quantity * floor(l_extendedprice / l_quantity) END"),
):
    def _measure(t, op=_op):
        right = {"+": "l_tax", "-": "l_tax", "*": "l_discount", "/": "l_discount", "%": "l_quantity"}[op]
        out = projection.add_measure(t("lineitem"), "m", "l_extendedprice", op, right)
        return rounded(out.select("l_orderkey", "l_linenumber", "m"))

    query(f"pj05_measure_{_name}", f"SELECT l_orderkey, l_linenumber, {r(_sql)} AS m FROM lineitem")(_measure)


@query("pj05_measure_constant", f"SELECT cust_id, {r('(' + SCALED.format('balance_text') + ') * 2')} AS doubled FROM dirty_customer")
def _(t):
    return rounded(projection.add_measure(t("dirty_customer"), "doubled", "balance_text", "*", 2).select("cust_id", "doubled"))


@query("pj06_concat", "SELECT cust_id, concat_ws(' ', name, active) AS both FROM dirty_customer")
def _(t):
    return projection.add_measure(t("dirty_customer"), "both", "name", "CONCAT", "active").select("cust_id", "both")


@query("pj07_plus_joins_text", f"""
SELECT cust_id, CASE WHEN ({SCALED.format('balance_text')}) IS NOT NULL AND ({SCALED.format('name')}) IS NOT NULL THEN 'number'
  ELSE concat(coalesce(name, ''), coalesce(balance_text, '')) END AS joined FROM dirty_customer""")
def _(t):
    out = projection.add_measure(t("dirty_customer"), "joined", "name", "+", "balance_text", join_text=True)
    return out.select("cust_id", "joined")


@query("pj08_expression", f"""
SELECT cust_id, {r('CASE WHEN b > 100 THEN b * 1.1 + cust_id ELSE 0 END')} AS score
FROM (SELECT cust_id, {SCALED.format('balance_text')} AS b FROM dirty_customer)""")
def _(t):
    out = projection.add_expression(t("dirty_customer"), "score", "CASE WHEN balance_text > 100 THEN balance_text * 1.1D + cust_id ELSE 0 END")
    return rounded(out.select("cust_id", "score"))


@query("pj10_patch_cells", """
SELECT c.c_custkey, CASE WHEN c.c_acctbal < 0 THEN 'N ' || c.c_name ELSE c.c_name END AS c_name, c.c_nationkey,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
FROM customer c""")
def _(t):
    debt = t("customer").filter("c_acctbal < 0")
    edits = debt.select("c_custkey", F.lit("c_name").alias("column"), F.concat(F.lit("N "), "c_name").alias("value")).unionByName(
        debt.select("c_custkey", F.lit("c_acctbal").alias("column"), F.lit("n/a").alias("value")))
    return projection.patch_cells(t("customer"), edits, "c_custkey")


# Filters -------------------------------------------------------------------------------------------

for _op, _word in ((">", "gt"), ("<", "lt"), (">=", "ge"), ("<=", "le")):
    def _compare(t, op=_op):
        return filters.filter_rows(t("dirty_customer"), "balance_text", op, "5000")

    query(f"fi01_number_{_word}", f"SELECT * FROM dirty_customer WHERE ({SCALED.format('balance_text')}) {_op} 5000")(_compare)


@query("fi02_equals", f"SELECT * FROM dirty_customer WHERE lower({TRIM.format('segment')}) = 'building'")
def _(t):
    return filters.filter_rows(t("dirty_customer"), "segment", "==", " Building ")


@query("fi02_not_equals", f"SELECT * FROM dirty_customer WHERE lower({TRIM.format('active')}) IS DISTINCT FROM 'yes'")
def _(t):
    return filters.filter_rows(t("dirty_customer"), "active", "!=", "YES")


@query("fi03_contains", "SELECT * FROM dirty_customer WHERE contains(lower(segment), 'mach')")
def _(t):
    return filters.filter_rows(t("dirty_customer"), "segment", "contains", "MACH")


@query("fi04_is_null", f"SELECT * FROM dirty_customer WHERE {MISSING.format('name')}")
def _(t):
    return filters.filter_rows(t("dirty_customer"), "name", "is_null")


@query("fi04_not_null", f"SELECT * FROM dirty_customer WHERE NOT {MISSING.format('name')}")
def _(t):
    return filters.filter_rows(t("dirty_customer"), "name", "not_null")


@query("fi05_search", """
SELECT * FROM dirty_customer WHERE contains(lower(CAST(cust_id AS VARCHAR)), 'mail7') OR contains(lower(coalesce(name, '')), 'mail7')
  OR contains(lower(coalesce(segment, '')), 'mail7') OR contains(lower(coalesce(balance_text, '')), 'mail7')
  OR contains(lower(coalesce(email, '')), 'mail7') OR contains(lower(coalesce(active, '')), 'mail7')""")
def _(t):
    return filters.search_rows(t("dirty_customer"), "MAIL7")


_ANY = " OR ".join(MISSING.format(c) for c in ("name", "segment", "balance_text", "email", "active"))


@query("fi06_rows_with_missing", f"SELECT * FROM dirty_customer WHERE {_ANY}")
def _(t):
    return filters.rows_with_missing(t("dirty_customer"))


@query("fi07_duplicate_rows", """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1""")
def _(t):
    return dedup.repeated_rows(t("events").select("event_id", "user_id", "event_type"), ["event_id"])


@query("fi08_drop_missing_one", f"SELECT * FROM dirty_customer WHERE NOT {MISSING.format('active')}")
def _(t):
    return filters.drop_missing(t("dirty_customer"), ["active"])


@query("fi09_drop_missing_any", f"SELECT * FROM dirty_customer WHERE NOT ({_ANY})")
def _(t):
    return filters.drop_missing(t("dirty_customer"))


@query("fi10_finite_filter", "SELECT order_id, ratio FROM dirty_orders WHERE NOT isnan(ratio) AND ratio > 1000")
def _(t):
    clean = t("dirty_orders").withColumn("ratio", cells.finite_or_null("ratio"))
    return clean.filter("ratio > 1000").select("order_id", "ratio")


# Duplicates ----------------------------------------------------------------------------------------

@query("dd01_distinct_rows", "SELECT DISTINCT * FROM doubled_customer")
def _(t):
    return dedup.distinct_rows(t("doubled_customer"))


_RANKED = """SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {0}) AS n,
    count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) WHERE {1}"""


@query("dd02_keep_first", _RANKED.format("", "n = 1"))
def _(t):
    return dedup.dedup(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "first", ["event_id"])


@query("dd02_keep_last", _RANKED.format("DESC", "n = 1"))
def _(t):
    return dedup.dedup(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "last", ["event_id"])


@query("dd02_keep_none", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE c = 1")
def _(t):
    return dedup.dedup(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "none", ["o_orderkey"])


@query("dd03_normalized", f"""
SELECT cust_id, segment FROM (SELECT cust_id, segment,
  row_number() OVER (PARTITION BY lower({TRIM.format("coalesce(segment, '')")}) ORDER BY cust_id) AS n FROM doubled_customer) WHERE n = 1""")
def _(t):
    rows = t("doubled_customer").select("cust_id", "segment")
    return dedup.dedup(rows, ["segment"], "first", ["cust_id"], normalize="trim_lower")


@query("dd04_duplicate_count", """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM doubled_customer GROUP BY cust_id, name, segment, balance_text, email, active)""")
def _(t):
    return dedup.duplicate_count(t("doubled_customer"))


# Joins ---------------------------------------------------------------------------------------------

_SIDES = """a AS (SELECT c_custkey, c_name, CASE c_nationkey WHEN 3 THEN NULL WHEN 4 THEN 104 ELSE c_nationkey END AS nk, c_acctbal AS bal FROM customer),
b AS (SELECT s_suppkey, CASE s_nationkey WHEN 3 THEN NULL WHEN 5 THEN 205 ELSE s_nationkey END AS nk, s_acctbal AS bal FROM supplier)"""


def _sides(t):
    def key(c, lone, name):  # one key is null on both sides, one of each side has no partner
        return F.when(F.col(c) == lone, name).when(F.col(c) != 3, F.col(c)).alias("nk")

    a = t("customer").select("c_custkey", "c_name", key("c_nationkey", 4, 104), F.col("c_acctbal").alias("bal"))
    b = t("supplier").select("s_suppkey", key("s_nationkey", 5, 205), F.col("s_acctbal").alias("bal"))
    return a, b


for _how, _word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    def _join(t, how=_how):
        a, b = _sides(t)
        return joining.join_tables(a, b, "nk", "nk", how)

    query(f"jn01_{_how}", f"""WITH {_SIDES}
SELECT coalesce(a.nk, b.nk) AS nk, a.c_custkey, a.c_name, a.bal AS bal_file1, b.s_suppkey, b.bal AS bal_file2
FROM a {_word} JOIN b ON a.nk IS NOT DISTINCT FROM b.nk""")(_join)


@query("jn01_two_keys", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    return joining.join_tables(t("orders"), t("customer"), "o_custkey", "c_custkey", "left", null_safe=False)


# Sorting -------------------------------------------------------------------------------------------

def _placed(rows):
    """The rows with their place in the order they come in."""
    return ordering.row_index(rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"], name="place").drop("_at")


@query("so01_sort_rows", f"SELECT cust_id, balance_text, row_number() OVER (ORDER BY ({SCALED.format('balance_text')}) ASC NULLS LAST, lower(balance_text) NULLS LAST, cust_id) - 1 AS place FROM dirty_customer")
def _(t):
    return _placed(filters.sort_rows(t("dirty_customer").select("cust_id", "balance_text"), "balance_text", True, ["cust_id"]))


@query("so02_nulls_last", "SELECT order_id, amount, row_number() OVER (ORDER BY amount DESC NULLS LAST, order_id) - 1 AS place FROM dirty_orders")
def _(t):
    return _placed(filters.sort_nulls_last(t("dirty_orders").select("order_id", "amount"), "amount", False, ["order_id"]))


@query("so03_top_k", f"SELECT l_partkey, {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY l_partkey ORDER BY sum(l_extendedprice) DESC, l_partkey LIMIT 30")
def _(t):
    sums = t("lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("total"))
    return rounded(filters.top_k(sums, "total", 30, ["l_partkey"]), 2)


@query("so04_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    found = filters.filter_rows(t("orders"), "o_totalprice", ">", 100000).select("o_orderkey", "o_totalprice")
    return filters.page(filters.sort_nulls_last(found, "o_totalprice", False, ["o_orderkey"]), 3, 25)


# Recipes -------------------------------------------------------------------------------------------

RECIPE = [
    {"action": "null_tokens"},
    {"action": "drop_duplicates", "subset": ["cust_id"], "order_by": ["cust_id"]},
    {"action": "normalize_categories", "column": "segment"},
    {"action": "to_numeric", "column": "balance_text"},
    {"action": "impute", "column": "balance_text", "method": "median"},
    {"action": "cap_outliers", "columns": ["balance_text"]},
]

_CLEAN = f"""
u AS (SELECT DISTINCT cust_id, CASE WHEN {MISSING.format('name')} THEN NULL ELSE name END AS name, segment, balance_text, email, active FROM doubled_customer),
v AS (SELECT {TRIM.format('segment')} AS variant, count(*) AS n FROM u GROUP BY 1),
w AS (SELECT variant, first_value(variant) OVER (PARTITION BY lower(variant) ORDER BY n DESC, variant) AS canonical FROM v),
p AS (SELECT u.cust_id, name, coalesce(w.canonical, u.segment) AS segment, {SCALED.format('u.balance_text')} AS bal, email, active
      FROM u LEFT JOIN w ON w.variant = {TRIM.format('u.segment')}),
q AS (SELECT cust_id, name, segment, coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM p)) AS bal, email, active FROM p),
f AS (SELECT quantile_cont(bal, 0.25) AS q1, quantile_cont(bal, 0.75) AS q3 FROM q)"""


@query("pl01_recipe", f"""WITH {_CLEAN.strip()}
SELECT cust_id, name, segment, {r('greatest(least(bal, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))')} AS balance_text, email, active FROM q, f""")
def _(t):
    return rounded(recipe.run_recipe(t("doubled_customer"), RECIPE))


@query("pl01_step_effects", f"""WITH a AS (SELECT *, {MISSING.format('name')} AS no_name, CASE WHEN {MISSING.format('name')} THEN NULL ELSE name END AS told FROM doubled_customer),
n AS (SELECT count(*) AS whole, count_if(name IS NOT NULL AND no_name) AS tokens, count_if(told <> {TRIM.format('told')}) + count_if(segment <> {TRIM.format('segment')}) AS trimmed,
  count(DISTINCT cust_id) AS single, count(DISTINCT cust_id) FILTER (WHERE active IS NOT NULL) AS kept,
  count(DISTINCT cust_id) FILTER (WHERE active IS NOT NULL AND balance_text IS NOT NULL) AS numbers,
  count(DISTINCT cust_id) FILTER (WHERE active IS NOT NULL AND balance_text IS NULL) AS gaps FROM a)
SELECT 1 AS step, 'null_tokens' AS action, whole AS rows_before, whole AS rows_after, tokens AS cells_changed, 6 AS columns FROM n
UNION ALL SELECT 2, 'trim', whole, whole, trimmed, 6 FROM n UNION ALL SELECT 3, 'drop_duplicates', whole, single, 0, 6 FROM n
UNION ALL SELECT 4, 'drop_missing', single, kept, 0, 6 FROM n UNION ALL SELECT 5, 'to_numeric', kept, kept, numbers, 6 FROM n
UNION ALL SELECT 6, 'impute', kept, kept, gaps, 6 FROM n UNION ALL SELECT 7, 'unheard_of', kept, kept, 0, 6 FROM n""")
def _(t):
    _, effects = recipe.run_counted(t("doubled_customer"), [
        {"action": "null_tokens"}, {"action": "trim"}, {"action": "drop_duplicates", "subset": ["cust_id"], "order_by": ["cust_id"]},
        {"action": "drop_missing", "columns": ["active"]}, {"action": "to_numeric", "column": "balance_text"},
        {"action": "impute", "column": "balance_text", "method": "median"}, {"action": "unheard_of"}])
    return effects


@query("pl02_undo_redo", f"""WITH {_CLEAN.strip()}
SELECT cust_id, name, segment, {r('bal')} AS balance_text, email, active FROM p""")
def _(t):
    history = recipe.History(t("doubled_customer"), RECIPE)
    return rounded(history.undo().undo().undo().redo().current())


@query("pl01_change_log", """
SELECT 1 AS step, 'trim' AS action, (SELECT count(*) FROM doubled_customer) AS rows, 6 AS columns
UNION ALL SELECT 2, 'drop_columns', (SELECT count(*) FROM doubled_customer), 5
UNION ALL SELECT 3, 'drop_missing', (SELECT count(*) FROM doubled_customer WHERE active IS NOT NULL), 5
UNION ALL SELECT 4, 'unheard_of', (SELECT count(*) FROM doubled_customer WHERE active IS NOT NULL), 5""")
def _(t):
    return recipe.change_log(t("doubled_customer"), [
        {"action": "trim"}, {"action": "drop_columns", "columns": ["email"]},
        {"action": "drop_missing", "columns": ["active"]}, {"action": "unheard_of"}])
