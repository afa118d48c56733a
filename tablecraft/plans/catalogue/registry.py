"""Registry of runnable queries and, where SQL can say the same, their equivalent SQL text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.session import ensure_checkpoint_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Views with planted defects; the same text runs in Spark and in other SQL engines.
VIEWS = {
    "dirty_customer": """
SELECT c_custkey AS cust_id,
  CASE WHEN c_custkey % 11 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS name,
  CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 97 = 0 THEN '$999,999'
       WHEN c_custkey % 13 = 0 THEN concat(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR(20)), '%')
       ELSE concat('$', CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR(20))) END AS balance_text,
  concat('user', CAST(c_custkey AS VARCHAR(20)), '@mail', CAST(c_nationkey AS VARCHAR(20)), '.com') AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE NULL END AS active
FROM {customer}""",
    # Customers in debt were loaded twice.
    "doubled_customer": """
SELECT d.* FROM ({dirty_customer}) d
UNION ALL
SELECT d.* FROM ({dirty_customer}) d JOIN {customer} c ON c.c_custkey = d.cust_id WHERE c.c_acctbal < 0""",
    "dirty_orders": """
SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderdate AS order_ts,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 100 END AS ratio,
  CAST(7 AS INT) AS const_col, CAST(NULL AS DOUBLE) AS empty_col
FROM {orders}""",
    "gappy_events": """
SELECT event_id, ts, user_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, props
FROM {events}""",
}
# Views that were computed above may be used by name in SQL text.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def _view_text(name: str) -> str:
    text = VIEWS[name].strip()
    for inner in VIEWS:
        if "{" + inner + "}" in text:
            text = text.replace("{" + inner + "}", _view_text(inner))
    return text


def load(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A given table, or one of the views over the given tables; ``wide`` spreads scans of few splits."""
    if name in TABLES:
        scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(scan) if wide else scan
    text = _view_text(name)
    used = {t: load(spark, sf_dir, t, wide) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """SQL text with the views it names put in front."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql.strip()
    parts = []
    for v in used:
        text = _view_text(v)
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{v} AS ({text})")
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t(name)`` loads a table; ``t.spark`` and ``t.scratch()`` are at hand."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


class Source:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def wide(self, name: str) -> DataFrame:
        """As calling, for steps that are heavy per row."""
        return load(self.spark, self.sf_dir, name, wide=True)

    def scratch(self) -> str:
        """A new folder in the cluster's shared checkpoint location."""
        return f"{ensure_checkpoint_dir(self.spark)}/tablecraft-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns rounded for presentation, with one zero."""
    kinds = dict(df.dtypes)
    return df.select(*[
        (F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
        for c in df.columns
    ])


def r(expression: str, digits: int = 4) -> str:
    """The same rounding in SQL text."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"
