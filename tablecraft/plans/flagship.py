"""Flagship query: clean customers with a recipe, join their orders, total by segment with shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.operators.charts import treemap
from tablecraft.plans.catalogue.registry import load, rounded
from tablecraft.plans.recipe import run_recipe

RECIPE = [
    {"action": "null_tokens"},
    {"action": "normalize_categories", "column": "segment"},
    {"action": "to_numeric", "column": "balance_text"},
    {"action": "impute", "column": "balance_text", "method": "median"},
    {"action": "treat_outliers", "columns": ["balance_text"]},
]


def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment, n_name, value, share`` of the 25 largest order totals per segment and nation."""
    people = run_recipe(load(spark, sf_dir, "dirty_customer"), RECIPE)
    places = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    rows = (
        orders.join(people, F.col("o_custkey") == F.col("cust_id"))
        .join(places, F.col("cust_id") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return rounded(treemap(rows, "segment", "o_totalprice", "n_name"))
