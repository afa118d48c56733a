"""Hand-derived results on the small tables."""

from pyspark.sql import functions as F

from tablecraft.operators import dedup, forecast, learning, missing, outliers, profile, statistics, texts, typing_ops
from tablecraft.plans import recipe
from tests.conftest import rows_of


def test_duplicates_and_nulls(landed):
    assert rows_of(dedup.duplicate_count(landed)) == [(4, 1)]
    assert missing.missing_report(landed).agg(F.sum("missing")).first()[0] == 2


def test_quality_scores(landed):
    assert profile.quality_score(landed, "browser").first()["score"] == 75
    assert profile.quality_score(landed, "server").first()["score"] == 63


def test_auto_clean(employees):
    got = {r["Name"]: (r["Age"], r["Salary"], r["Department"]) for r in recipe.auto_clean(employees, order_by=["Name"]).collect()}
    assert got == {"Rahul": (23.0, 50000.0, "HR"), "Amit": (24.0, 55000.0, "HR"), "Priya": (25.0, 52500.0, "HR")}


def test_column_types(churn):
    kinds = {r["column"]: r["primary_type"] for r in typing_ops.tell_column_type(churn).collect()}
    assert kinds["Annual_Income"] == "currency"
    assert kinds["Churned"] == "boolean"
    assert kinds["Spending_Score"] == "integer"


def test_problem_type(churn):
    assert learning.problem_type(churn, "Churned") == "classification"
    assert learning.problem_type(churn, None) == "clustering"


def test_department_aliases(spark):
    df = spark.createDataFrame([("Human  Resources",), ("IT",), ("it",), ("Sales",), ("sales",), ("Sales",)], "Department string")
    assert rows_of(texts.normalize_categories(df, "Department")) == [("HR",), ("IT",), ("IT",), ("Sales",), ("Sales",), ("Sales",)]


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"), 7), (2.0, None, float("inf"), 7), (3.0, None, 1.0, 7)], "a double, b double, c double, d int")
    pairs = {(r["a"], r["b"]): r["r"] for r in statistics.correlation_pairs(missing.nan_to_null(df)).collect()}
    assert pairs[("a", "d")] is None and pairs[("a", "b")] is None
    stats = {r["column"]: r for r in profile.numeric_stats(df).collect()}
    assert stats["b"]["median"] is None and stats["b"]["count"] == 0
    assert stats["c"]["count"] == 1 and stats["d"]["std"] == 0.0


def test_constant_over_many_tasks(spark):
    """Merged partial aggregates must not turn a constant into noise."""
    df = spark.range(997, numPartitions=8).select(F.lit(0.1).alias("c"), (F.col("id") * 0.37).alias("x"), "id")
    assert statistics.correlation_pairs(df, ["c", "x"]).first()["r"] is None
    assert statistics.trend_line(df, "c", "x").first()["slope"] is None
    assert outliers.fit_bounds(df, ["c"], "zscore") == {}
    assert profile.normality(df, ["c"]).first()["skewness"] is None
    assert profile.numeric_stats(df, ["c"]).first()["std"] == 0.0
    fits = forecast.fit_trends(forecast.series(df, ["id"], "c")).collect()
    assert {(f["model"], f["r2"], f["slope"], f["sigma"]) for f in fits} == {("linear", 1.0, 0.0, 0.0), ("poly", 1.0, 0.0, 0.0)}


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, s string")
    assert dedup.duplicate_count(df).first()["duplicates"] == 0
    assert outliers.remove_outliers(df).count() == 0
    assert missing.fill_missing(df, {"a": "mean", "s": "mode"}).count() == 0
    assert profile.metadata_profile(df).count() == 2


def test_single_row(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, s string")
    assert profile.full_profile(df).count() == 2
    assert outliers.treat_outliers(df).first()["a"] == 1.0


def test_fill_keeps_whole_numbers_without_gaps(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "i bigint, x double")
    assert dict(missing.bulk_fill(df).dtypes) == {"i": "bigint", "x": "double"}


def test_capping_leaves_gaps(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,), (1000.0,)], "x double")
    out = outliers.treat_outliers(df, "cap")
    assert out.filter("x is null").count() == 1 and out.agg(F.max("x")).first()[0] < 1000


def test_unknown_action_changes_nothing(landed):
    assert rows_of(recipe.run_recipe(landed, [{"action": "dance"}])) == rows_of(landed)


def test_history(landed):
    h = recipe.History(landed).push({"action": "drop_columns", "columns": ["Age"]}).push({"action": "drop_duplicates"})
    assert h.current().count() == 3
    assert h.undo().current().count() == 4
    assert h.redo().current().count() == 3
    assert h.reset().current().columns == landed.columns
    assert h.push({"action": "trim"}).recipe == [{"action": "trim"}]


def test_run_logged(landed):
    out, log = recipe.run_logged(landed, [{"action": "drop_duplicates"}, {"action": "drop_missing"}])
    out.collect()
    assert [(name, seen.get["rows"]) for name, seen in log] == [("drop_duplicates", 3), ("drop_missing", 1)]
