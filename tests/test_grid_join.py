import pytest
from pyspark.sql import functions as F

from tablecraft.operators import joining, lookup
from tests.conftest import rows_of


def sides(spark):
    """Key 7 holds a third of both sides, key 8 a third of the left only, null a share of both, key 9 of the right only."""
    a = spark.range(1500).select(
        F.when(F.col("id") < 500, 7).when(F.col("id") < 1000, 8).when(F.col("id") < 1050, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(900).select(
        F.when(F.col("id") < 300, 7).when(F.col("id") < 600, 9).when(F.col("id") < 620, None).otherwise(F.col("id") + 500).alias("k"), F.col("id").alias("y"))
    return a, b


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_hot_keys_on_either_side(spark, monkeypatch, how, null_safe):
    a, b = sides(spark)
    for module in (lookup, joining):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joining, "fits_broadcast", lambda df: False)
    found = joining.join_tables(a, b, "k", "k", how, null_safe=null_safe)
    on = a["k"].eqNullSafe(b["k"]) if null_safe else a["k"] == b["k"]
    plain = a.join(b, on, how).select(F.coalesce(a["k"], b["k"]).alias("k"), "x", "y")
    assert found.columns == ["k", "x", "y"] and found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.count() == plain.count()


def test_the_sketch_names_the_hot_keys_of_both_sides(spark):
    a, b = sides(spark)
    heavy = lookup.heavy_keys(a, b, ["k"])
    hashes = {r["k"]: r["h"] for r in a.select("k").union(b.select("k")).distinct().select("k", F.xxhash64("k").alias("h")).collect()}
    assert (heavy.left_rows, heavy.right_rows) == (1500, 900)
    assert heavy.keys == {hashes[7]: (500, 300), hashes[8]: (500, 0), hashes[9]: (0, 300), hashes[None]: (50, 20)}
    grid = heavy.grid(8)
    assert grid[hashes[8]] == (8, 1) and grid[hashes[9]] == (1, 8) and min(grid[hashes[7]]) > 1
    assert heavy.turned().grid(8)[hashes[8]] == (1, 8)


def test_a_hot_key_of_both_sides_runs_in_several_tasks(spark):
    a, b = sides(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = lookup.grid_join(a.repartition(4).hint("merge"), b.repartition(4), ["k"], "left").where("k = 7").groupBy(
            F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in met) == 500 * 300 and len(met) > 2 and max(r["count"] for r in met) < 100_000


def test_empty_sides(spark):
    a, b = sides(spark)
    assert lookup.grid_join(a.limit(0), b, ["k"], "left").count() == 0
    assert lookup.grid_join(a, b.limit(0), ["k"], "left").count() == 1500
    assert rows_of(lookup.grid_join(a, b, ["k"], "left_anti").where("k = 8").agg(F.count("x"))) == [(500,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(found, a, b, how, null_safe=True):
    on = a["k"].eqNullSafe(b["k"]) if null_safe else a["k"] == b["k"]
    plain = a.join(b, on, how).select(F.coalesce(a["k"], b["k"]).alias("k"), "x", "y")
    told = lambda df: df.agg(*[F.count(c) for c in ("*", "k", "x", "y")], F.sum(F.xxhash64(*[F.coalesce(c, F.lit(-1)) for c in ("k", "x", "y")]).cast("decimal(38)"))).first()
    return found.columns == ["k", "x", "y"] and told(found) == told(plain)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("turned", [False, True])
def test_a_small_side_is_broadcast_whichever_it_is(spark, monkeypatch, how, turned):
    a, b = sides(spark)
    if turned:
        a, b = b.select("k", F.col("y").alias("x")), a.select("k", F.col("x").alias("y"))
    monkeypatch.setattr(joining, "BROADCAST_ROWS", 1000)  # of 1,500 and 900 rows
    found = joining.join_tables(a, b, "k", "k", how)
    assert "SortMergeJoin" not in plan_of(found) and same_rows(found, a, b, how)


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_a_side_of_some_broadcasts_is_cut_into_slices(spark, monkeypatch, how, null_safe):
    a, b = sides(spark)
    monkeypatch.setattr(joining, "BROADCAST_ROWS", 200)
    monkeypatch.setattr(joining, "TASK_PAIRS", 10_000)
    found = joining.join_tables(a, b, "k", "k", how, null_safe=null_safe)
    plan = plan_of(found)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 5
    assert same_rows(found, a, b, how, null_safe)


def test_copies_in_slices(spark, monkeypatch):
    a, b = sides(spark)
    a, b = a.union(a), b.union(b.where("k = 7"))
    monkeypatch.setattr(joining, "BROADCAST_ROWS", 200)
    assert joining.join_tables(a, b, "k", "k").where("k = 7").count() == 1000 * 600
    assert same_rows(joining.join_tables(a, b, "k", "k", "outer"), a, b, "outer")
