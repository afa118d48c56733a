"""The ways taken beyond the measured size limits, against brute force, with one key holding a third of the rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import charts, isolation, joining, learning, lookup, missing, neighbours, ordering, quantiles, statistics
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; key 0 holds a third of them; every fourth value is missing."""
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("int").alias("k"),
        F.when(F.col("id") % 4 != 1, (F.col("id") * 37 % 1009).cast("double")).alias("x"),
    ).cache()


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_fill_over_buckets(skewed, buckets):
    pdf = skewed.toPandas().sort_values(["k", "id"])
    for backward in (False, True):
        fill = missing.backward_fill if backward else missing.forward_fill
        got = fill(skewed, ["x"], ["id"], ["k"], buckets=buckets).toPandas().sort_values(["k", "id"])["x"]
        grouped = pdf.groupby("k")["x"]
        want = grouped.bfill() if backward else grouped.ffill()
        assert [None if math.isnan(v) else v for v in got] == [None if math.isnan(v) else v for v in want]


def test_fill_carries_over_empty_buckets(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 3, 5.0).alias("x"))
    got = missing.forward_fill(df, ["x"], ["id"], buckets=9)
    assert got.filter("x = 5.0").count() == 397
    again = missing.forward_fill(got, ["x"], ["id"], buckets=9)
    assert rows_of(again) == rows_of(got)


@pytest.mark.parametrize("buckets", [None, 7])
def test_row_index(skewed, buckets):
    got = ordering.row_index(skewed, ["id"], ["k"], "t", buckets).toPandas().sort_values(["k", "id"])
    assert (got["t"] == got.groupby("k").cumcount()).all()
    whole = ordering.row_index(skewed, ["id"], name="t", buckets=buckets).toPandas()
    assert (whole["t"] == whole["id"]).all()


def test_buckets_are_ordered_and_balanced(skewed):
    work, whole = ordering.with_buckets(skewed, ["k"], ["id"], 7)
    assert not whole
    sizes = work.groupBy("_bucket").count().toPandas()
    assert len(sizes) == 7 and sizes["count"].max() < 3000 / 7 * 2
    pdf = work.select("k", "id", "_bucket").toPandas().sort_values(["k", "id"])
    assert pdf["_bucket"].is_monotonic_increasing


@pytest.mark.parametrize("by", [[], ["k"]])
def test_ranked_quantiles(skewed, by):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exact = quantiles.group_quantiles(skewed, by, "x", probs)
    ranked = quantiles.group_quantiles(skewed, by, "x", probs, max_distinct=0)
    a = {r[:-1]: r["q"] for r in exact.collect()}
    b = {r[:-1]: r["q"] for r in ranked.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert b[key] == pytest.approx(a[key])


def test_column_quantiles_paths(skewed):
    small = quantiles.column_quantiles(skewed, ["x"], [0.25, 0.5])
    large = quantiles.column_quantiles(skewed, ["x"], [0.25, 0.5], max_distinct=0)
    assert large["x"] == pytest.approx(small["x"])
    assert quantiles.column_quantiles(skewed.filter("x < -1"), ["x"], [0.5], max_distinct=0) == {"x": None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(skewed, how):
    right = skewed.filter("k % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = lookup.salted_join(skewed, right, ["k"], how, salts=5)
    assert rows_of(got) == rows_of(skewed.join(right, "k", how).select(*got.columns))


def test_salted_join_spreads_copies(spark):
    copies = spark.range(2000, numPartitions=8).select(F.lit(1).alias("k"))
    names = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert lookup.salted_join(copies, names, ["k"], "left", salts=4).groupBy("v").count().first()["count"] == 2000


def test_attach_beyond_broadcast(skewed):
    stats = skewed.groupBy("k").agg(F.avg("x").alias("m"))
    assert rows_of(lookup.attach(skewed, stats, ["k"], max_rows=1)) == rows_of(lookup.attach(skewed, stats, ["k"]))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_without_broadcast(spark, skewed, how, monkeypatch):
    a = skewed.select("id", F.when(F.col("k") != 7, F.col("k")).alias("k"), "x")
    b = spark.range(40).select(F.when(F.col("id") != 7, F.col("id").cast("int")).alias("k"), (F.col("id") * 2.0).alias("x"))
    small = rows_of(joining.join_tables(a, b, "k", "k", how))
    monkeypatch.setattr(joining, "fits_broadcast", lambda df: False)
    assert rows_of(joining.join_tables(a, b, "k", "k", how)) == small
    monkeypatch.undo()
    plain = joining.join_tables(a, b, "k", "k", how, balance=False)
    assert rows_of(plain) == small
    pa, pb = a.toPandas(), b.toPandas()
    pa["k"], pb["k"] = pa["k"].astype("Int64"), pb["k"].astype("Int64")
    assert len(small) == len(pd.merge(pa, pb, on="k", how=how))


def test_blocked_neighbours_match_brute_force(spark):
    points = [(i, [float((i * 7) % 13), float((i * 5) % 11)], i % 3) for i in range(120)]
    df = spark.createDataFrame(points, "id bigint, v array<double>, label int")
    one = rows_of(neighbours.nearest(df, df, "id", "v", "label", 4, exclude_self=True))
    blocked = rows_of(neighbours.nearest(df, df, "id", "v", "label", 4, exclude_self=True, block_rows=25))
    assert blocked == one
    brute = sorted(((math.dist(points[0][1], p[1]), p[0]) for p in points[1:]))[:4]
    got = sorted((r["dist"], r["neighbour"]) for r in neighbours.nearest(df, df.filter("id = 0"), "id", "v", "label", 4, exclude_self=True).collect())
    assert [g[1] for g in got] == [b[1] for b in brute]


def test_stratified_split_is_exact_and_repeatable(skewed):
    a, b = learning.stratified_split(skewed, ["id"], "k")
    sizes = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    for r in a.groupBy("k").count().collect():
        assert r["count"] == math.floor(sizes[r["k"]] * 0.8 + 0.5)
    again, _ = learning.stratified_split(skewed, ["id"], "k")
    assert rows_of(a) == rows_of(again) and a.count() + b.count() == 3000


def test_histogram_counts_everything(skewed):
    h = charts.histogram(skewed, "x")
    assert h.agg(F.sum("count")).first()[0] == skewed.filter("x is not null").count()
    assert h.count() == 20
    flat = charts.histogram(skewed.withColumn("x", F.lit(3.0)), "x").collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in flat] == [(2.5, 3.5, 3000)]


def test_spearman_with_ties(spark):
    rows = [(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (3.0, 30.0), (4.0, 5.0)]
    got = statistics.spearman_pairs(spark.createDataFrame(rows, "a double, b double")).first()["r"]
    want = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert got == pytest.approx(want)


def test_spearman_beyond_broadcast(skewed, monkeypatch):
    names = ["k", "x", "id"]
    small = rows_of(statistics.spearman_pairs(skewed, names))
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    large = rows_of(statistics.spearman_pairs(skewed, names))
    assert [r[:3] for r in large] == [r[:3] for r in small]
    assert [r[3] for r in large] == pytest.approx([r[3] for r in small])
    ranks = skewed.toPandas().dropna()[names].rank().corr()
    assert {(r[0], r[1]): round(r[3], 9) for r in small} == {(a, b): round(ranks.loc[a, b], 9) for a, b in (("k", "x"), ("k", "id"), ("x", "id"))}


def test_isolation_forest_finds_planted_points(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") < 10, 500.0 + F.col("id")).otherwise((F.col("id") * 37 % 101).cast("double")).alias("a"),
        F.when(F.col("id") < 10, -400.0).otherwise((F.col("id") * 53 % 97).cast("double")).alias("b"))
    found = isolation.detect_anomalies(df, "id", ["a", "b"], 0.02)
    hits = {r["id"] for r in found.filter("is_anomaly").collect()}
    assert set(range(10)) <= hits
    again = isolation.detect_anomalies(df, "id", ["a", "b"], 0.02)
    assert rows_of(again, "id", "anomaly_score") == rows_of(found, "id", "anomaly_score")


def test_text_with_many_levels_is_coded_alike(spark, monkeypatch):
    """An index on the driver and a table of levels give the same model and the same predictions."""
    rows = [(i, f"w{i % 40:02d}", None if i % 9 == 0 else f"x{i % 3}", float(i % 40) * 2 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, word string, few string, y double")
    results = []
    for levels in (10_000, 10):
        monkeypatch.setattr(learning, "MAX_LEVELS", levels)
        run = learning.train(df, "y", ["word", "few"], ["id"], "regression", ["Decision Tree"])
        assert list(run.codes) == (["word"] if levels == 10 else [])
        changes = [{}, {"word": "w07"}, {"word": "unseen"}]
        scored = learning.score_scenarios(run, df, ["id"], changes).collect()
        added = learning.append_predictions(run, df).collect()
        results.append((sorted(map(tuple, scored)), sorted((r["id"], r["Predicted_Value"]) for r in added)))
    assert results[0] == results[1]



def test_recipe_steps_share_passes():
    from tablecraft.plans.recipe import fuse

    steps = [{"action": "impute", "column": "a"}, {"action": "fill_missing", "column": "b", "method": "mode"},
             {"action": "impute", "column": "a", "method": "mean"}, {"action": "normalize_categories", "column": "c"},
             {"action": "normalize_categories", "column": "d"}, {"action": "trim"}]
    assert fuse(steps) == [
        {"action": "impute_columns", "methods": {"a": "median", "b": "mode"}}, {"action": "impute_columns", "methods": {"a": "mean"}},
        {"action": "normalize_columns", "columns": ["c", "d"]}, {"action": "trim"}]
