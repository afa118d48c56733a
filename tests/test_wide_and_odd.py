"""Rules that must not change with width, number of values or kind of model."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import charts, learning, neighbours, ordering, outliers, profile, recommend, statistics
from tablecraft.sources import files, web


@pytest.mark.parametrize("width", [5, 60, 200])
def test_correlation_is_pairwise_complete_at_every_width(spark, width):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 1))
    data = pd.DataFrame(base + rng.normal(size=(300, width)), columns=[f"c{i}" for i in range(width)])
    data["c1"] = 7.3
    data.loc[::4, "c2"] = np.nan
    data.loc[1::3, "c3"] = np.nan
    data.loc[data.index % 2 == 0, "c4"] = data["c0"].iloc[0]
    data.loc[data.index % 2 == 1, "c4"] = np.nan
    found = {(r["a"], r["b"]): r for r in statistics.correlation_pairs(spark.createDataFrame(data)).collect()}
    assert len(found) == width * (width - 1) // 2
    wanted = data.corr()
    for (a, b), r in found.items():
        both = data[[a, b]].dropna()
        assert r["n"] == len(both)
        if both[a].nunique() < 2 or both[b].nunique() < 2:
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(wanted.loc[a, b], abs=1e-9)


def test_charts_cover_all_rows(spark):
    df = spark.createDataFrame([(f"k{i:02d}", f"s{i}", float(i), f"International Sales {i % 2}") for i in range(30)], "k string, s string, v double, l string")
    fall = charts.waterfall(df, "k", "v").collect()
    assert [r["label"] for r in fall[-2:]] == ["Remaining", "Net Total"] and fall[-1]["end"] == sum(range(30)) == fall[-2]["end"]
    assert len(charts.series_matrix(df, "l", "s", "v").columns) == 31
    assert sorted(r["value"] for r in charts.label_totals(df, "l", "v").collect()) == [210.0, 225.0]
    assert len(outliers.outlier_rows(spark.range(400).select("id", F.when(F.col("id") < 80, 1e6).otherwise(F.col("id")).alias("v")), "id", ["v"]).collect()) == 80


def test_nan_is_a_gap(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", nan, 3.0), ("b", 4.0, 1.0), ("b", math.inf, 5.0), ("b", 8.0, 0.0)], "k string, v double, w double")
    assert {r["k"]: r["value"] for r in charts.chart_query(df, "k", "v", "AVG").collect()} == {"a": 1.0, "b": 6.0}
    one = statistics.pair_strength(df, "v", "w").first()
    assert one["n"] == 3 and one["r"] < 0


def test_profiles_of_many_columns(spark):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(25)) for i in range(4)], [f"n{j}" for j in range(25)])
    assert profile.dataset_analysis(df).filter("mean IS NOT NULL").count() == 25
    assert profile.target_suggestions(df).count() == 25


def test_two_thousand_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 3).alias("p"))
    got = ordering.row_index(df, ["k"], ["p"], "i", buckets=2000)
    bad = got.join(df.selectExpr("k AS kk", "p AS pp", "row_number() OVER (PARTITION BY p ORDER BY k) - 1 AS j"), F.expr("k = kk AND p = pp")).filter("i <> j")
    assert got.count() == 20_000 and bad.count() == 0


def test_three_classes(spark):
    rows = [(i, float(i % 10), float(i % 7), ("lo", "mid", "hi")[0 if i % 10 < 3 else 1 if i % 10 < 7 else 2], ("x", "y")[i % 2], None) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t string, w string, empty double")
    run = learning.train(df, "t", ["a", "b", "w", "empty"], ["id"], "classification", ["Gradient Boosting", "Logistic Regression"], rounds=3, one_hot=True)
    assert run.left_out == ["empty"] and run.best
    for name in run.models:
        shares = {r["feature"]: r["share_pct"] for r in learning.feature_importance(run, name).collect()}
        assert sum(shares.values()) == pytest.approx(100) and max(shares, key=shares.get) == "a"
        assert learning.training_auc(run, name) > 0.9
    shap = learning.sampled_shap(run, ["id"], "Gradient Boosting", rows=20, background=10, permutations=2).collect()
    assert shap[0]["feature"] == "a"
    scored = run.predictions("Gradient Boosting").select("confidence").collect()
    assert all(1 / 3 <= r["confidence"] <= 1 for r in scored)


def test_neighbours_by_both_ways(spark):
    rows = [(i, [float(i % 13), float(i % 5)], str(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, l string")
    near = lambda n: sorted(map(tuple, neighbours.nearest(df, df, "id", "v", "l", 4, True, n).collect()))
    assert near(neighbours.BLOCK_ROWS) == near(30)


def test_files_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,t\n1,plain\n2,\"x, y\"\n".encode())
    (tmp_path / "b.csv").write_bytes("id,t\n3,café\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("id,t\n4,\"two\nlines é\"\n5,end\n".encode())
    got = {r["id"]: r["t"] for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: "plain", 2: "x, y", 3: "café", 4: "two\nlines é", 5: "end"}


def test_chart_advice_without_numbers(spark):
    df = spark.createDataFrame([(f"n{i % 3}", str(i * 1.5), f"t{i}") for i in range(60)], "name string, amount string, note string")
    rows = recommend.recommend_charts(df, "none").collect()
    assert [(r["chart"], r["x"], r["y"]) for r in rows] == [("bar", "name", "amount"), ("doughnut", "name", "amount"), ("horizontalBar", "name", "amount")]


@pytest.mark.parametrize("html, title, names, rows", [
    ("<h3>T</h3><div><table><tr><th>a<th>b<tr><td>1<td>2</table></div>", "T (Table #1)", ["a", "b"], 1),
    ("<table id='my-list'><tbody><tr><td>a</td><td></td></tr><tr><td>1</td><td>n/a</td></tr></tbody></table>", "My List", ["a", "Column_2"], 1),
    ("<table title=' x '><thead><tr><td>a</td></tr></thead><tbody><tr><td>1</td></tr><tr><td>-</td></tr></tbody></table>", "x", ["a"], 1),
    ("<section><strong>S</strong><table><caption>C</caption><tr><td>a</td></tr><tr><td>1</td></tr></table></section>", "C", ["a"], 1),
])
def test_tables_of_several_shapes(html, title, names, rows):
    [(kind, found, cells, full, width)] = web._page_tables(html)
    assert (kind, found, full, width) == ("html_table", title, rows, len(names))
    assert [c[2] for c in cells[:width]] == names


def test_layout_tables_are_passed_over():
    assert web._page_tables("<nav><table><tr><td>a</td></tr><tr><td>1</td></tr></table></nav><table role=presentation><tr><td>a<tr><td>1</table>") == []
