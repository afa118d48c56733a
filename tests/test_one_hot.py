import pytest

from pyspark.sql import functions as F

from tablecraft.operators import learning


@pytest.mark.parametrize("limit", [10_000, 10])
def test_a_wide_text_feature_stays_one_hot(spark, monkeypatch, limit):
    monkeypatch.setattr(learning, "MAX_LEVELS", limit)
    level = F.concat(F.lit("w"), F.lpad((F.col("id") % 30).cast("string"), 2, "0"))
    rows = spark.range(900).select("id", level.alias("w"), (F.col("id") % 7).cast("double").alias("x"))
    # The target follows the level without order, so a plain number cannot tell it.
    rows = rows.withColumn("y", (F.pmod(F.xxhash64("w"), F.lit(100)) + F.col("x")).cast("double"))
    run = learning.train(rows, "y", ["w", "x"], ["id"], "regression", models=["Linear Regression", "Ridge Regression"], one_hot=True)
    board = {r[0]: r[1] for r in run.rows}
    assert all(score > 0.999 for score in board.values()) and len(board) == 2
    slots = learning.slot_features(run, run.models["Linear Regression"])
    assert slots.count("x") == 1 and 30 <= slots.count("w") <= 31
    strange = run.predictions("Linear Regression", learning.coded(rows.limit(1).withColumns({"w": F.lit("new"), "label_raw": F.lit(0.0)}), run.codes))
    assert strange.count() == 1 and strange.first()["prediction"] is not None


def test_a_wide_text_feature_without_one_hot_is_its_place(spark, monkeypatch):
    monkeypatch.setattr(learning, "MAX_LEVELS", 10)
    rows = spark.range(300).select("id", F.lpad((F.col("id") % 30).cast("string"), 2, "0").alias("w"), (F.col("id") % 30 * 2.0).alias("y"))
    run = learning.train(rows, "y", ["w"], ["id"], "regression", models=["Linear Regression"])
    assert learning.slot_features(run, run.models["Linear Regression"]) == ["w"] and run.rows[0][1] > 0.999
