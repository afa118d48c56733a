import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablecraft.operators import learning


@pytest.mark.parametrize("target, kind", [("two", GBTClassifier), ("three", OneVsRest)])
def test_boosting_of_levels_is_fitted_on_their_numbers_of_rows(spark, monkeypatch, target, kind):
    """Levels tell the class of most rows only, so the numbers of rows matter."""
    draw = F.pmod(F.xxhash64("id"), F.lit(10))
    rows = spark.range(600).withColumns({"p": F.concat(F.lit("p"), F.col("id") % 5), "q": F.concat(F.lit("q"), F.floor(F.col("id") / 5) % 4)}).withColumns({
        "two": F.when((F.col("p") > "p2") & (draw < 8), "yes").otherwise("no"),
        "three": F.when((F.col("p") > "p2") & (draw < 8), "a").when((F.col("q") > "q1") & (draw > 2), "b").otherwise("c")})
    fitted, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, data, params=None: fitted.append(data.count()) or fit(self, data, params))
    told = {}
    for most in (learning.MOST_KINDS, 0):
        monkeypatch.setattr(learning, "MOST_KINDS", most)
        run = learning.train(rows, target, ["p", "q"], ["id"], "classification", ["Gradient Boosting"], rounds=4)
        found = run.predictions(df=learning.prepare(rows, ["p", "q"], keys=["id"])).orderBy("id").select("predicted_label", vector_to_array("probability").alias("c"))
        told[most] = run.rows[0], found.collect()
    assert fitted[0] <= 5 * 4 * 3 and fitted[1] > 400
    (few, x), (all_rows, y) = told.values()
    assert few[0] == all_rows[0] and few[1:6] == pytest.approx(all_rows[1:6])
    assert [r["predicted_label"] for r in x] == [r["predicted_label"] for r in y]
    assert [c for r in x for c in r["c"]] == pytest.approx([c for r in y for c in r["c"]])


def test_a_number_among_the_features_makes_endless_kinds(spark):
    rows = spark.range(60).selectExpr("id", "concat('p', id % 3) AS p", "id % 7 AS n", "CAST(NULL AS INT) AS e")
    ready = learning.Pipeline(stages=learning.feature_stages(rows, ["p", "n"])).fit(rows)
    assert learning._kinds(ready, ["p", "n"], []) == float("inf")
    ready = learning.Pipeline(stages=learning.feature_stages(rows, ["p"])).fit(rows)
    assert learning._kinds(ready, ["p", "e"], ["e"]) == 4
