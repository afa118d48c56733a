"""Model queries. Metrics, neighbours, splits and linear attributions have SQL twins; fitted models do not."""

from __future__ import annotations


from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from tablecraft.operators import learning, metrics, neighbours, tree_values
from tablecraft.plans.catalogue.charts import SHIPPED, shipped
from tablecraft.plans.catalogue.registry import query, r, rounded
from tablecraft.session import store

ITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]  # together unique
ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "p_retailprice"]
ORDER_KEYS = ["o_orderkey"]
ORDER_FEATURES = ["o_totalprice", "o_orderpriority", "c_mktsegment", "c_acctbal"]


def items(t) -> DataFrame:
    return t("lineitem").join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))


def placed(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))


def regression_run(t, *models, **options):
    return learning.train(items(t), "l_extendedprice", ITEM_FEATURES, ITEM_KEYS, "regression", list(models) or None, **options)


def class_run(t, *models, **options):
    return learning.train(placed(t), "o_orderstatus", ORDER_FEATURES, ORDER_KEYS, "classification", list(models) or None, **options)


def quality_run(t, *models, **options):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars", "lang", "source"), "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return learning.train(rows, "quality", ["n_chars", "lang", "source"], ["doc_id"], "classification", list(models) or None, **options)


# Problem type, features, splits ------------------------------------------------------------------------

def _problem_sql(table: str, c: str, text: bool) -> str:
    if text:
        return f"SELECT '{c}' AS target, 'classification' AS server, 'classification' AS simple"
    return f"""SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 15 OR count(DISTINCT {c}) * 1.0 / count({c}) < 0.05 THEN 'classification' ELSE 'regression' END AS server,
  CASE WHEN count(DISTINCT {c}) > 10 THEN 'regression' ELSE 'classification' END AS simple FROM {table}"""


@query("ml01_problem_type", " UNION ALL ".join(_problem_sql("lineitem", c, c == "l_returnflag") for c in ("l_extendedprice", "l_linenumber", "l_quantity", "l_returnflag")))
def _(t):
    rows = t("lineitem")
    names = ("l_extendedprice", "l_linenumber", "l_quantity", "l_returnflag")
    found = [(c, learning.problem_type(rows, c), learning.problem_type(rows, c, "simple")) for c in names]
    return t.spark.createDataFrame(found, "target string, server string, simple string")


@query("ml02_preprocess", "SELECT count(*) AS rows, " + ", ".join(f"CAST(0 AS DOUBLE) AS mean_{i}, CAST(1 AS DOUBLE) AS std_{i}" for i in range(5)) + " FROM lineitem")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    data = store(learning.prepare(items(t), ITEM_FEATURES, "l_extendedprice", "regression", ITEM_KEYS))  # joined once for all passes
    fitted = Pipeline(stages=learning.feature_stages(data, ITEM_FEATURES)).fit(data).transform(data)
    values = fitted.select(*ITEM_KEYS, vector_to_array("features").alias("f"))
    return values.agg(F.count(F.lit(1)).alias("rows"), *[(F.round(F.avg(F.col("f")[i]), 6) + 0.0).alias(f"mean_{i}") for i in range(len(ITEM_FEATURES))],
                      *[F.round(F.stddev_samp(F.col("f")[i]), 6).alias(f"std_{i}") for i in range(len(ITEM_FEATURES))])


@query("ml03_stratified_split", """SELECT o_orderstatus, part, CAST(n AS BIGINT) AS n FROM (
  SELECT o_orderstatus, 'train' AS part, round(count(*) * 0.8) AS n FROM orders GROUP BY 1
  UNION ALL SELECT o_orderstatus, 'test', count(*) - round(count(*) * 0.8) FROM orders GROUP BY 1)""")
def _(t):
    a, b = learning.stratified_split(t("orders"), ORDER_KEYS, "o_orderstatus")
    parts = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))
    return parts.groupBy("o_orderstatus", "part").agg(F.count(F.lit(1)).alias("n"))


@query("ml03_hash_split")
def _(t):
    a, b = learning.hash_split(t("orders"), ORDER_KEYS)
    return a.agg(F.count(F.lit(1)).alias("train")).withColumn("test", F.lit(b.count()))


# Models --------------------------------------------------------------------------------------------------

def _board(run, t):
    return rounded(run.leaderboard(t.spark), 6)


@query("ml04_linear_regression")
def _(t):
    return _board(regression_run(t, "Linear Regression"), t)


_OLS = """WITH m AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM m),
c AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ca, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS cb FROM s),
w AS (SELECT *, my - ca * ma - cb * mb AS c0 FROM c)"""


@query("ml04_linear_coefficients", f"""{_OLS} SELECT 'l_quantity' AS term, {r('ca')} AS coefficient FROM w UNION ALL SELECT 'l_discount', {r('cb')} FROM w UNION ALL SELECT 'intercept', {r('c0')} FROM w""")
def _(t):
    return rounded(learning.linear_coefficients(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


@query("ml05_ridge_regression")
def _(t):
    return rounded(learning.feature_importance(regression_run(t, "Ridge Regression")), 4)


@query("ml06_logistic_regression")
def _(t):
    return _board(class_run(t, "Logistic Regression", one_hot=True), t)


@query("ml07_decision_tree")
def _(t):
    return _board(class_run(t, "Decision Tree"), t).unionByName(_board(regression_run(t, "Decision Tree"), t).toDF(*_CLASS_BOARD))


_CLASS_BOARD = ["model", "score", "accuracy", "precision", "recall", "f1", "error"]


@query("ml08_random_forest")
def _(t):
    return _board(regression_run(t, "Random Forest"), t)


@query("ml09_gradient_boosting")
def _(t):
    return _board(quality_run(t, "Gradient Boosting"), t)


_NEAR = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS label FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rank FROM d)"""


@query("ml10_nearest_neighbours", f"{_NEAR} SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, label, {r('dist', 6)} AS dist FROM k WHERE rank <= 5")
def _(t):
    rows = t("embeddings")
    return rounded(neighbours.nearest(rows, rows, "vec_id", "embedding", "label", 5, exclude_self=True), 6)


@query("ml10_knn_classify", f"""{_NEAR}, w AS (SELECT vec_id, label, sum(1 / (dist + 1e-5)) AS w FROM k WHERE rank <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(w, 9) DESC, label) AS i, sum(w) OVER (PARTITION BY vec_id) AS total FROM w)
SELECT vec_id, label AS predicted, {r('w / total', 6)} AS confidence FROM b WHERE i = 1""")
def _(t):
    rows = t("embeddings")
    return rounded(neighbours.knn_classify(rows, rows, "vec_id", "embedding", "label", 5, exclude_self=True), 6)


@query("ml10_approximate_neighbours")
def _(t):
    rows = t("embeddings")
    found = neighbours.approximate_neighbours(rows, rows, "embedding", "vec_id", 1.3, exclude_self=True)
    return found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("near"))


def _customers(t):
    return t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")))


@query("ml11_kmeans_profile")
def _(t):
    _, profile, inertia = learning.cluster(_customers(t), ["c_acctbal", "c_nationkey"], 3)
    return rounded(profile.withColumn("inertia", F.lit(inertia)), 4)


@query("ml11_kmeans_labels")
def _(t):
    labelled, _, _ = learning.cluster(_customers(t), ["c_acctbal", "c_nationkey"], 3)
    return labelled.select("c_custkey", "ML_Cluster")


@query("ml11_kmeans_unassigned", "SELECT c_custkey, 'Unassigned' AS \"ML_Cluster\" FROM customer WHERE c_custkey % 50 = 0")
def _(t):
    labelled, _, _ = learning.cluster(_customers(t), ["c_acctbal", "c_nationkey"], 3)
    return labelled.filter("ML_Cluster = 'Unassigned'").select("c_custkey", "ML_Cluster")


@query("ml12_cross_validation")
def _(t):
    data = learning.prepare(items(t), ITEM_FEATURES, "l_extendedprice", "regression", ITEM_KEYS).withColumnRenamed("label_raw", "label")
    return rounded(learning.cross_validate(data, ITEM_FEATURES, ITEM_KEYS, LinearRegression(), "regression"), 6)


# Metrics over tables of labels and predictions ---------------------------------------------------------------

@query("ml13_regression_metrics", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT count(*) AS n, {r('avg((y - p) * (y - p))', 2)} AS mse, {r('sqrt(avg((y - p) * (y - p)))', 2)} AS rmse, {r('avg(abs(y - p))', 2)} AS mae,
  {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 2)} AS r2 FROM p""")
def _(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return rounded(metrics.regression_metrics(rows), 2)


_GUESS = f"g AS (SELECT o_orderstatus AS y, CASE WHEN l_quantity > 35 THEN 'P' WHEN l_discount > 0.04 THEN 'F' ELSE 'O' END AS p FROM {SHIPPED})"


def guesses(t):
    rows = shipped(t)
    guess = F.when(F.col("l_quantity") > 35, "P").when(F.col("l_discount") > 0.04, "F").otherwise("O")
    return rows.select(F.col("o_orderstatus").alias("label"), guess.alias("prediction"))


_PER_CLASS = f"""{_GUESS}, c AS (SELECT unnest(['F', 'O', 'P']) AS class),
k AS (SELECT class, count(*) FILTER (WHERE y = class) AS support, count(*) FILTER (WHERE p = class) AS predicted, count(*) FILTER (WHERE y = class AND p = class) AS tp FROM c, g GROUP BY 1),
m AS (SELECT class, support, tp, tp * 1.0 / predicted AS precision, tp * 1.0 / support AS recall FROM k),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m)"""


@query("ml14_class_metrics", f"WITH {_PER_CLASS} SELECT class, support, tp, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM f")
def _(t):
    return rounded(metrics.class_metrics(guesses(t)))


@query("ml14_classification_metrics", f"""WITH {_PER_CLASS} SELECT CAST(sum(support) AS BIGINT) AS n, {r('sum(tp) / sum(support)')} AS accuracy,
  {", ".join(f"{r(f'sum({m} * support) / sum(support)')} AS weighted_{m}, {r(f'avg({m})')} AS macro_{m}" for m in ("precision", "recall", "f1"))} FROM f""")
def _(t):
    return rounded(metrics.classification_metrics(guesses(t)))


@query("ml14_auc")
def _(t):
    run = class_run(t, "Logistic Regression")
    return t.spark.createDataFrame([(round(learning.training_auc(run), 6),)], "auc double")


@query("ml14_auc_exact", f"""WITH s AS (SELECT l_extendedprice AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
k AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n / 2.0 AS below FROM s)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, {r('sum(p * below) / (sum(p) * 1.0 * sum(n))', 9)} AS auc FROM k""")
def _(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("is"))
    return rounded(metrics.rank_auc(rows, "score", "is"), 9)


@query("ml17_importance_one_hot", "SELECT 2 AS features, TRUE AS whole, 'l_returnflag' AS first")
def _(t):
    rows = t("lineitem").withColumn("target", F.when(F.col("l_returnflag") == "A", 100.0).when(F.col("l_returnflag") == "N", 50.0).otherwise(0.0))
    run = learning.train(rows, "target", ["l_quantity", "l_returnflag"], ITEM_KEYS, "regression", ["Linear Regression"], one_hot=True)
    found = learning.feature_importance(run)
    return found.agg(F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("share_pct") - 100) < 1e-6).alias("whole"),
                     F.max_by("feature", "importance").alias("first"))


@query("ml15_confusion_matrix", f"""WITH {_GUESS} SELECT y AS label, {", ".join(f"count(*) FILTER (WHERE p = '{c}') AS \"{c}\"" for c in "FOP")} FROM g GROUP BY 1""")
def _(t):
    return metrics.confusion_matrix(guesses(t), ["F", "O", "P"])


@query("ml16_leaderboard")
def _(t):
    return _board(quality_run(t), t)


@query("ml17_feature_importance")
def _(t):
    return rounded(learning.feature_importance(regression_run(t, "Decision Tree")), 6)


@query("ml17_permutation_importance")
def _(t):
    return rounded(learning.permutation_importance(regression_run(t, "Linear Regression"), ITEM_KEYS), 6)


@query("ml18_linear_shap", f"""WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS q, regr_slope(l_extendedprice, l_discount) AS d, regr_slope(l_extendedprice, l_tax) AS t,
  avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM lineitem)
SELECT 'l_quantity' AS feature, {r('avg(abs(q * (l_quantity - mq)))', 2)} AS mean_abs_shap FROM lineitem, c
UNION ALL SELECT 'l_discount', {r('avg(abs(d * (l_discount - md)))', 2)} FROM lineitem, c UNION ALL SELECT 'l_tax', {r('avg(abs(t * (l_tax - mt)))', 2)} FROM lineitem, c""")
def _(t):
    rows = t("lineitem")
    names = ("l_quantity", "l_discount", "l_tax")
    slopes = rows.agg(*[F.regr_slope("l_extendedprice", c).alias(c) for c in names]).first().asDict()
    return rounded(learning.linear_shap(rows, slopes), 2)


@query("ml18_linear_shap_joint", f"""{_OLS}
SELECT 'l_quantity' AS feature, {r('avg(abs(ca * (a - ma)))', 2)} AS mean_abs_shap FROM m, w UNION ALL SELECT 'l_discount', {r('avg(abs(cb * (b - mb)))', 2)} FROM m, w""")
def _(t):
    rows = t("lineitem")
    fitted = learning.linear_coefficients(rows, "l_extendedprice", ["l_quantity", "l_discount"]).collect()
    return rounded(learning.linear_shap(rows, {x["term"]: x["coefficient"] for x in fitted if x["term"] != "intercept"}), 2)


@query("ml18_sampled_shap")
def _(t):
    return rounded(learning.sampled_shap(regression_run(t, "Decision Tree"), ITEM_KEYS), 4)


# A target that a tree of two splits holds exactly: 0 up to 25 pieces, then 50 or, with a discount over 5 %, 100.
_STEPS = "CASE WHEN l_quantity <= 25 THEN 0.0 WHEN l_discount > 0.05 THEN 100.0 ELSE 50.0 END"


@query("ml18_tree_values", f"""WITH m AS (SELECT avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN l_discount > 0.05 THEN 100.0 ELSE 50.0 END) FILTER (WHERE l_quantity > 25) AS v FROM lineitem),
g AS (SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS many,
  CASE WHEN l_discount > 0.05 THEN 100.0 ELSE 50.0 END AS price, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT quantity, discount, n, {r('p * v', 4)} AS base, {r('((many * v - p * v) + (many * price - p * price)) / 2', 4)} AS of_quantity,
  {r('((p * price - p * v) + (many * price - many * v)) / 2', 4)} AS of_discount FROM g, m""")
def _(t):
    rows = t("lineitem").select(*ITEM_KEYS, F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"),
                                F.expr(_STEPS).cast("double").alias("label"))
    ready = VectorAssembler(inputCols=["quantity", "discount"], outputCol="features").transform(rows)
    model = DecisionTreeRegressor(maxDepth=2, maxBins=256).fit(ready)
    told = tree_values.explained(ready, model, ["quantity", "discount"], ["quantity", "discount"])
    value = lambda c: F.col("contributions")[c]
    return rounded(told.groupBy("quantity", "discount").agg(
        F.count(F.lit(1)).alias("n"), F.max("base").alias("base"), F.max(value("quantity")).alias("of_quantity"), F.max(value("discount")).alias("of_discount")), 4)


@query("ml18_tree_values_sum", """SELECT unnest(['Decision Tree', 'Gradient Boosting', 'Random Forest', 'Decision Tree, three classes', 'Random Forest, three classes']) AS model, 0 AS different, TRUE AS every_row""")
def _(t):
    total = F.col("base") + F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)
    found = []
    for run, keys, suffix in ((quality_run(t, "Decision Tree", "Random Forest", "Gradient Boosting"), ["doc_id"], ""),
                              (class_run(t, "Decision Tree", "Random Forest"), ORDER_KEYS, ", three classes")):
        for name in sorted(run.models):
            answer = "rawPrediction" if name == "Gradient Boosting" else "probability"
            # Both sides are stored: the tasks of a join carry its whole plan, and the model in it.
            scored = store(run.predictions(name, run.train).select(*keys, F.posexplode(vector_to_array(answer)).alias("place", "answer")))
            label = F.get(F.array(*[F.lit(c) for c in run.labels]), "place")
            told = store(tree_values.tree_values(run, keys, name).select(*keys, "output", total.alias("total")))
            both = told.join(scored.withColumn("output", label), [*keys, "output"])
            outputs = 1 if name == "Gradient Boosting" else len(run.labels)
            row = both.agg(F.count_if(F.abs(F.col("total") - F.col("answer")) > 1e-9).alias("off"), F.count(F.lit(1)).alias("n")).first()
            found.append((name + suffix, row["off"], row["n"] == run.train.count() * outputs))
    return t.spark.createDataFrame(found, "model string, different int, every_row boolean")


@query("ml18_tree_shap")
def _(t):
    return rounded(tree_values.tree_shap(regression_run(t, "Random Forest"), ITEM_KEYS), 6)


@query("ml19_scenarios")
def _(t):
    run = class_run(t, "Decision Tree")
    changes = [{}, {"o_orderpriority": "1-URGENT"}, {"o_totalprice": 1000.0, "c_mktsegment": "BUILDING"}]
    return rounded(learning.score_scenarios(run, placed(t), ORDER_KEYS, changes), 6)


# Invariants: what a fitted model reports agrees with its scored rows, whatever was fitted.

def _recomputed(t, run, keys) -> DataFrame:
    """``model, same``: whether the leaderboard's score follows from the model's held-out rows.

    Each model's rows are stored, as the tasks of an aggregate or join carry its whole plan, and the model in it.
    """
    found = []
    for model, score, *_ in run.rows:
        rows = store(learning.actual_vs_predicted(run, keys, model).drop(*keys))
        if run.problem == "regression":
            e = F.col("actual") - F.col("prediction")
            again = rows.agg((1 - F.sum(e * e) / (F.var_pop("actual") * F.count(F.lit(1)))).alias("s"))
        else:
            per = rows.groupBy("actual").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("tp")).join(
                rows.groupBy(F.col("prediction").alias("actual")).agg(F.count(F.lit(1)).alias("p")), "actual", "left")
            f1 = 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))
            again = per.agg((F.sum(f1 * F.col("n")) / F.sum("n")).alias("s"))
        found.append((model, abs(again.first()["s"] - score) < 1e-9))
    return t.spark.createDataFrame(found, "model string, same boolean")


@query("ml05_scores_from_rows", "SELECT unnest(['Linear Regression', 'Ridge Regression', 'Decision Tree', 'Random Forest']) AS model, TRUE AS same")
def _(t):
    return _recomputed(t, regression_run(t, "Linear Regression", "Ridge Regression", "Decision Tree", "Random Forest"), ITEM_KEYS)


@query("ml06_scores_from_rows", "SELECT unnest(['Logistic Regression', 'Decision Tree', 'Random Forest', 'Gradient Boosting']) AS model, TRUE AS same")
def _(t):
    return _recomputed(t, quality_run(t), ["doc_id"])


@query("ml19_empty_scenario", "SELECT count(*) AS rows, 0 AS changed FROM orders")
def _(t):
    run = class_run(t, "Decision Tree")
    plain = run.predictions(df=learning.prepare(placed(t), ORDER_FEATURES, keys=ORDER_KEYS)).select("o_orderkey", F.col("predicted_label").alias("own"))
    both = learning.score_scenarios(run, placed(t), ORDER_KEYS, [{}]).join(plain, "o_orderkey")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_label") != F.col("own")).cast("int").alias("changed"))


@query("pj09_every_row", "SELECT count(*) AS rows, 0 AS different FROM lineitem")
def _(t):
    run = regression_run(t, "Linear Regression")
    added = learning.append_predictions(run, items(t).select(*ITEM_KEYS, *ITEM_FEATURES))
    scored = run.predictions(df=learning.prepare(items(t), ITEM_FEATURES, keys=ITEM_KEYS)).select(*ITEM_KEYS, "prediction")
    both = added.join(scored, ITEM_KEYS)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("Predicted_Value") - F.col("prediction")) > 1e-9).cast("int").alias("different"))


@query("ml11_profile_from_rows", "SELECT count(*) AS customers, 0 AS different FROM customer WHERE c_custkey % 50 <> 0")
def _(t):
    labelled, profile, _ = learning.cluster(_customers(t), ["c_acctbal", "c_nationkey"], 3)
    means = labelled.filter("ML_Cluster <> 'Unassigned'").groupBy("ML_Cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("a"), F.avg("c_nationkey").alias("b"))
    off = (F.col("n") != F.col("size")) | (F.abs(F.col("a") - F.col("avg_c_acctbal")) > 1e-6) | (F.abs(F.col("b") - F.col("avg_c_nationkey")) > 1e-9)
    return means.join(profile, "ML_Cluster").agg(F.sum("n").alias("customers"), F.count_if(off).cast("int").alias("different"))


@query("ml03_hash_split_rows", "SELECT count(*) AS rows, 0 AS twice, TRUE AS near_share FROM orders")
def _(t):
    a, b = learning.hash_split(t("orders"), ORDER_KEYS)
    both = a.withColumn("train", F.lit(1)).unionByName(b.withColumn("train", F.lit(0)))
    per = both.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("train").alias("train"))
    return per.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).cast("int").alias("twice"), F.avg("train").between(0.77, 0.83).alias("near_share"))


# Targets that follow from the features by a rule: a tree that has enough depth predicts every row right.

_LANE = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'plain' END"""


def lanes(t) -> DataFrame:
    return placed(t).withColumn("lane", F.expr(_LANE))


def lane_run(t, *models):
    return learning.train(lanes(t), "lane", ["o_orderpriority", "c_mktsegment"], ORDER_KEYS, "classification", list(models))


def _lane_rows(t, run) -> DataFrame:
    ready = learning.prepare(lanes(t), ["o_orderpriority", "c_mktsegment"], keys=ORDER_KEYS)
    return run.predictions(df=ready).select("o_orderkey", F.col("predicted_label").alias("lane"))


_LANES_SQL = f"SELECT o_orderkey, {_LANE} AS lane FROM orders JOIN customer ON o_custkey = c_custkey"


@query("ml21_labels", _LANES_SQL)
def _(t):
    return _lane_rows(t, lane_run(t, "Decision Tree"))


@query("ml09_three_classes", _LANES_SQL)
def _(t):
    return _lane_rows(t, lane_run(t, "Gradient Boosting"))


@query("ml08_classifier", "SELECT 'Random Forest' AS model, TRUE AS same")
def _(t):
    return _recomputed(t, class_run(t, "Random Forest"), ORDER_KEYS)


def step_run(t):
    rows = t("lineitem").withColumn("steps", F.expr(_STEPS).cast("double"))
    return learning.train(rows, "steps", ["l_quantity", "l_discount"], ITEM_KEYS, "regression", ["Linear Regression", "Ridge Regression", "Decision Tree"])


@query("ml16_board", "SELECT 'Decision Tree' AS best, 3 AS models, CAST(1 AS DOUBLE) AS score, TRUE AS in_order")
def _(t):
    run = step_run(t)
    board = run.leaderboard(t.spark).select("model", "score").collect()  # one row for each model
    scores = [x["score"] for x in board]
    found = [(run.best if run.best == board[0]["model"] else None, len(board), round(max(scores), 9), scores == sorted(scores, reverse=True))]
    return t.spark.createDataFrame(found, "best string, models int, score double, in_order boolean")


@query("ml20_rows", f"SELECT CAST(steps AS DOUBLE) AS actual, 0 AS different, TRUE AS near_share FROM (SELECT DISTINCT {_STEPS} AS steps FROM lineitem)")
def _(t):
    found = learning.actual_vs_predicted(step_run(t), ITEM_KEYS, "Decision Tree")
    held = found.groupBy("actual").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.abs("delta") > 1e-9) | (F.abs(F.col("prediction") - F.col("actual")) > 1e-9)).cast("int").alias("different"))
    rows = t("lineitem").groupBy(F.expr(_STEPS).cast("double").alias("actual")).agg(F.count(F.lit(1)).alias("all"))
    return held.join(rows, "actual").select("actual", "different", (F.col("n") / F.col("all")).between(0.15, 0.25).alias("near_share"))


@query("ml12_folds", "SELECT 5 AS folds, TRUE AS same_mean, TRUE AS same_std")
def _(t):
    data = learning.prepare(t("lineitem"), ["l_quantity"], "l_extendedprice", "regression", ITEM_KEYS).withColumnRenamed("label_raw", "label")
    told = learning.cross_validate(data, ["l_quantity"], ITEM_KEYS, LinearRegression(), "regression").first()
    rows = data.withColumn("fold", F.pmod(F.xxhash64(*ITEM_KEYS, F.lit(learning.SEED)), F.lit(5)))
    lines = t.spark.range(5).withColumnRenamed("id", "out").join(rows, F.col("fold") != F.col("out")).groupBy("out").agg(
        F.regr_slope("label", "l_quantity").alias("slope"), F.regr_intercept("label", "l_quantity").alias("start"))
    e = F.col("label") - F.col("slope") * F.col("l_quantity") - F.col("start")
    per = rows.join(F.broadcast(lines), F.col("fold") == F.col("out")).groupBy("fold").agg(
        (1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"))  # five lines
    return per.agg(F.count(F.lit(1)).cast("int").alias("folds"), (F.abs(F.avg("r2") - told["mean"]) < 1e-9).alias("same_mean"),
                   (F.abs(F.stddev_pop("r2") - told["std"]) < 1e-9).alias("same_std"))


@query("ml20_actual_vs_predicted")
def _(t):
    return rounded(learning.actual_vs_predicted(regression_run(t, "Linear Regression"), ITEM_KEYS), 4)


@query("ml21_batch_predictions")
def _(t):
    run = class_run(t, "Decision Tree")
    return run.predictions(df=learning.prepare(placed(t), ORDER_FEATURES, keys=ORDER_KEYS)).select("o_orderkey", "predicted_label", F.round("confidence", 6).alias("confidence"))


@query("pj09_append_predictions")
def _(t):
    return learning.append_predictions(regression_run(t, "Linear Regression"), items(t).select(*ITEM_KEYS, *ITEM_FEATURES))


@query("ml22_save_and_load", "SELECT count(*) AS rows, 0 AS different FROM lineitem")
def _(t):
    run = regression_run(t, "Linear Regression")
    path = t.scratch()
    learning.save_model(run.models[run.best], path)
    ready = learning.prepare(items(t), ITEM_FEATURES, keys=ITEM_KEYS)
    again = learning.load_model(path).transform(ready).select(*ITEM_KEYS, F.col("prediction").alias("reloaded"))
    both = run.predictions(df=ready).select(*ITEM_KEYS, "prediction").join(again, ITEM_KEYS)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") != F.col("reloaded")).alias("different"))
