"""Training, scoring and comparing MLlib models on tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.cells import finite_or_null
from tablecraft.operators.lookup import _q, attach
from tablecraft.operators.metrics import auc, classification_metrics, regression_metrics
from tablecraft.operators.ordering import row_index
from tablecraft.operators.projection import as_number, is_numeric
from tablecraft.operators.quantiles import column_medians
from tablecraft.session import materialize, store

SEED = 42
MAX_LEVELS = 10_000
FAILED_SCORE = -999.0
# Different vectors and classes up to which boosting is fitted on their numbers of rows.
MOST_KINDS = 100_000
# Slots of a vector that ``sampled_shap`` hands over as numbers.
MOST_SLOTS = 1_000


def problem_type(df: DataFrame, target: str | None, rule: str = "server") -> str:
    """classification, regression or clustering (no target), from one aggregate."""
    if target is None:
        return "clustering"
    if not is_numeric(df, target):
        return "classification"
    counts = df.select(target).dropna().groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("n")).first()
    distinct = row["levels"]
    if rule == "simple":
        return "regression" if distinct > 10 else "classification"
    few = distinct <= 15 or distinct / max(row["n"] or 0, 1) < 0.05
    return "classification" if few else "regression"


def model_input(df: DataFrame, c: str) -> Column:
    if is_numeric(df, c):
        return finite_or_null(as_number(df, c))
    return F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))


def wide_text(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Text features with too many levels for an index on the driver; ``code_tables`` has theirs."""
    words = [c for c in features if not is_numeric(df, c)]
    if not words:
        return []
    levels = df.agg(*[F.approx_count_distinct(c).alias(c) for c in words]).first()
    return [c for c in words if levels[c] > MAX_LEVELS]


def code_tables(df: DataFrame, words: Sequence[str]) -> dict[str, tuple[DataFrame, int]]:
    """For each text feature a stored table of its levels, numbered in alphabetical order as an indexer numbers them, and how many."""
    out = {}
    for c in words:
        table = materialize(row_index(df.select(model_input(df, c).alias(c)).distinct(), [c], name="_code"))
        out[c] = table, table.count()
    return out


def coded(rows: DataFrame, codes: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """The levels of wide text features replaced by their numbers; a level not seen in training gets the next number."""
    for c, (table, n) in codes.items():
        joined = attach(rows, table, [c], is_stored=True)
        rows = joined.withColumn(c, F.coalesce("_code", F.lit(n)).cast("double")).drop("_code").select(*rows.columns)
    return rows


def prepare(df: DataFrame, features: Sequence[str], target: str | None = None, problem: str = "regression",
            keys: Sequence[str] = (), codes: Mapping[str, tuple[DataFrame, int]] | None = None) -> DataFrame:
    """Typed inputs: numbers parsed, text gaps Unknown, rows without a target dropped, ``label_raw`` added."""
    cols = [model_input(df, c).alias(c) for c in features]
    if target is None:
        return coded(df.select(*keys, *cols), codes or {})
    label = as_number(df, target) if problem == "regression" else F.col(target).cast("string")
    return coded(df.select(*keys, *cols, label.alias("label_raw")).filter("label_raw is not null"), codes or {})


class MedianImputer(Estimator):
    """``Imputer`` with exact medians that pass as bins, not as values: its own quantile sketch without error holds every value in one task."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str]):
        super().__init__()
        self.inputs, self.outputs = list(inputs), list(outputs)

    def _fit(self, dataset: DataFrame):
        medians = column_medians(dataset, self.inputs)
        schema = ", ".join(f"{_q(c)} double" for c in self.inputs)
        one = dataset.sparkSession.createDataFrame([tuple(medians[c] for c in self.inputs)], schema)
        return Imputer(strategy="median", inputCols=self.inputs, outputCols=self.outputs).fit(one)


def feature_stages(df: DataFrame, features: Sequence[str], one_hot: bool = False, numbered: Sequence[str] = ()) -> list:
    """Index text, impute medians, assemble, scale; fitted inside the training split only.

    ``numbered`` features are text whose levels already have numbers; they are one-hot like other text. Their vectors stay sparse, so
    nothing is centred beside them, which changes no linear model's predictions.
    """
    sparse = [c for c in features if one_hot and c in set(numbered)]
    numbers = [c for c in features if is_numeric(df, c) and c not in sparse]
    words = [c for c in features if c not in numbers and c not in sparse]
    stages, inputs = [], []
    if numbers:
        stages.append(MedianImputer(numbers, [f"{c}__num" for c in numbers]))
        inputs += [f"{c}__num" for c in numbers]
    if words:
        stages.append(StringIndexer(inputCols=words, outputCols=[f"{c}__idx" for c in words], handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in words], outputCols=[f"{c}__hot" for c in words],
                                        handleInvalid="keep"))
        inputs += [f"{c}__hot" if one_hot else f"{c}__idx" for c in words]
    if sparse:
        stages.append(OneHotEncoder(inputCols=sparse, outputCols=[f"{c}__hot" for c in sparse], handleInvalid="keep"))
        inputs += [f"{c}__hot" for c in sparse]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="assembled"))
    stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=not sparse, withStd=True))
    return stages


def slot_features(run: Training, model: PipelineModel) -> list[str]:
    """The feature of every slot of the assembled vector, by the vector's own attributes."""
    attributes = model.transform(run.train.limit(0)).schema["assembled"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    own = {f"{c}__{kind}": c for c in run.features for kind in ("num", "idx", "hot")}
    return [own[slot] if slot in own else own[max((k for k in own if slot.startswith(f"{k}_")), key=len)] for _, slot in slots]


def in_training(keys: Sequence[str], train_pct: int = 80, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(100)) < train_pct


def hash_split(df: DataFrame, keys: Sequence[str], train_pct: int = 80, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by the hash of the row key."""
    inside = in_training(keys, train_pct, seed)
    return df.filter(inside), df.filter(~inside)


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, train_share: float = 0.8,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Split each class at its own share, in hash order; a dominant class is ranked over many tasks."""
    marked = df.withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    ranked = row_index(marked, ["_h", *keys], [label], "_i")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ready = materialize(attach(ranked, sizes, [label]).withColumn("_train", F.col("_i") < F.round(F.col("_n") * train_share)))
    drop = ["_h", "_i", "_n", "_train"]
    return ready.filter("_train").drop(*drop), ready.filter("not _train").drop(*drop)


def candidates(problem: str, classes: int = 2, trees: int = 100, rounds: int = 100, max_bins: int = 256) -> dict[str, object]:
    tree = dict(seed=SEED, maxBins=max_bins)
    if problem == "regression":
        return {
            "Linear Regression": LinearRegression(),
            "Ridge Regression": LinearRegression(regParam=1e-4, elasticNetParam=0.0),
            "Decision Tree": DecisionTreeRegressor(maxDepth=6, **tree),
            "Random Forest": RandomForestRegressor(numTrees=trees, **tree),
            "Gradient Boosting": GBTRegressor(maxIter=rounds, **tree),
        }
    boosted = GBTClassifier(maxIter=rounds, **tree)
    return {
        "Logistic Regression": LogisticRegression(maxIter=500, family="multinomial" if classes > 2 else "auto"),
        "Decision Tree": DecisionTreeClassifier(maxDepth=6, **tree),
        "Random Forest": RandomForestClassifier(numTrees=trees, **tree),
        "Gradient Boosting": boosted if classes <= 2 else OneVsRest(classifier=boosted, parallelism=4),
    }


@dataclass
class Training:
    """What a run leaves behind: models, their metrics, the winner and its held-out predictions."""

    problem: str
    features: list[str]
    models: dict[str, PipelineModel] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)
    best: str | None = None
    labels: list[str] = field(default_factory=list)
    codes: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)
    left_out: list[str] = field(default_factory=list)
    train: DataFrame | None = None
    test: DataFrame | None = None

    def leaderboard(self, spark) -> DataFrame:
        schema = "model string, score double, m1 double, m2 double, m3 double, m4 double, error string"
        names = ("r2", "rmse", "mae", "mse") if self.problem == "regression" else ("accuracy", "precision", "recall", "f1")
        df = spark.createDataFrame(self.rows, schema)
        return df.withColumnsRenamed({f"m{i}": n for i, n in enumerate(names, start=1)}).orderBy(F.desc("score"), "model")

    def predictions(self, name: str | None = None, df: DataFrame | None = None) -> DataFrame:
        """Scored rows; class predictions carry their text label and confidence."""
        scored = self.models[name or self.best].transform(df if df is not None else self.test)
        if self.problem == "classification":
            scored = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=self.labels).transform(scored)
            if "probability" not in scored.columns and "rawPrediction" in scored.columns:
                # One model for each class: the margins as chances, in proportion.
                chance = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
                total = F.aggregate(chance, F.lit(0.0), lambda a, x: a + x)
                scored = scored.withColumn("probability", array_to_vector(F.transform(chance, lambda p: p / total)))
            if "probability" in scored.columns:
                scored = scored.withColumn("confidence", F.array_max(vector_to_array("probability")))
        return scored


def train(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], problem: str | None = None,
          models: Sequence[str] | None = None, trees: int = 100, rounds: int = 100, one_hot: bool = False) -> Training:
    """Split, fit every candidate inside its pipeline, score on the held-out rows, keep the best.

    One driver loop over a handful of estimators; each fit is a distributed job on stored splits.
    """
    part = "__train"
    while part in df.columns:
        part = f"_{part}"
    as_text = [c for c in features if c not in {*keys, target} and not is_numeric(df, c)]  # as ``model_input`` reads them; not all kinds can be stored
    used = [F.col(_q(c)).cast("string").alias(c) if c in as_text else F.col(_q(c)) for c in dict.fromkeys([*keys, *features, target])]
    df = store(df.select(*used, in_training(keys).alias(part)))  # what makes the rows, such as a join, runs once
    problem = problem or problem_type(df, target)
    codes = code_tables(df, wide_text(df, features))
    run = Training(problem, list(features), codes=codes)
    if problem == "regression":
        data = prepare(df, features, target, problem, [*keys, part], codes).withColumn("label", F.col("label_raw"))
        data = store(data) if codes else data
        run.train, run.test = data.filter(F.col(part)).drop(part), data.filter(~F.col(part)).drop(part)
        classes = 0
    else:
        data = prepare(df, features, target, problem, keys, codes)
        if data.agg(F.approx_count_distinct("label_raw").alias("d")).first()["d"] > MAX_LEVELS:
            raise ValueError(f"{target!r} has too many classes for classification")
        indexer = StringIndexer(inputCol="label_raw", outputCol="label", stringOrderType="alphabetAsc").fit(data)
        run.labels = list(indexer.labels)
        classes = len(run.labels)
        part_a, part_b = stratified_split(data, keys, "label_raw")
        run.train, run.test = store(indexer.transform(part_a)), store(indexer.transform(part_b))
    numbers = [c for c in features if is_numeric(run.train, c)]
    if numbers:  # a feature without any number in the training rows has no median to fill in, so it is left out
        some = run.train.agg(*[F.count(c).alias(c) for c in numbers]).first()
        run.left_out = [c for c in numbers if not some[c]]
    stages = feature_stages(run.train, [c for c in features if c not in run.left_out], one_hot, list(codes))
    score_best, ready = None, None
    for name, estimator in candidates(problem, classes, trees, rounds).items():
        if models is not None and name not in models:
            continue
        try:
            if ready is None:  # features are fitted once for all candidates, and their vectors stored
                ready = Pipeline(stages=stages).fit(run.train)
                vectors = store(ready.transform(run.train).select("features", "label"))
                few = problem == "classification" and _kinds(ready, features, run.left_out) * classes <= MOST_KINDS
            if few and name == "Gradient Boosting":
                # Each round reads all rows; rows of the same levels and class are one row of their number to it.
                alike = store(vectors.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")).coalesce(1))
                fitted = estimator.copy({estimator.weightCol: "weight"}).fit(alike)
            else:
                fitted = estimator.fit(vectors)
            model = PipelineModel(stages=[*ready.stages, fitted])
            # An aggregate's tasks carry its whole plan; from stored rows that is without the model that scored them.
            scored = store(model.transform(run.test).select("label", "prediction"))
            if problem == "regression":
                m = regression_metrics(scored).first()
                figures = (m["r2"], m["rmse"], m["mae"], m["mse"])
                score = m["r2"]
            else:
                m = classification_metrics(scored).first()
                figures = (m["accuracy"], m["weighted_precision"], m["weighted_recall"], m["weighted_f1"])
                score = m["weighted_f1"]
        except IllegalArgumentException as error:  # data that a candidate cannot be fitted on rank it last; other errors are errors
            run.rows.append((name, FAILED_SCORE, None, None, None, None, str(error)[:200]))
            continue
        run.models[name] = model
        run.rows.append((name, float(score), *[float(x) for x in figures], None))
        if score_best is None or score > score_best:
            score_best, run.best = score, name
    return run


def _kinds(ready: PipelineModel, features: Sequence[str], left_out: Sequence[str]) -> float:
    """How many different vectors the levels of text features can make, however many rows; endless with a number among the features."""
    levels = [labels for stage in ready.stages if isinstance(stage, StringIndexerModel) for labels in stage.labelsArray]
    return math.prod(len(labels) + 1 for labels in levels) if len(levels) == len(set(features) - set(left_out)) else math.inf


def linear_coefficients(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``term, coefficient`` of an ordinary least squares fit in the units of the columns."""
    rows = df.select(as_number(df, target).alias("label"), *[as_number(df, c).alias(c) for c in features]).dropna()
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    model = LinearRegression(solver="normal").fit(ready)
    terms = [*zip(features, (float(x) for x in model.coefficients)), ("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def cross_validate(df: DataFrame, features: Sequence[str], keys: Sequence[str], estimator, problem: str,
                   folds: int = 5) -> DataFrame:
    """``metric, mean, std`` over hash folds."""
    fold = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(SEED)), F.lit(folds)).cast("int")
    data = store(df.select(*dict.fromkeys([*features, "label"]), fold.alias("fold")))
    metric = "r2" if problem == "regression" else "weightedFMeasure"
    judge = RegressionEvaluator(metricName="r2") if problem == "regression" else MulticlassClassificationEvaluator(metricName="f1")
    flow = Pipeline(stages=[*feature_stages(df, features), estimator])
    sizes = {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    scores = []
    for i in range(folds):
        if not sizes.get(i):
            raise ValueError(f"The validation data at fold {i} is empty.")
        if sizes[i] == sum(sizes.values()):
            raise ValueError(f"The training data at fold {i} is empty.")
        scores.append(judge.evaluate(flow.fit(data.filter(F.col("fold") != i)).transform(data.filter(F.col("fold") == i))))
    return df.sparkSession.createDataFrame([(metric, float(np.mean(scores)), float(np.std(scores)))], "metric string, mean double, std double")


def training_auc(run: Training, name: str | None = None) -> float:
    return auc(run.predictions(name), len(run.labels))


def feature_importance(run: Training, name: str | None = None, k: int = 15) -> DataFrame:
    """Tree importances, or mean absolute coefficients with their share in percent.

    The weights of all slots of a feature (one for each level of a one-hot text) are added up; one model for each class
    gives the mean of the models.
    """
    model = run.models[name or run.best]
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "models"):
        weights = sum(m.featureImportances.toArray() for m in last.models) / len(last.models)
    elif hasattr(last, "coefficientMatrix"):
        weights = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        weights = abs(last.coefficients.toArray())
    sums = dict.fromkeys((c for c in run.features if c not in run.left_out), 0.0)
    for feature, weight in zip(slot_features(run, model), weights):
        sums[feature] += float(weight)
    total = sum(sums.values()) or 1.0
    rows = [(n, w, 100.0 * w / total) for n, w in sums.items()]
    spark = run.train.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double, share_pct double").orderBy(
        F.desc("importance"), "feature").limit(k)


def permutation_importance(run: Training, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Loss of score when one feature is shuffled among the held-out rows; works for every model.

    The shuffle pairs two hash orders through a row index, so no column passes through one task.
    """
    model = run.models[name or run.best]
    spark = run.test.sparkSession

    def score(df):
        metrics = regression_metrics(df) if run.problem == "regression" else classification_metrics(df)
        return float(metrics.first()["r2" if run.problem == "regression" else "weighted_f1"])

    base = score(model.transform(run.test))
    order = run.test.withColumn("_a", F.xxhash64(*keys, F.lit(1))).withColumn("_b", F.xxhash64(*keys, F.lit(2)))
    left = row_index(order, ["_a", *keys], name="_i")
    right = row_index(order.select("_b", *keys, *run.features), ["_b", *keys], name="_i")
    other = [F.col(c).alias(f"_other{i}") for i, c in enumerate(run.features)]
    both = store(left.join(right.select("_i", *other), "_i"))
    rows = []
    for i, f in enumerate(run.features):
        rows.append((f, base - score(model.transform(both.withColumn(f, F.col(f"_other{i}"))))))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_shap(df: DataFrame, coefficients: Mapping[str, float], k: int = 15) -> DataFrame:
    """``feature, mean_abs_shap``: exact Shapley values of a linear model, over all rows."""
    names = list(coefficients)
    means = df.agg(*[F.avg(as_number(df, c)).alias(c) for c in names]).first()
    wide = df.agg(*[F.avg(F.abs(F.lit(float(coefficients[c])) * (as_number(df, c) - F.lit(means[c])))).alias(c) for c in names])
    return wide.unpivot([], names, "feature", "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature").limit(k)


def sampled_shap(run: Training, keys: Sequence[str], name: str | None = None, rows: int | None = None, background: int = 50,
                 permutations: int = 8, k: int = 15) -> DataFrame:
    """``feature, mean_abs_shap`` of any model by sampled permutations, for all training rows unless ``rows`` limits them.

    Absent features come from ``background`` rows, a bounded sample by definition of the method. Two classes are told by
    the chance of the second, more classes by the mean over all of them. Rows of equal keys share the steps of one walk.
    Models of ``candidates`` score the steps of a row beside it, from parts that are told once for each row and feature (``mixtures``);
    others, and vectors of over ``MOST_SLOTS``, get one coalition row for each step of each (row, permutation).
    """
    from tablecraft.operators import mixtures  # which reads trees, and so this module

    model = run.models[name or run.best]
    names = sorted(run.features)
    hashed = run.train.withColumn("_h", F.xxhash64(*keys, F.lit(SEED)))
    chosen = hashed if rows is None else hashed.orderBy("_h", *keys).limit(rows)
    ground = hashed.orderBy(F.desc("_h"), *keys).limit(background)
    slots = slot_features(run, model)
    mix = mixtures.mixer(run.train.sparkSession, model.stages[-1], [names.index(c) for c in slots], len(names),
                         len(run.labels)) if len(slots) <= MOST_SLOTS else None
    if mix is None:
        return _shap_by_rows(run, keys, name, chosen, ground, permutations, k)
    vectors = PipelineModel(stages=model.stages[:-1]).transform
    base = [r["x"] for r in vectors(ground.select(*run.features)).select(vector_to_array("features").alias("x")).collect()]
    if not base:
        return run.train.sparkSession.createDataFrame([], "feature string, mean_abs_shap double")
    # Two hashes tell a row by its keys, null or not; its steps are in one task, sorted.
    other = F.xxhash64(*keys, *[F.isnull(c) for c in keys], F.lit(SEED + 1)).alias("_g")
    dealt = chosen.select("_h", other, *run.features).repartition("_h", "_g").sortWithinPartitions("_h", "_g", *run.features)
    drawn = F.array(*[x for p in range(1, permutations + 1) for x in (F.xxhash64("_h", F.lit(p)), *[F.xxhash64("_h", F.lit(p), F.lit(c)) for c in names])])
    each = vectors(dealt).select(F.col("_h").alias("a"), F.col("_g").alias("b"), vector_to_array("features").alias("x"), drawn.alias("r"))
    told = each.mapInArrow(mixtures.walks(mix, np.array(base), len(names), permutations), "n bigint, sums array<double>")
    sums = told.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    outputs = 1 if run.problem == "regression" or len(run.labels) == 2 else len(run.labels)
    feature = F.get(F.array(*[F.lit(c) for c in names]), F.floor(F.col("i") / outputs).cast("int")).alias("feature")
    return sums.groupBy(feature).agg(F.avg("mean").alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature").limit(k)


def _shap_by_rows(run: Training, keys: Sequence[str], name: str | None, chosen: DataFrame, background: DataFrame, permutations: int,
                  k: int) -> DataFrame:
    """``sampled_shap`` of any model: a single ``transform`` scores one coalition row for each step.

    Rows are dealt by their keys before they are multiplied, so steps of a row meet where they are scored, without a shuffle of their own.
    """
    names = run.features
    ground = background.select(*names).collect()  # bounded sample
    fields = {f.name: f.dataType for f in run.train.schema}
    pool = F.array(*[F.struct(*[F.lit(r[c]).cast(fields[c]).alias(c) for c in names]) for r in ground])
    row = ["_h", *[f"_k{i}" for i in range(len(keys))]]
    dealt = chosen.select("_h", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*names).alias("x")).repartition(*row)
    pairs = dealt.select(*row, "x", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    pick = F.pmod(F.xxhash64("_h", "p"), F.lit(len(ground))).cast("int")
    order = F.transform(
        F.array_sort(F.array(*[F.struct(F.xxhash64("_h", "p", F.lit(c)).alias("r"), F.lit(c).alias("f")) for c in names])),
        lambda e: e["f"])
    steps = pairs.select(*row, "p", "x", F.get(pool, pick).alias("b"), order.alias("order"),
                         F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("step"))
    coalition = steps.select(
        *row, "p", "step", F.get("order", F.col("step") - 1).alias("added"),
        *[F.when(F.array_position("order", c) <= F.col("step"), F.col(f"x.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in names])
    scored = run.predictions(name, coalition)
    chances = F.array("prediction") if run.problem == "regression" else vector_to_array("probability")
    if len(run.labels) == 2:
        chances = F.slice(chances, 2, 1)
    walk = Window.partitionBy(*row, "p").orderBy("step")  # one row per feature plus one
    told = scored.select(*row, "p", "step", "added", chances.alias("v")).withColumn("before", F.lag("v").over(walk)).filter("step > 0")
    delta = told.select(*row, "added", F.posexplode(F.zip_with("v", "before", lambda a, b: a - b)).alias("class", "d"))
    per_row = delta.groupBy(*row, "added", "class").agg(F.avg("d").alias("phi"))
    return per_row.groupBy(F.col("added").alias("feature")).agg(F.avg(F.abs("phi")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature").limit(k)


def score_scenarios(run: Training, base: DataFrame, keys: Sequence[str], scenarios: Sequence[Mapping[str, object]],
                    name: str | None = None) -> DataFrame:
    """Each base row under each scenario's overrides: prediction, label and class probabilities."""
    ready = prepare(base, run.features, keys=keys)
    kinds = dict(ready.dtypes)
    options = F.array(*[
        F.struct(F.lit(i).alias("scenario"), *[F.lit(s.get(c)).cast(kinds[c]).alias(c) for c in run.features])
        for i, s in enumerate(scenarios, start=1)
    ])
    spread = ready.select("*", F.explode(options).alias("s")).select(
        *keys, F.col("s.scenario").alias("scenario"), *[F.coalesce(F.col(f"s.{c}"), F.col(c)).alias(c) for c in run.features])
    scored = run.predictions(name, coded(spread, run.codes))
    extra = ["predicted_label", "confidence"] if run.problem == "classification" and "confidence" in scored.columns else []
    return scored.select(*keys, "scenario", "prediction", *extra)


def actual_vs_predicted(run: Training, keys: Sequence[str], name: str | None = None) -> DataFrame:
    scored = run.predictions(name)
    if run.problem == "regression":
        return scored.select(*keys, F.col("label").alias("actual"), "prediction", (F.col("prediction") - F.col("label")).alias("delta"))
    return scored.select(*keys, F.col("label_raw").alias("actual"), F.col("predicted_label").alias("prediction"),
                         (F.col("label_raw") == F.col("predicted_label")).alias("correct"))


def append_predictions(run: Training, df: DataFrame, name: str | None = None, column: str = "Predicted_Value") -> DataFrame:
    """The frame's own columns plus the prediction, without any positional pairing."""
    original = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    ready = coded(df.select(original, *[model_input(df, c).alias(c) for c in run.features]), run.codes)
    scored = run.predictions(name, ready)
    value = "predicted_label" if run.problem == "classification" else "prediction"
    return scored.select("_row.*", F.col(value).alias(column))


def cluster(df: DataFrame, features: Sequence[str], k: int = 3, max_iter: int = 50, seed: int = SEED):
    """``(labelled rows, cluster profile, inertia)``; rows with a gap are Unassigned."""
    numbers = df.withColumns({f"_f_{c}": finite_or_null(as_number(df, c)) for c in features})
    names = [f"_f_{c}" for c in features]
    whole = numbers.dropna(subset=names)
    flow = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
        KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_s", predictionCol="_c"),
    ]).fit(whole)
    tagged = flow.transform(whole).withColumn("ML_Cluster", F.concat(F.lit("Cluster_"), (F.col("_c") + 1).cast("string")))
    gaps = numbers.filter(" or ".join(f"`{n}` is null" for n in names)).withColumn("ML_Cluster", F.lit("Unassigned"))
    labelled = tagged.select(*df.columns, "ML_Cluster").unionByName(gaps.select(*df.columns, "ML_Cluster"))
    profile = tagged.groupBy("ML_Cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(f"_f_{c}").alias(f"avg_{c}") for c in features])
    return labelled, profile, float(flow.stages[-1].summary.trainingCost)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
