"""Isolation forest: trees from bounded random subsamples, scores from a small forest table.

Each tree sees 256 rows by definition of the algorithm, so building is bounded whatever the table's
size; scoring is one map over the rows with the forest (at most 100 trees of 511 nodes) as a closure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablecraft.operators.missing import fit_fill
from tablecraft.operators.projection import as_number, numeric_columns
from tablecraft.operators.quantiles import column_quantiles
from tablecraft.session import materialize

SUBSAMPLE = 256
# With so many times the wanted rows on average, a tree is short of them about once in 10^9.
SPARE = 1.5
TREES = 100
SEED = 42


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, tree: int) -> pd.DataFrame:
    """Nodes of one random tree in heap numbering: feature -1 marks a leaf whose cut is its depth."""
    rng = np.random.default_rng([SEED, tree])
    height = math.ceil(math.log2(max(len(points), 2)))
    nodes, open_nodes = [], [(0, points, 0)]
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or len(usable) == 0:
            nodes.append((tree, node, -1, depth + float(_average_path(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append((tree, node, f, cut))
        below = rows[:, f] < cut
        open_nodes += [(2 * node + 1, rows[below], depth + 1), (2 * node + 2, rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut"])


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numbers = df.withColumns({f"_x_{c}": as_number(df, c) for c in columns})
    medians = fit_fill(numbers.select([f"_x_{c}" for c in columns]), {f"_x_{c}": "median" for c in columns})
    vector = F.array(*[F.coalesce(F.col(f"_x_{c}"), F.lit(medians.get(f"_x_{c}") or 0.0)) for c in columns])
    return numbers.withColumn("_vec", vector).drop(*[f"_x_{c}" for c in columns])


def anomaly_scores(df: DataFrame, key: str, columns: Sequence[str] | None = None, trees: int = TREES) -> DataFrame:
    """The frame with ``anomaly_score`` in (0, 1); higher is more isolated."""
    columns = list(columns or [c for c in numeric_columns(df) if c != key])
    ready = _filled(df, columns)
    rows = ready.select(key).count()
    if rows < 5:
        return ready.drop("_vec").withColumn("anomaly_score", F.lit(None).cast("double"))
    take = min(rows, SUBSAMPLE)
    # Every tree draws each row with the same chance, some rows more than it needs, and keeps 256 of them in hash order. The first
    # tree that draws a row is a geometric gap from one hash of the row, so most rows of a large table cost no more than that.
    chance = min(1.0, SPARE * take / rows)
    bound = min(2 ** 63 - 1, int(2 ** 63 * chance))
    own = F.struct(F.col(key), F.col("_vec"))
    uniform = (F.xxhash64(own, F.lit(SEED)).bitwiseAND(F.lit(2 ** 53 - 1)) + F.lit(0.5)) / F.lit(2.0 ** 53)
    gap = F.floor(F.log(uniform) / F.lit(math.log1p(-chance))) if chance < 1 else F.lit(0)
    drawn = ready.select("_vec", own.alias("_own"), gap.alias("_first")).where(F.col("_first") < trees)
    draws = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: (tree == F.col("_first")) | (
        (tree > F.col("_first")) & (F.xxhash64("_own", tree, F.lit(SEED)).bitwiseAND(F.lit(2 ** 63 - 1)) <= F.lit(bound))))
    dealt = drawn.select("_vec", "_own", F.explode(draws).alias("tree"))
    dealt = dealt.select("tree", F.xxhash64("_own", "tree", F.lit(SEED + 1)).alias("h"), "_vec")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(np.stack(pdf.sort_values("h")["_vec"].to_numpy())[:SUBSAMPLE], int(pdf["tree"].iloc[0]))

    # An explicit number of partitions, as the draws are so few that they would be put together into one task.
    dealt = dealt.repartition(min(trees, df.sparkSession.sparkContext.defaultParallelism), "tree")
    forest = dealt.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double").toPandas()
    shape = (trees, int(forest["node"].max()) + 1)
    feature, cut = np.full(shape, -1), np.zeros(shape)
    feature[forest["tree"], forest["node"]] = forest["feature"]
    cut[forest["tree"], forest["node"]] = forest["cut"]
    grown = sorted(set(forest["tree"]))
    usual = float(_average_path(take))
    shared = df.sparkSession.sparkContext.broadcast((feature, cut, grown))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, cuts, ids = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            depth = np.zeros(len(x))
            for t in ids:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = features[t][at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[np.arange(len(x)), np.maximum(f, 0)] < cuts[t][at]
                    at = np.where(inner, np.where(left, 2 * at + 1, 2 * at + 2), at)
                depth += cuts[t][at]
            yield pd.Series(np.power(2.0, -(depth / len(ids)) / usual))

    return ready.withColumn("anomaly_score", score("_vec")).drop("_vec")


def detect_anomalies(df: DataFrame, key: str, columns: Sequence[str] | None = None, contamination: float = 0.05,
                     trees: int = TREES) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly``: the top share of scores; a share outside [0.01, 0.5] means 0.05."""
    share = contamination if 0.01 <= contamination <= 0.5 else 0.05
    scored = materialize(anomaly_scores(df, key, columns, trees), once=True)
    found = column_quantiles(scored, ["anomaly_score"], [1 - share])["anomaly_score"]
    limit = found[0] if found else None
    return scored.withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > F.lit(limit), F.lit(False)))


def remove_anomalies(df: DataFrame, key: str, columns: Sequence[str] | None = None, contamination: float = 0.05) -> DataFrame:
    return detect_anomalies(df, key, columns, contamination).filter("not is_anomaly").select(*df.columns)
