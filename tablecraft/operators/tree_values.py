"""Exact Shapley values of tree models: what every feature adds to every prediction.

An absent feature is followed down both branches in proportion to their training rows. The game then splits into one product game for
every leaf: with o(i) = 1 if the row meets all of feature i's conditions on the leaf's path, and z(i) = the share of training rows that
follow them, a coalition S reaches the leaf with weight prod(o(i), i in S) * prod(z(i), i not in S). The Shapley value of i in it is

    (o(i) - z(i)) * integral over t from 0 to 1 of prod(t * o(j) + (1 - t) * z(j), j other than i),

because the integral of t^s (1 - t)^(m - 1 - s) is the weight of a coalition of s. The integrand is a polynomial, so a few Gauss-Legendre
points give it exactly; no background rows are drawn. A leaf's game depends on a row only by which of its features have their conditions
met, and that on the intervals that the cuts make of each feature. So the values of all cells of intervals are worked out once a task and
tree, and a row costs one look-up a tree. Trees of too many cells look up one pattern of met features for each leaf, and trees whose leaves
have too many features are worked out for each way through the tree.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecraft.operators.learning import Training, slot_features
from tablecraft.session import ensure_checkpoint_dir, spread

# Numbers that one block of ways through a tree may hold while they are worked out.
CELLS = 2_000_000
# Numbers that one tree's table of patterns, and its table of cells, may hold.
TABLE = 200_000


@dataclass(frozen=True)
class Paths:
    """The leaves of one tree: conditions, training shares and values along the way to each.

    ``slots``, ``cuts``, ``groups`` describe the inner nodes (``groups``: the categories that go left, or None); ``left`` and ``right``
    say which nodes a (leaf, feature) pair needs to go which way, ``needed`` how many. ``spread`` turns the pairs' weights into values.
    """

    slots: np.ndarray
    cuts: np.ndarray
    groups: list
    left: np.ndarray
    right: np.ndarray
    needed: np.ndarray
    share: np.ndarray
    spread: np.ndarray
    players: np.ndarray
    base: np.ndarray


def node_table(spark: SparkSession, model) -> pd.DataFrame:
    """``tree, id, stats, prediction, rows, left, right, slot, cut, categories`` of a fitted model, from its saved form.

    As large as the model, which the driver holds already.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    return saved.select(
        F.col("treeID").alias("tree"), "id", "prediction", F.col("impurityStats").alias("stats"), F.col("rawCount").alias("rows"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("slot"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("categories")).orderBy("tree", "id").toPandas()


def paths(nodes: pd.DataFrame, players: Sequence[int], chances: bool, weight: float) -> Paths:
    """One tree as leaves; ``players[slot]`` is the feature that a slot of the vector belongs to."""
    at = {n.id: n for n in nodes.itertuples()}
    inner = [n for n in at.values() if n.left >= 0]
    place = {n.id: i for i, n in enumerate(inner)}
    leaves = []
    waiting = [(at[0], {}, 1.0)]  # node, {feature: (share of rows, [(inner node, goes left)])}, share of all rows
    while waiting:
        node, met, reach = waiting.pop()
        if node.left < 0:
            stats = np.asarray(node.stats)
            leaves.append((met, reach, weight * (stats / stats.sum() if chances else np.array([node.prediction]))))
            continue
        who = players[node.slot]
        share, conditions = met.get(who, (1.0, []))
        for child, goes_left in ((at[node.left], True), (at[node.right], False)):
            part = child.rows / node.rows
            waiting.append((child, met | {who: (share * part, [*conditions, (place[node.id], goes_left)])}, reach * part))
    used = sorted({who for met, *_ in leaves for who in met})
    width, outputs = max(len(met) for met, *_ in leaves), len(leaves[0][2])
    pairs = len(leaves) * width
    left, right, needed = np.zeros((len(inner), pairs)), np.zeros((len(inner), pairs)), np.zeros(pairs)
    share, spread = np.ones(pairs), np.zeros((pairs, len(used), outputs))
    for i, (met, _, value) in enumerate(leaves):
        for j, (who, (part, conditions)) in enumerate(met.items(), start=i * width):
            share[j], needed[j] = part, len(conditions)
            spread[j, used.index(who)] = value
            for node, goes_left in conditions:
                (left if goes_left else right)[node, j] = 1.0
    return Paths(
        np.array([n.slot for n in inner], dtype=int), np.array([n.cut[0] if n.categories < 0 else 0.0 for n in inner]),
        [None if n.categories < 0 else np.asarray(n.cut) for n in inner], left, right, needed, share.reshape(len(leaves), width),
        spread.reshape(pairs, len(used) * outputs), np.array(used, dtype=int), sum(reach * value for _, reach, value in leaves))


def _added(tree: Paths, own: np.ndarray) -> np.ndarray:
    """What each met (1) or unmet (0) feature of each leaf adds to the leaf's game: the last two axes are leaves and features."""
    points, weights = np.polynomial.legendre.leggauss((tree.share.shape[1] + 1) // 2)
    total = np.zeros_like(own)
    for t, w in zip((points + 1) / 2, weights / 2):
        terms = t * own + (1 - t) * tree.share
        total += w * terms.prod(axis=-1, keepdims=True) / terms  # no term is 0: every branch has training rows
    return (own - tree.share) * total


def tree_shapley(tree: Paths, x: np.ndarray) -> np.ndarray:
    """Values of the tree's features for each row of ``x``: rows x features x outputs."""
    outputs, (leaves, width) = len(tree.base), tree.share.shape
    if not width:
        return np.zeros((len(x), 0, outputs))
    goes_left = x[:, tree.slots] <= tree.cuts
    for i, group in enumerate(tree.groups):
        if group is not None:
            goes_left[:, i] = np.isin(x[:, tree.slots[i]], group)
    # Rows that decide alike at every node have equal values; each way through the tree is worked out once.
    _, one, which = np.unique(np.packbits(goes_left, axis=1), axis=0, return_index=True, return_inverse=True)
    goes_left = goes_left[one].astype(float)
    step = max(1, CELLS // tree.share.size)
    told = []
    for at in range(0, len(one), step):
        ways = goes_left[at:at + step]
        own = (ways @ tree.left + (1 - ways) @ tree.right == tree.needed).astype(float).reshape(len(ways), leaves, width)
        told.append(_added(tree, own).reshape(len(ways), -1) @ tree.spread)
    return np.concatenate(told)[which.ravel()].reshape(len(x), -1, outputs)


class Grid:
    """The intervals that the cuts of several trees make of each slot; a slot of categories has one for each category and one for others."""

    def __init__(self, trees: Sequence[Paths]):
        cuts: dict[int, set] = {}
        kinds: dict[int, set] = {}
        for tree in trees:
            for slot, cut, group in zip(tree.slots, tree.cuts, tree.groups):
                kinds.setdefault(int(slot), set()).update([] if group is None else group.tolist())
                cuts.setdefault(int(slot), set()).update([cut] if group is None else [])
        self.cuts = {slot: np.array(sorted(some)) for slot, some in cuts.items() if some}
        self.kinds = {slot: np.array(sorted(kinds[slot])) for slot, some in cuts.items() if not some}

    def places(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """The interval of every row in every slot. A number beyond all cuts, or none, is in the last."""
        out = {slot: np.searchsorted(cuts, x[:, slot]) for slot, cuts in self.cuts.items()}
        for slot, kinds in self.kinds.items():
            at = np.searchsorted(kinds, x[:, slot])
            out[slot] = np.where(kinds[np.minimum(at, len(kinds) - 1)] == x[:, slot], at, len(kinds))
        return out

    def goes_left(self, slot: int, cut: float, group: np.ndarray | None) -> np.ndarray:
        """Which intervals of the slot a node sends left."""
        if slot in self.cuts:
            return np.arange(len(self.cuts[slot]) + 1) <= np.searchsorted(self.cuts[slot], cut)
        return np.append(np.isin(self.kinds[slot], group), False)


def looked_up(tree: Paths, grid: Grid) -> Callable[[np.ndarray, dict[int, np.ndarray]], np.ndarray]:
    """``tree_shapley`` by tables: a function of rows and their intervals that gives rows x (features x outputs)."""
    (leaves, width), numbers = tree.share.shape, tree.spread.shape[1]
    if not width or leaves << width > TABLE // max(1, numbers):
        return lambda x, places: tree_shapley(tree, x).reshape(len(x), -1)
    patterns = np.arange(1 << width)
    own = 1.0 - (patterns[:, None] >> np.arange(width) & 1)  # a pattern's bits are the features that are not met
    added = _added(tree, np.repeat(own[:, None, :], leaves, axis=1))
    values = np.einsum("plj,ljk->lpk", added, tree.spread.reshape(leaves, width, numbers))

    def total(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), numbers))
        for leaf in range(leaves):
            out += values[leaf][codes[:, leaf]]
        return out

    unmet, which = {}, {}
    for slot in sorted(set(tree.slots.tolist())):
        nodes = np.flatnonzero(tree.slots == slot)
        goes = np.stack([grid.goes_left(slot, tree.cuts[n], tree.groups[n]) for n in nodes], axis=1)
        ways, inverse = np.unique(goes, axis=0, return_inverse=True)
        fails = (~ways).astype(float) @ tree.left[nodes] + ways.astype(float) @ tree.right[nodes] > 0
        unmet[slot] = (fails.reshape(len(ways), leaves, width) << np.arange(width)).sum(axis=2)
        which[slot] = inverse.ravel()
    sizes = [len(codes) for codes in unmet.values()]
    if math.prod(sizes) * numbers > TABLE:
        return lambda x, places: total(functools.reduce(np.bitwise_or, [codes[which[slot][places[slot]]] for slot, codes in unmet.items()]))
    codes = np.zeros((1, leaves), dtype=int)
    for some in unmet.values():
        codes = (codes[:, None, :] | some[None, :, :]).reshape(-1, leaves)
    cells = total(codes)
    steps = {slot: which[slot] * math.prod(sizes[i + 1:]) for i, slot in enumerate(unmet)}
    return lambda x, places: cells[sum(step[places[slot]] for slot, step in steps.items())]


def ensemble(spark: SparkSession, model, players: Sequence[int]) -> list[list[Paths]]:
    """Trees whose sum is the model's answer: one list for each separately fitted answer.

    Regression gives one output, trees and forests of classes one chance for each class, boosting of two classes the margin of the second,
    one boosted model for each class one margin each.
    """
    if hasattr(model, "models"):
        return [trees for part in model.models for trees in ensemble(spark, part, players)]
    boosted = "GBT" in type(model).__name__
    chances = hasattr(model, "numClasses") and not boosted
    nodes = node_table(spark, model)
    count = nodes["tree"].nunique()
    weights = list(model.treeWeights) if boosted else [1.0 / count] * count
    return [[paths(rows, players, chances, weights[i]) for i, (_, rows) in enumerate(nodes.groupby("tree", sort=True))]]


def contributions(answers: Sequence[Sequence[Paths]], features: int, vector: Column) -> tuple[Column, list[float]]:
    """An array of outputs x features values for each row, flat, and the outputs' values without any feature."""
    bases = np.concatenate([np.sum([tree.base for tree in trees], axis=0) for trees in answers])

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        every = [tree for trees in answers for tree in trees]
        grid, tables = Grid(every), None
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            tables = tables or [looked_up(tree, grid) for tree in every]
            x = np.stack(vectors.to_numpy())
            places = grid.places(x)
            told = np.zeros((len(x), features, len(bases)))
            first, at = 0, iter(tables)
            for trees in answers:
                last = first + len(trees[0].base)
                for tree in trees:
                    told[:, tree.players, first:last] += next(at)(x, places).reshape(len(x), len(tree.players), last - first)
                first = last
            yield pd.Series(list(told.transpose(0, 2, 1).reshape(len(x), -1)))

    return explain(vector_to_array(vector)), [float(b) for b in bases]


def explained(rows: DataFrame, model, players: Sequence[str], keys: Sequence[str], outputs: Sequence[str | None] = (),
              vector: str = "features") -> DataFrame:
    """``keys, output, base, contributions`` of a fitted tree model: base plus all contributions is its answer for the row.

    ``players`` names the feature of each slot of the vector; slots of one name (levels of a one-hot text) are one player. ``outputs``
    names the answers, numbers otherwise. Two outputs that add up to one are both given. Rows without a vector give none.
    """
    clash = {"output", "base", "contributions"} & set(keys)
    if clash:
        raise ValueError(f"keys of the names of results: {sorted(clash)}")
    names = sorted(set(players))
    number = {c: i for i, c in enumerate(names)}
    answers = ensemble(rows.sparkSession, model, [number[c] for c in players])
    values, bases = contributions(answers, len(names), F.col(vector))
    labels = list(outputs) or [None if len(bases) == 1 else str(i) for i in range(len(bases))]
    if len(labels) != len(bases):
        raise ValueError(f"{len(bases)} outputs, {len(labels)} names")
    told = spread(rows.where(F.col(vector).isNotNull()).select(*keys, vector)).select(*keys, values.alias("__values"))
    each = F.array(*[F.struct(
        F.lit(label).cast("string").alias("output"), F.lit(base).alias("base"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.slice("__values", i * len(names) + 1, len(names))).alias("contributions"))
        for i, (label, base) in enumerate(zip(labels, bases))])
    return told.select(*keys, F.inline(each))


def tree_values(run: Training, keys: Sequence[str], name: str | None = None, df: DataFrame | None = None) -> DataFrame:
    """``keys, output, base, contributions`` for all training rows, or for the prepared rows ``df``.

    ``output`` is the class (null in regression); boosting of two classes gives the margin of the second only.
    """
    model = run.models[name or run.best]
    rows = model.transform(run.train if df is None else df)
    last = model.stages[-1]
    labels = () if run.problem == "regression" else run.labels
    if len(labels) == 2 and "GBT" in type(last).__name__:
        labels = labels[1:]
    return explained(rows, last, slot_features(run, model), keys, labels)


def tree_shap(run: Training, keys: Sequence[str], name: str | None = None, k: int = 15) -> DataFrame:
    """``feature, mean_abs_shap`` over all training rows and, with several classes, all classes; the ``k`` greatest."""
    each = tree_values(run, keys, name).select(F.explode("contributions").alias("feature", "value"))
    return each.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature").limit(k)
