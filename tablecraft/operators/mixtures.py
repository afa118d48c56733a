"""Scores of fitted models for mixtures of two rows: some features are those of one row, the others those of another.

A feature has slots of its own in the vector, and all stages before the model work slot by slot. So a mixture is told by parts that each row
has once for each feature: of linear models what the feature adds to the margin, of a tree the set of leaves that the feature lets the row
reach, as bits. A mixture adds the margins up, or finds the one leaf that all features let it reach.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, OneVsRestModel, RandomForestClassificationModel,
)
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession

from tablecraft.operators.tree_values import Grid, node_table

# Features times mixtures that one block may hold.
CELLS = 100_000
# Leaves that one word of bits tells.
WORD = 64


@dataclass(frozen=True)
class Split:
    """The inner nodes of one tree, as ``Grid`` reads them."""

    slots: np.ndarray
    cuts: np.ndarray
    groups: list


@dataclass(frozen=True)
class Leaves:
    """One tree: for each slot and interval the leaves that stay open, and by word what the one open leaf says (row 0: none is)."""

    open: dict[int, np.ndarray]
    said: list[np.ndarray]


def _split(nodes: pd.DataFrame) -> Split:
    inner = [n for n in nodes.itertuples() if n.left >= 0]
    return Split(
        np.array([n.slot for n in inner], dtype=int), np.array([n.cut[0] if n.categories < 0 else 0.0 for n in inner]),
        [None if n.categories < 0 else np.asarray(n.cut) for n in inner])


def _leaves(nodes: pd.DataFrame, split: Split, grid: Grid, chances: bool, weight: float) -> Leaves:
    at = {n.id: n for n in nodes.itertuples()}
    below: dict[int, list[int]] = {}
    values = []

    def walk(start: int) -> None:
        waiting = [(start, False)]
        while waiting:
            i, is_done = waiting.pop()
            node = at[i]
            if node.left < 0:
                stats = np.asarray(node.stats)
                below[i] = [len(values)]
                values.append(weight * (stats / stats.sum() if chances else np.array([node.prediction])))
            elif is_done:
                below[i] = below[node.left] + below[node.right]
            else:
                waiting += [(i, True), (node.left, False), (node.right, False)]

    walk(0)
    words = -(-len(values) // WORD)

    def bits(leaves: Sequence[int]) -> np.ndarray:
        out = [0] * words
        for leaf in leaves:
            out[leaf // WORD] |= 1 << leaf % WORD
        return np.array(out, dtype=np.uint64)

    inner = [n for n in at.values() if n.left >= 0]
    still_open: dict[int, np.ndarray] = {}
    for node, slot, cut, group in zip(inner, split.slots.tolist(), split.cuts, split.groups):
        goes_left = grid.goes_left(slot, cut, group)
        if slot not in still_open:
            still_open[slot] = np.repeat(bits(range(len(values)))[None, :], len(goes_left), axis=0)
        still_open[slot] &= np.where(goes_left[:, None], ~bits(below[node.right]), ~bits(below[node.left]))
    said = [np.stack([np.zeros_like(values[0]), *values[w * WORD:(w + 1) * WORD]]) for w in range(words)]
    return Leaves(still_open, said)


class TreeSums:
    """A weighted sum of what trees say; ``players[slot]`` is the feature that a slot belongs to."""

    def __init__(self, spark: SparkSession, model, players: Sequence[int], features: int):
        self.players, self.features = list(players), features
        boosted = "GBT" in type(model).__name__
        chances = hasattr(model, "numClasses") and not boosted
        trees = [rows for _, rows in node_table(spark, model).groupby("tree", sort=True)]
        weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
        splits = [_split(rows) for rows in trees]
        self.grid = Grid(splits)
        self.trees = [_leaves(rows, split, self.grid, chances, weight) for rows, split, weight in zip(trees, splits, weights)]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """For each tree the open leaves of every feature and row: features x words x rows."""
        places = self.grid.places(x)
        out = []
        for tree in self.trees:
            told = np.full((self.features, len(tree.said), len(x)), ~np.uint64(0))
            for slot, still_open in tree.open.items():
                told[self.players[slot]] &= still_open[places[slot]].T
            out.append(told)
        return out

    def mixed(self, own: list[np.ndarray], other: list[np.ndarray], pick: np.ndarray, rank: np.ndarray) -> Iterator[np.ndarray]:
        """For each step the sums, rows x picks x outputs: features of a lower ``rank`` than the step are the row's own."""
        sums = [0.0] * (self.features + 1)
        for tree, mine, theirs in zip(self.trees, own, other):
            used = sorted({self.players[slot] for slot in tree.open})
            for w, said in enumerate(tree.said):
                if not used:
                    sums = [total + np.broadcast_to(said[1], (*pick.shape, said.shape[1])) for total in sums]
                    continue
                there = {f: theirs[f, w][pick] for f in used}
                for step in range(self.features + 1):
                    left = functools.reduce(np.bitwise_and, [np.where(rank[f] < step, mine[f, w][:, None], there[f]) for f in used])
                    # One bit at most: its place is the exponent.
                    sums[step] = sums[step] + said[np.frexp(left.astype(np.float64))[1]]
        return iter(sums)


class Margins:
    """What a linear model adds up."""

    def __init__(self, weights: np.ndarray, starts: np.ndarray, players: Sequence[int], features: int):
        self.weights, self.starts = weights, starts  # outputs x slots
        self.slots = [np.flatnonzero(np.asarray(players) == f) for f in range(features)]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """features x rows x outputs"""
        return np.stack([x[:, some] @ self.weights[:, some].T for some in self.slots])

    def mixed(self, own: np.ndarray, other: np.ndarray, pick: np.ndarray, rank: np.ndarray) -> Iterator[np.ndarray]:
        there = [theirs[pick] for theirs in other]
        for step in range(len(rank) + 1):
            yield self.starts + sum(np.where(r[:, :, None] < step, mine[:, None, :], theirs) for r, mine, theirs in zip(rank, own, there))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-margin))


def _softmax(margins: np.ndarray) -> np.ndarray:
    each = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return each / each.sum(axis=-1, keepdims=True)


def _shares(margins: np.ndarray) -> np.ndarray:
    each = _sigmoid(2 * margins)
    return each / each.sum(axis=-1, keepdims=True)


def _second(chances: np.ndarray) -> np.ndarray:
    return chances[..., 1:2]


def _same(values: np.ndarray) -> np.ndarray:
    return values


@dataclass(frozen=True)
class Mixer:
    """The answers of a model for mixtures: sums that ``link`` turns into predictions, or into chances of the classes."""

    sums: list
    link: object

    def parts(self, x: np.ndarray) -> list:
        return [some.parts(x) for some in self.sums]

    def mixed(self, own: list, other: list, pick: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """steps x rows x picks x outputs"""
        each = [some.mixed(mine, theirs, pick, rank) for some, mine, theirs in zip(self.sums, own, other)]
        return np.stack([self.link(np.concatenate(told, axis=-1)) for told in zip(*each)])


def mixer(spark: SparkSession, model, players: Sequence[int], features: int, classes: int) -> Mixer | None:
    """Of a fitted model as ``candidates`` has them; None of others. Two classes are told by the chance of the second."""
    trees = lambda some: TreeSums(spark, some, players, features)
    if isinstance(model, (DecisionTreeRegressionModel, RandomForestRegressionModel, GBTRegressionModel)):
        return Mixer([trees(model)], _same)
    if isinstance(model, LinearRegressionModel):
        found = Margins(model.coefficients.toArray()[None, :], np.array([model.intercept]), players, features), _same
    elif classes < 2 or getattr(model, "numClasses", classes) != classes:
        return None
    elif isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel)):
        return Mixer([trees(model)], _second if classes == 2 else _same)
    elif isinstance(model, GBTClassificationModel):
        return Mixer([trees(model)], lambda margin: _sigmoid(2 * margin))
    elif isinstance(model, OneVsRestModel) and all(isinstance(m, GBTClassificationModel) for m in model.models):
        return Mixer([trees(m) for m in model.models], _shares if classes > 2 else lambda margins: _second(_shares(margins)))
    elif isinstance(model, LogisticRegressionModel):
        weights, starts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        link = _sigmoid if len(weights) == 1 else _softmax if classes > 2 else lambda margins: _second(_softmax(margins))
        found = Margins(weights, starts, players, features), link
    else:
        return None
    finite = np.isfinite(found[0].weights).all() and np.isfinite(found[0].starts).all()  # a class of no rows has an endless margin
    return Mixer([found[0]], found[1]) if finite else None


def walks(mix: Mixer, ground: np.ndarray, features: int, permutations: int):
    """A function of Arrow batches for ``mapInArrow``: one row a task, ``n`` rows and the ``sums`` of their absolute values, features x outputs.

    Batches hold ``a`` and ``b``, which tell a row and by which they are sorted; ``x``, its vector; ``r``, for each permutation the number that
    picks the background row and one for each feature, by which they come in. Rows of equal ``a`` and ``b`` share one walk: the last is scored,
    and each of its steps counts once among theirs.
    """
    block = max(1, CELLS // (permutations * features))

    def told(x: np.ndarray, r: np.ndarray, copies: np.ndarray, base: list) -> np.ndarray:
        r = r.reshape(len(x), permutations, features + 1)
        rank = np.ascontiguousarray(np.moveaxis(r[:, :, 1:].argsort(axis=2, kind="stable").argsort(axis=2), 2, 0))
        answers = mix.mixed(mix.parts(x), base, r[:, :, 0] % len(ground), rank)
        out = []
        for f in range(features):
            at = rank[f][None, :, :, None]
            steps = np.take_along_axis(answers, at + 1, axis=0)[0] - np.take_along_axis(answers, at, axis=0)[0]
            out.append(np.abs(steps.sum(axis=1) / (permutations * copies[:, None])).sum(axis=0))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total, n, held = mix.parts(ground), 0.0, 0, None  # held: the last row so far, whose copies may go on
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [np.stack([batch.column(c).to_numpy() for c in "ab"], axis=1), *(
                batch.column(c).flatten().to_numpy().reshape(rows, -1) for c in "xr"), np.ones(rows, dtype=int)]
            ids, x, r, copies = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns)]
            ends = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
            upto = np.cumsum(copies)
            many = np.diff(upto[ends], prepend=0)
            for i in range(0, len(ends), block):
                some = ends[i:i + block]
                total = total + told(x[some], r[some], many[i:i + block], base)
            n += len(ends)
            held = ids[-1:], x[-1:], r[-1:], upto[-1:] - (upto[ends[-1]] if len(ends) else 0)
        if held is not None:
            total = total + told(*held[1:], base)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n + 1], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})

    return run
