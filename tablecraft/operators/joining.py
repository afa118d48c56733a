"""Equi-join of two tables with suffixes, coalesced keys and balanced hot keys."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, functions as F

from tablecraft.operators.lookup import (
    BROADCAST_BYTES, BROADCAST_ROWS, Heavy, equi_join, fits_broadcast, grid_join, heavy_keys, salted_join,
)

# Matched pairs of hot keys that one task may put out.
TASK_PAIRS = 2_500_000
MOST_TASKS = 5_000
# Slices of a side that are broadcast one after the other where the grid would copy the other side.
MOST_SLICES = 8


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner",
                null_safe: bool = True, suffixes: tuple[str, str] = ("_file1", "_file2"),
                balance: bool = True) -> DataFrame:
    """Join on ``left_key = right_key``; how is inner, left, right or outer.

    Shared names get suffixes, a same-named key is kept once, null keys match each other unless
    ``null_safe`` is False. A side measured small is broadcast, the other dealt over as many tasks as the matches of its hot keys ask for; a right or
    outer join is then an inner or left join beside the rows without a partner. ``balance`` cuts hot keys of two larger sides into pieces that
    meet in tasks of their own, or broadcasts the smaller side by slices while they are few. ``balance=False`` leaves everything to the optimizer.
    """
    if left_key not in left.columns or right_key not in right.columns:
        raise ValueError(f"join key {left_key!r} or {right_key!r} not found")
    same = left_key == right_key
    shared = {c for c in left.columns if c in right.columns and not (same and c == left_key)}
    a_names = {c: c + suffixes[0] if c in shared else c for c in left.columns}
    b_names = {c: c + suffixes[1] if c in shared else c for c in right.columns}
    a = left.select(F.col(left_key).alias("_k"), *[
        F.col(c).alias(f"_a_{n}") for c, n in a_names.items() if not (same and c == left_key)])
    b = right.select(F.col(right_key).alias("_k"), *[
        F.col(c).alias(f"_b_{n}") for c, n in b_names.items() if not (same and c == right_key)])

    heavy = heavy_keys(a, b, ["_k"]) if balance else Heavy()

    def run(x, y, kind, found):
        if not balance:
            return equi_join(x, y, ["_k"], kind, null_safe)
        if _is_small(y, found.right_rows):
            return equi_join(_dealt(x, found), F.broadcast(y), ["_k"], kind, null_safe)
        sides = [(x, y, found), (y, x, found.turned())]
        sides = [side for side in sides if _is_small(side[1], side[2].right_rows)] or sorted(sides, key=lambda side: side[2].right_rows)
        wide, few, seen = sides[0]
        slices = 1 if _is_small(few, seen.right_rows) else _slices(few, seen)
        if not slices:
            return grid_join(x, y, ["_k"], kind, found, null_safe)
        dealt = _dealt(wide, seen)
        parts = [equi_join(dealt, F.broadcast(_slice(few, i, slices)), ["_k"], "inner", null_safe) for i in range(slices)]
        if kind == "left":
            parts.append(_lone(x, y, found, null_safe))
        return functools.reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), parts)

    if how == "right":
        joined = run(b, a, "left", heavy.turned())
    elif how == "outer":
        # A left join can split a hot left key; the unmatched right rows follow from an anti-join.
        lone = _lone(b, a, heavy.turned(), null_safe) if balance else equi_join(b, a, ["_k"], "left_anti", null_safe)
        joined = run(a, b, "left", heavy).unionByName(lone, allowMissingColumns=True)
    else:
        joined = run(a, b, how, heavy)
    out = []
    if same:
        out.append(F.col("_k").alias(left_key))
    out += [F.col(f"_a_{n}").alias(n) for c, n in a_names.items() if not (same and c == left_key)]
    out += [F.col(f"_b_{n}").alias(n) for c, n in b_names.items() if not (same and c == right_key)]
    return joined.select(*out)


def _is_small(side: DataFrame, rows: int) -> bool:
    return rows <= BROADCAST_ROWS and fits_broadcast(side)


def _dealt(side: DataFrame, found: Heavy) -> DataFrame:
    """The side beside a broadcast: a small file has few splits, however many matches its rows have.

    Rows of a key are neighbours in a task, as their matches are in the result.
    """
    tasks = math.ceil(sum(l * r for l, r in found.keys.values()) / TASK_PAIRS)
    return side.repartition(min(tasks, MOST_TASKS)).sortWithinPartitions("_k") if tasks > 1 else side


def _slices(side: DataFrame, found: Heavy) -> int:
    """How many broadcasts the side takes; 0 where no key is cut on both sides, so that the grid copies little, or the side is too large."""
    most = MOST_SLICES * BROADCAST_ROWS
    cut = found.grid(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if found.right_rows > most or all(min(cells) == 1 for cells in cut.values()):
        return 0
    for n in range(math.ceil(found.right_rows / BROADCAST_ROWS), MOST_SLICES + 1):
        if fits_broadcast(side, most, n * BROADCAST_BYTES):
            return n
    return 0


def _slice(side: DataFrame, i: int, slices: int) -> DataFrame:
    # By contents, so a slice read again has the same rows.
    return side.where(F.pmod(F.xxhash64(*side.columns), F.lit(slices)) == i) if slices > 1 else side


def _lone(x: DataFrame, y: DataFrame, found: Heavy, null_safe: bool) -> DataFrame:
    """Rows of x without a partner in y; the keys to look for are those of the smaller side."""
    keys = y.select("_k")
    if _is_small(x.select("_k"), found.left_rows):
        met = equi_join(keys, F.broadcast(x.select("_k").distinct()), ["_k"], "left_semi", null_safe).distinct()
        return equi_join(x, F.broadcast(met), ["_k"], "left_anti", null_safe)
    keys = keys.distinct()
    if fits_broadcast(keys):
        return equi_join(x, F.broadcast(keys), ["_k"], "left_anti", null_safe)
    return salted_join(x, keys, ["_k"], "left_anti", null_safe=null_safe)
