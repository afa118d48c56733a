"""Exact linear-interpolation quantiles that do not need a group's values in one task.

``percentile`` keeps a value -> count map, so it is used only while the number of distinct values is
measured to be small. Beyond that whole columns are answered by selection: histograms of all columns at
once, refined around the wanted ranks, without a sort and without sending a row through a shuffle. Groups
get the same answer from cumulative counts over ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.operators.lookup import attach
from tablecraft.operators.ordering import running_sum

MAX_DISTINCT = 500_000
# Entries of the maps of all columns of one plan together; the columns beyond them are answered by selection.
MAX_ENTRIES = 1_000_000
# Bins of one refinement, and rows of a bin that are few enough to be counted value by value.
BINS, FEW = 1024, 2000
# Numbers of the bins of the first histogram: one for each power of two, these for infinite and for NaN.
INFINITE, NOT_A_NUMBER, ZERO_EXPONENT = 4000, 5000, 1100


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float],
                    max_distinct: int = MAX_DISTINCT, approx: bool = False) -> DataFrame:
    """One row per key group: ``q`` holds the quantiles of ``column`` in the order of ``probs``."""
    data = df.select(*keys, F.col(column).cast("double").alias("_x")).filter("_x is not null")
    at = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        return data.groupBy(*keys).agg(F.percentile_approx("_x", at, 10_000).alias("q"))
    distinct = data.agg(F.approx_count_distinct("_x").alias("d")).first()["d"]
    if distinct <= max_distinct:
        return data.groupBy(*keys).agg(F.percentile("_x", at).alias("q"))
    return _ranked(data, keys, probs)


def _ranked(data: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    counts = data.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(counts, ["_x"], F.col("_c"), "_hi", partition_by=keys)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        ranked = attach(cum, totals, keys)
    else:
        ranked = cum.withColumn("_n", F.lit(totals.first()["_n"]))
    aggs = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        for side, target in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("_hi") > target) & (F.col("_hi") - F.col("_c") <= target)
            aggs.append(F.max(F.when(holds, F.col("_x"))).alias(f"{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *aggs)
    values = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        part = rank - F.floor(rank)
        values.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part)
    return found.select(*keys, F.array(*values).alias("q"))


def _by_scale(x: Column) -> Column:
    """A whole number that does not fall as x rises: sign and power of two; zero, infinite and NaN apart."""
    size = F.when(F.abs(x) == float("inf"), INFINITE).otherwise(F.floor(F.log2(F.abs(x))) + ZERO_EXPONENT)
    return F.when(F.isnan(x), NOT_A_NUMBER).when(x == 0, 0).otherwise(F.signum(x) * size).cast("int")


class _Bracket:
    """Values from ``low`` to ``high`` of one column, with the number of rows below and inside, and the ranks looked for in it."""

    def __init__(self, column: str, low: float, high: float, below: int, rows: int, ranks: list[int]):
        self.column, self.low, self.high, self.below, self.rows, self.ranks = column, low, high, below, rows, ranks

    def settle(self, bins: list[tuple], found: dict) -> list[_Bracket]:
        """Put the ranks whose bin holds one value into ``found``; the brackets of the others. Bins are (low, high, rows) in order."""
        below, left = self.below, []
        for low, high, rows in bins:
            inside = [r for r in self.ranks if below <= r < below + rows]
            if inside and (low == high or low != low):
                found.update({(self.column, r): low for r in inside})
            elif inside:
                left.append(_Bracket(self.column, low, high, below, rows, inside))
            below += rows
        return left


def select_ranks(data: DataFrame, ranks: Callable[[int], Sequence[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per double column: its number of values and the values at the places ``ranks(number)`` (from 0) of their order, nulls left out.

    The first pass counts values by sign and power of two; each further one cuts the brackets of all columns that hold a
    wanted rank into equal bins, and takes the least and greatest value that a bin really has as the next bracket. Brackets of
    few rows are counted value by value. A pass is one aggregation over all columns: it shuffles bins, not rows; a
    bracket of 52 bits of one power of two needs five passes at most.
    """
    names = data.columns
    cells = data.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("x")) for i, c in enumerate(names)])))
    tally = [F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")]

    def bins(rows: DataFrame, by: Column) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for r in sorted(rows.groupBy("at", by.alias("bin")).agg(*tally).collect(), key=lambda r: (r["at"], r["bin"])):
            out.setdefault(r["at"], []).append((r["low"], r["high"], r["rows"]))
        return out

    found: dict[tuple[str, int], float] = {}
    sizes, open_ = dict.fromkeys(names, 0), []
    for at, groups in bins(cells.where("x is not null"), _by_scale(F.col("x"))).items():
        sizes[names[at]] = sum(rows for _, _, rows in groups)
        wanted = sorted(set(ranks(sizes[names[at]])))
        open_ += _Bracket(names[at], 0.0, 0.0, 0, sizes[names[at]], wanted).settle(groups, found)
    while open_:
        inside = data.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("at"), F.when(F.col(b.column).between(b.low, b.high), F.col(b.column)).alias("x")) for i, b in enumerate(open_)
        ]))).where("x is not null")
        low = F.element_at(F.array(*[F.lit(b.low) for b in open_]), F.col("at") + 1)
        width = F.element_at(F.array(*[F.lit(b.high - b.low) for b in open_]), F.col("at") + 1)
        few = F.element_at(F.array(*[F.lit(b.rows <= FEW) for b in open_]), F.col("at") + 1)
        cut = F.least(F.floor((F.col("x") - low) / width * BINS), F.lit(BINS - 1)).cast("double")
        groups = bins(inside, F.when(few, F.col("x")).otherwise(cut))
        open_ = [part for i, b in enumerate(open_) for part in b.settle(groups[i], found)]
    out: dict[str, tuple[int, dict[int, float]]] = {c: (sizes[c], {}) for c in names}
    for (column, rank), value in found.items():
        out[column][1][rank] = value
    return out


def _selected(data: DataFrame, probs: Sequence[float]) -> dict[str, list[float] | None]:
    def ranks(n):
        return [whole for p in probs for whole in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out: dict[str, list[float] | None] = {}
    for column, (n, values) in select_ranks(data, ranks).items():
        q = []
        for p in probs if n else []:
            rank = p * (n - 1)
            low, high = values[math.floor(rank)], values[math.ceil(rank)]
            q.append(low if low == high else low + (high - low) * (rank - math.floor(rank)))
        out[column] = q or None
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     max_distinct: int = MAX_DISTINCT, approx: bool = False,
                     sizes: Mapping[str, int] | None = None) -> dict[str, list[float] | None]:
    """Quantiles of whole columns as driver-side numbers (one small row).

    ``sizes`` passes distinct counts that the caller has measured already.
    """
    if not columns:
        return {}
    at = F.array(*[F.lit(float(p)) for p in probs])
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if approx:
        row = data.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    if sizes is None:
        sizes = data.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    small, entries = [], 0
    for c in sorted(columns, key=lambda c: sizes[c]):
        entries += sizes[c]
        if sizes[c] <= max_distinct and entries <= MAX_ENTRIES:
            small.append(c)
    out: dict[str, list[float] | None] = {}
    if small:
        row = data.agg(*[F.percentile(c, at).alias(c) for c in small]).first()
        out.update({c: row[c] for c in small})
    large = [c for c in columns if c not in out]
    if large:
        out.update(_selected(data.select(*large), probs))
    return out


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact lower medians of whole columns, nulls and NaN left out: the value at place ceil(n / 2), none of an empty column."""
    if not columns:
        return {}
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    return {c: next(iter(values.values()), None) for c, (_, values) in select_ranks(data, lambda n: [(n - 1) // 2] if n else []).items()}
