"""Correlation and bivariate statistics: all pairs in one aggregate, pairwise complete."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.operators.lookup import attach
from tablecraft.operators.ordering import running_sum
from tablecraft.operators.projection import as_number, numeric_columns, rows_of
from tablecraft.session import materialize

AGGREGATE_COLUMNS = 6


def varies(c: Column) -> Column:
    """Whether a group holds two different values. Sums of squares of a constant may come out as
    tiny noise when partial aggregates are merged, so they cannot tell."""
    return F.min(c) < F.max(c)


def pearson(a, b) -> Column:
    """Pairwise-complete Pearson r; null when either side has no spread."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = varies(F.when(b.isNotNull(), a)) & varies(F.when(a.isNotNull(), b))
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    return F.when(both, F.try_divide(F.regr_sxy(a, b), spread))


def strength(r: Column) -> Column:
    """Strong from 0.8, Moderate from 0.5, Weak from 0.2, with the direction."""
    size, way = F.abs(r), F.when(r >= 0, "Positive").otherwise("Negative")
    return (
        F.when(size >= 0.8, F.concat(F.lit("Strong "), way))
        .when(size >= 0.5, F.concat(F.lit("Moderate "), way))
        .when(size >= 0.2, F.concat(F.lit("Weak "), way))
        .otherwise("Negligible / Uncorrelated")
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, min_n: int = 0) -> DataFrame:
    """``a, b, n, r`` for every pair of numeric columns over the rows that have both, one scan.

    Some columns make one aggregate; more make sums of products of whole column blocks in tasks, added up by pair.
    Both are the same rule.
    """
    names = list(columns or numeric_columns(df))
    data = df.select(*[as_number(df, c).alias(c) for c in names])
    if len(names) > AGGREGATE_COLUMNS:
        return _product_pairs(data, names).filter(F.col("n") >= min_n)
    pairs = list(combinations(names, 2))
    wide = data.agg(*[
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.regr_count(a, b).alias("n"), pearson(a, b).alias("r")
        ).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    long = rows_of(wide, wide.columns, "_p").drop("_p")
    return long.filter(F.col("n") >= min_n)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """Long form ``x, y, value`` of the full matrix; undefined entries become ``fill``."""
    names = list(columns or numeric_columns(df))
    half = correlation_pairs(df, names)
    cells = F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("r").alias("value")),
        F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.col("r").alias("value")),
    )
    whole = half.select(F.inline(cells))
    own = df.agg(*[varies(as_number(df, c)).alias(c) for c in names]).unpivot([], names, "x", "v")
    diagonal = own.select("x", F.col("x").alias("y"), F.when(F.col("v"), 1.0).alias("value"))
    out = whole.unionByName(diagonal)
    return out if fill is None else out.fillna(fill, subset=["value"])


PAIR_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_ENDS = ("lox", "loy", "hix", "hiy")


def _product_pairs(data: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r from masked products of the column matrix, centred at the middle of each column."""
    ends = data.agg(*[((F.min(f"`{c}`") + F.max(f"`{c}`")) / 2).alias(f"m{i}") for i, c in enumerate(names)]).first()
    middle = np.array([x if x is not None else 0.0 for x in ends])
    left, right = np.triu_indices(len(names), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names)
        total = {k: np.zeros((width, width)) for k in ("n", "s", "ss", "p")}
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - middle
            there = ~np.isnan(x)
            mask, x = there.astype(float), np.where(there, x, 0.0)
            for k, a, b in (("n", mask, mask), ("s", x, mask), ("ss", x * x, mask), ("p", x, x)):
                total[k] += a.T @ b
            # Extremes of all columns over the rows that have column j; columns without gaps share them.
            for j in np.unique(there, axis=1, return_index=True)[1] if len(x) else ():
                rows = x[there[:, j]]
                if len(rows):
                    alike = (there == there[:, j:j + 1]).all(axis=0)
                    seen = there[there[:, j]]
                    least = np.where(seen, rows, np.inf).min(axis=0)[:, None]
                    most = np.where(seen, rows, -np.inf).max(axis=0)[:, None]
                    low[:, alike] = np.minimum(low[:, alike], least)
                    high[:, alike] = np.maximum(high[:, alike], most)
        out = [total["n"], total["s"], total["s"].T, total["ss"], total["ss"].T, total["p"], low, low.T, high, high.T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *(pa.array(m[left, right]) for m in out)], ["i", "j", *PAIR_SUMS, *PAIR_ENDS])

    kinds = ", ".join(f"{c} double" for c in (*PAIR_SUMS, *PAIR_ENDS))
    plain = data.toDF(*[f"c{i}" for i in range(len(names))])
    found = plain.mapInArrow(sums, f"i int, j int, {kinds}").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in PAIR_SUMS], *[F.min(c).alias(c) for c in PAIR_ENDS[:2]], *[F.max(c).alias(c) for c in PAIR_ENDS[2:]])
    c = F.col
    spread = F.sqrt(c("sxx") - c("sx") * c("sx") / c("n")) * F.sqrt(c("syy") - c("sy") * c("sy") / c("n"))
    r = F.when((c("lox") < c("hix")) & (c("loy") < c("hiy")), F.try_divide(c("sxy") - c("sx") * c("sy") / c("n"), spread))
    named = F.array(*[F.lit(n) for n in names])
    return found.select(F.get(named, c("i")).alias("a"), F.get(named, c("j")).alias("b"), c("n").cast("bigint").alias("n"), r.alias("r"))


def average_ranks(cells: DataFrame) -> DataFrame:
    """``column, value, n, rank`` of cells ``column, value``: the mean rank of every distinct value, from cumulative counts."""
    counts = materialize(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    cum = running_sum(counts, ["value"], F.col("n"), "hi", partition_by=["column"])
    return cum.select("column", "value", "n", (F.col("hi") - (F.col("n") - 1) / 2).alias("rank"))


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of every pair over rows without gaps: Pearson over mean ranks.

    The cells of all columns meet their ranks in one join, hot values salted, and return to their rows in one grouping,
    whatever the number of columns.
    """
    names = list(columns or numeric_columns(df))
    whole = df.select(*[as_number(df, c).alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    rows = materialize(whole.withColumn("row", F.monotonically_increasing_id()))  # stored, so a row keeps its number
    cells = rows.select("row", F.posexplode(F.array(*[f"v{i}" for i in range(len(names))])).alias("column", "value"))
    ranks = materialize(average_ranks(cells).select("column", "value", "rank"))
    met = attach(cells, ranks, ["column", "value"], "inner", is_stored=True)
    ranked = met.groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("rank"))).alias(c) for i, c in enumerate(names)])
    return correlation_pairs(ranked.drop("row"), names)


def pair_strength(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = as_number(df, a), as_number(df, b)
    one = df.agg(F.regr_count(x, y).alias("n"), pearson(x, y).alias("r"))
    return one.withColumn("strength", strength(F.col("r")))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares y = slope * x + intercept over complete pairs."""
    a, b = as_number(df, x), as_number(df, y)
    steep = varies(F.when(b.isNotNull(), a))
    return df.agg(
        F.regr_count(b, a).alias("n"), F.when(steep, F.regr_slope(b, a)).alias("slope"),
        F.when(steep, F.regr_intercept(b, a)).alias("intercept"),
    )
