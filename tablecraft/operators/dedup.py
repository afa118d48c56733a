"""Duplicate removal by aggregation, so that a group of copies is combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.cells import text, trim_ws


def _key(c: str, normalize: str | None) -> Column:
    if normalize is None:
        return F.col(c)
    cell = F.coalesce(trim_ws(c), F.lit(""))
    return F.lower(cell) if normalize == "trim_lower" else cell


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order_by: Sequence[str] = (),
          normalize: str | None = None) -> DataFrame:
    """One row per key. ``keep`` is first, last (by ``order_by``, a total order) or none."""
    subset = list(subset or df.columns)
    keys = [_key(c, normalize).alias(f"_k{i}") for i, c in enumerate(subset)]
    names = [f"_k{i}" for i in range(len(subset))]
    row = F.struct(*[F.col(c) for c in order_by], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(df.columns)])
    work = df.select(*keys, row.alias("_row"))
    if keep == "none":
        kept = work.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row")).filter("_n = 1")
    else:
        pick = F.min if keep == "first" else F.max
        kept = work.groupBy(*names).agg(pick("_row").alias("_row"))
    return kept.select(*[F.col(f"_row._v{i}").alias(c) for i, c in enumerate(df.columns)])


def repeated_rows(df: DataFrame, order_by: Sequence[str], subset: Sequence[str] | None = None) -> DataFrame:
    """The second and later occurrences of each key; ``order_by`` identifies a row.

    The first occurrences are found by a combining aggregate and removed by an anti-join on the row
    identity, which is unique, so a key with very many copies never lands in one task.
    """
    subset = list(subset or [c for c in df.columns if c not in order_by])
    identity = F.struct(*[F.col(c) for c in order_by])
    firsts = df.groupBy(*subset).agg(F.min(identity).alias("_first"))
    return df.join(firsts, identity.eqNullSafe(F.col("_first")), "left_anti")


def duplicate_count(df: DataFrame, normalize: str | None = None) -> DataFrame:
    """Rows beyond the first of each identical group."""
    groups = df.groupBy(*[_key(c, normalize).alias(f"_k{i}") for i, c in enumerate(df.columns)]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def row_text(df: DataFrame) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(text(c), F.lit("")) for c in df.columns])
