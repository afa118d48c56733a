"""Selecting, renaming, reordering and computing columns."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.cells import blank_missing, finite_or_null, floor_mod, parse_numeric
from tablecraft.operators.lookup import attach

NUMERIC_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(df: DataFrame, name: str) -> bool:
    kind = dict(df.dtypes)[name]
    return kind in NUMERIC_KINDS or kind.startswith("decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def as_number(df: DataFrame, name: str, scale_percent: bool = True) -> Column:
    """The column as a double: typed columns directly, text cells parsed; NaN and infinities are gaps."""
    if is_numeric(df, name):
        number = F.col(name).cast("double")
        return finite_or_null(number) if dict(df.dtypes)[name] in ("float", "double") else number
    if dict(df.dtypes)[name] == "string":
        return parse_numeric(name, scale_percent)
    return F.col(name).cast("string").try_cast("double")


def rows_of(wide: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    """One row per struct column of a one-row frame: ``name`` and the struct's fields.

    Through an array, which merges the null flags of its elements; ``unpivot`` would take those of
    the first column and read null figures of the others as zero.
    """
    if not columns:
        raise ValueError("no columns to turn into rows")
    each = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias("_s")) for c in columns]
    return wide.select(F.inline(F.array(*each))).select(name, "_s.*")


def chart_points(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], limit: int = 1000) -> DataFrame:
    """Plain rows of the chosen columns, the first ``limit`` in a given order."""
    return df.select(*dict.fromkeys([*columns, *order_by])).orderBy(*order_by).limit(limit).select(*columns)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if sorted(names) != sorted(df.columns):
        raise ValueError("the new order must be a permutation of the columns")
    return df.select(*names)


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def add_measure(df: DataFrame, name: str, left: str, op: str, right, join_text: bool = False) -> DataFrame:
    """``left op right`` with a column or a constant on the right; op is + - * / % or CONCAT.

    ``join_text=True`` lets ``+`` join cells that are not numbers on both sides.
    """
    for needed in (left, right):
        if isinstance(needed, str) and op != "CONCAT" and needed not in df.columns:
            raise ValueError(f"unknown column {needed!r}")
    right_col = F.col(right) if isinstance(right, str) and right in df.columns else F.lit(right)
    if op == "CONCAT":
        return df.withColumn(name, F.concat_ws(" ", F.col(left).cast("string"), right_col.cast("string")))
    a = as_number(df, left)
    b = as_number(df, right) if isinstance(right, str) else F.lit(float(right))
    basic = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": F.try_divide, "%": floor_mod}
    result = basic[op](a, b)
    if op == "+" and join_text:
        glued = F.concat(
            F.coalesce(F.col(left).cast("string"), F.lit("")), F.coalesce(right_col.cast("string"), F.lit(""))
        )
        result = F.when(a.isNotNull() & b.isNotNull(), result.cast("string")).otherwise(glued)
    return df.withColumn(name, result)


def add_expression(df: DataFrame, name: str, expression: str) -> DataFrame:
    """New column from a Spark SQL expression whose text columns read as numbers."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    numbers = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *[as_number(df, c).alias(c) for c in df.columns])
    return numbers.withColumn(name, F.expr(expression)).select("_row.*", name)


def patch_cells(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply edits ``(key, column, value)``: missing tokens clear a cell, text is cast to the column's type."""
    kinds = dict(df.dtypes)
    targets = [c for c in df.columns if c != key]
    wide = edits.groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, F.struct(F.col("value")))).alias(f"_e_{c}") for c in targets]
    )
    joined = attach(df, wide, [key])
    patched = [
        F.when(
            F.col(f"_e_{c}").isNotNull(), blank_missing(F.col(f"_e_{c}").getField("value")).try_cast(kinds[c])
        ).otherwise(F.col(c)).alias(c)
        for c in targets
    ]
    return joined.select(key, *patched).select(*df.columns)
