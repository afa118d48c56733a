"""Row filters, search, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.cells import is_missing, text, trim_ws
from tablecraft.operators.projection import as_number


def filter_rows(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    """Keep rows where ``column op value``; numbers compare parsed, text trimmed and caseless."""
    number = as_number(df, column)
    cell = F.lower(trim_ws(column))
    wanted = str(value).strip().lower()
    tests = {
        ">": lambda: number > float(value),
        "<": lambda: number < float(value),
        ">=": lambda: number >= float(value),
        "<=": lambda: number <= float(value),
        "==": lambda: cell == wanted,
        "=": lambda: cell == wanted,
        "!=": lambda: ~cell.eqNullSafe(F.lit(wanted)),
        "contains": lambda: F.lower(text(column)).contains(str(value).lower()),
        "is_null": lambda: is_missing(column),
        "not_null": lambda: ~is_missing(column),
    }
    return df.filter(tests[op]())


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows where any cell contains the text, ignoring case."""
    hits = [F.coalesce(F.lower(text(c)).contains(needle.lower()), F.lit(False)) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def any_missing(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(c) for c in columns])


def rows_with_missing(df: DataFrame) -> DataFrame:
    return df.filter(any_missing(df.columns))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing cell in the given (default: all) columns."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    return df.filter(~any_missing(names)) if names else df


def sort_rows(df: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Numbers first by value, then text by letters, missing last; ``ties`` make the order total."""
    number, cell = as_number(df, column), F.lower(text(column))
    if ascending:
        keys = [number.asc_nulls_last(), cell.asc_nulls_last()]
    else:
        keys = [number.desc_nulls_last(), cell.desc_nulls_last()]
    return df.orderBy(*keys, *ties)


def sort_nulls_last(df: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *ties)


def top_k(df: DataFrame, measure: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), *ties).limit(k)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return df.offset(size * (number - 1)).limit(size)
