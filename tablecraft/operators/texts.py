"""Text, category and privacy transforms over chosen columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions import cells
from tablecraft.operators.lookup import attach
from tablecraft.operators.projection import text_columns
from tablecraft.operators.typing_ops import value_table
from tablecraft.session import materialize

# Department aliases. -------------------------------------------------------------
DEPARTMENT_COLUMN = r"(?i)department|dept|team"
DEPARTMENT_ALIASES = (
    (r"(?i)^human\s*resources$|^hr$", "HR"),
    (r"(?i)^information\s*technology$|^it$", "IT"),
)
# -----------------------------------------------------------------------------------------------

CASES: Mapping[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "title": cells.title_case,
    "word": lambda c: cells.title_case(c, "word"),
}


def _chosen(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [c for c in (columns or text_columns(df)) if c in df.columns]


def map_text(df: DataFrame, change: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: change(F.col(c)) for c in _chosen(df, columns)})


def trim_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return map_text(df, cells.trim_ws, columns)


def squeeze_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return map_text(df, cells.squeeze_ws, columns)


def change_case(df: DataFrame, style: str, columns: Sequence[str] | None = None) -> DataFrame:
    return map_text(df, CASES[style], columns)


def changed_cells(df: DataFrame, change: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """How many cells of each column a text change would alter."""
    names = _chosen(df, columns)
    wide = df.agg(*[F.count_if(change(F.col(c)) != F.col(c)).alias(c) for c in names])
    return wide.unpivot([], names, "column", "changed")


def whitespace_issues(df: DataFrame, columns: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    """Cells with outer (``strict``: or repeated inner) white space."""
    names = _chosen(df, columns)

    def bad(c):
        return F.col(c).rlike(cells.RX_WHITESPACE_ISSUE) if strict else cells.trim_ws(c) != F.col(c)

    wide = df.agg(*[F.count_if(bad(c)).alias(c) for c in names])
    return wide.unpivot([], names, "column", "issues")


def category_maps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, variant, canonical, n``: canonical is the most frequent spelling of a caseless group.

    All columns share one scan and one shuffle of distinct cells.
    """
    variants = (
        value_table(df, columns).filter("value is not null")
        .groupBy("column", cells.trim_ws("value").alias("variant")).agg(F.sum("n").alias("n"))
    )
    groups = variants.groupBy(F.col("column").alias("_c"), F.lower("variant").alias("_g")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "variant")).alias("best")
    )
    same = (F.col("column") == F.col("_c")) & (F.lower("variant") == F.col("_g"))
    return variants.join(groups, same).select("column", "variant", F.col("best.variant").alias("canonical"), "n")


def category_map(df: DataFrame, column: str) -> DataFrame:
    return category_maps(df, [column]).drop("column")


def normalize_columns(df: DataFrame, columns: Sequence[str], aliases: bool = True) -> DataFrame:
    """Replace each spelling by the most frequent one of its caseless group, column by column."""
    names = [c for c in columns if c in df.columns]
    if not names:
        return df
    maps = materialize(category_maps(df, names).filter("variant <> canonical").drop("n"))
    out = df
    for c in names:
        lookup = maps.filter(F.col("column") == c).select(F.col("variant").alias("_variant"), "canonical")
        joined = attach(out.withColumn("_variant", cells.trim_ws(c)), lookup, ["_variant"], is_stored=True)
        value = F.coalesce("canonical", F.when(F.col(c).isNotNull(), F.col("_variant")))
        if aliases and _is_department(c):
            value = department_alias(value)
        out = joined.withColumn(c, value).select(*df.columns)
    return out


def normalize_categories(df: DataFrame, column: str, aliases: bool = True) -> DataFrame:
    return normalize_columns(df, [column], aliases)


def _is_department(column: str) -> bool:
    return bool(re.search(DEPARTMENT_COLUMN, column))


def department_alias(c: Column) -> Column:
    cell = cells.trim_ws(c)
    out = c
    for pattern, name in DEPARTMENT_ALIASES:
        out = F.when(cell.rlike(pattern), name).otherwise(out)
    return out


def map_categories(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace exact cell texts by an explicit mapping."""
    if not mapping:
        return df
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def casing_variants(df: DataFrame, column: str) -> DataFrame:
    """Caseless groups written in more than one way."""
    variants = df.filter(F.col(column).isNotNull()).groupBy(cells.trim_ws(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        variants.groupBy(F.lower("v").alias("value"))
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"))
        .filter("variants > 1")
    )


def standardize_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_text(df, cells.iso_date, columns)


def pii_columns(df: DataFrame, keywords: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(k in c.lower() for k in keywords)]


def mask_columns(df: DataFrame, style: str = "server", columns: Sequence[str] | None = None) -> DataFrame:
    """Mask personal data in the given columns, or in those whose name suggests it."""
    mask, keywords = {
        "server": (cells.mask_server, cells.PII_NAMES_SERVER),
        "browser": (cells.mask_browser, cells.PII_NAMES_BROWSER),
        "short": (cells.mask_short, cells.PII_NAMES_SHORT),
        "email": (cells.redact_email_cell, ()),
    }[style]
    names = [c for c in (columns or (pii_columns(df, keywords) if keywords else text_columns(df))) if c in df.columns]
    return df.withColumns({c: mask(F.col(c)) for c in names}) if names else df
