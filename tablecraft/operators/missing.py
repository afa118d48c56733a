"""Filling gaps: column statistics are fitted in one pass, then applied as literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.cells import blank_missing, finite_or_null, is_missing
from tablecraft.operators.cell_counts import top_cells
from tablecraft.operators.ordering import fill_along
from tablecraft.operators.projection import as_number, is_numeric, numeric_columns, text_columns
from tablecraft.operators.quantiles import column_quantiles


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns become null."""
    kinds = dict(df.dtypes)
    return df.select(
        *[finite_or_null(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    )


def iso_timestamps(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    kinds = dict(df.dtypes)
    shape = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd'T'HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss"}
    return df.select(
        *[F.date_format(c, shape[kinds[c]]).alias(c) if kinds[c] in shape else F.col(c) for c in df.columns]
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties.

    Columns of one family are counted together in one pass; counts are combined before the shuffle.
    """
    families: dict[str, list[str]] = {}
    kinds = dict(df.dtypes)
    for c in columns:
        whole = kinds[c] in ("tinyint", "smallint", "int", "bigint")
        families.setdefault("bigint" if whole else kinds[c], []).append(c)
    out: dict[str, object] = dict.fromkeys(columns)
    if "string" in families:
        out.update({r["column"]: r["value"] for r in top_cells(df, families.pop("string")).collect()})
    for kind, names in families.items():
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in names])
        counts = df.select(F.inline(cells)).filter("value is not null").groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
        out.update({r["column"]: r["b"]["value"] for r in best.collect()})  # one row per column
    return out


def fit_fill(df: DataFrame, methods: Mapping[str, str], approx: bool = False) -> dict[str, object]:
    """Replacement value per column for mean, median, mode, zero, unknown or ``=constant``."""
    present = {c: m for c, m in methods.items() if c in df.columns}
    measured = [c for c, m in present.items() if m in ("mean", "median", "mode")]
    fill: dict[str, object] = {}
    if measured:
        # One pass finds the columns with gaps, the means and how many values a median must sort; columns without gaps are left alone.
        facts = df.agg(
            *[F.count_if(F.col(c).isNull()).alias(f"gaps_{c}") for c in measured],
            *[F.avg(as_number(df, c)).alias(f"mean_{c}") for c in measured if present[c] == "mean"],
            *[F.approx_count_distinct(as_number(df, c)).alias(f"size_{c}") for c in measured if present[c] == "median"],
        ).first()
        gappy = [c for c in measured if facts[f"gaps_{c}"]]
        fill.update({c: facts[f"mean_{c}"] for c in gappy if present[c] == "mean"})
        medians = [c for c in gappy if present[c] == "median"]
        numbers = df.select(*[as_number(df, c).alias(c) for c in medians])
        found = column_quantiles(numbers, medians, [0.5], approx=approx, sizes={c: facts[f"size_{c}"] for c in medians})
        fill.update({c: (q[0] if q else None) for c, q in found.items()})
        fill.update(column_modes(df, [c for c in gappy if present[c] == "mode"]))
    for c, m in present.items():
        if m == "zero":
            fill[c] = 0
        elif m == "unknown" or (m == "mode" and c in fill and fill[c] is None):
            fill[c] = "Unknown"
        elif m.startswith("="):
            fill[c] = m[1:]
    return fill


def apply_fill(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    """Put replacement values into gaps; a value that does not fit the column's type fills nothing."""
    kinds = dict(df.dtypes)
    out = {}
    for c, value in fill.items():
        if c not in df.columns or value is None:
            continue
        if is_numeric(df, c) and isinstance(value, float) and kinds[c] not in ("double", "float"):
            replacement = F.lit(value)  # a mean or median of whole numbers widens the column
            out[c] = F.coalesce(F.col(c).cast("double"), replacement)
        else:
            # The replacement as text, so that a constant that does not parse gives null.
            replacement = F.lit(str(value)).try_cast(kinds[c]) if isinstance(value, str) else F.lit(value).cast(kinds[c])
            out[c] = F.coalesce(F.col(c), replacement)
    return df.withColumns(out) if out else df


def fill_missing(df: DataFrame, methods: Mapping[str, str], approx: bool = False) -> DataFrame:
    return apply_fill(df, fit_fill(df, methods, approx))


def fill_text_gaps(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    """Null or token cells of text columns become ``value``."""
    return df.withColumns({c: F.coalesce(blank_missing(c), F.lit(value)) for c in columns if c in df.columns})


def bulk_fill(df: DataFrame, how: str = "mean") -> DataFrame:
    """Every numeric column by mean, median or mode, every text column by Unknown."""
    methods = {c: how for c in numeric_columns(df)} | {c: "unknown" for c in text_columns(df)}
    return fill_missing(df, methods)


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (),
                 default=None, buckets: int | None = None) -> DataFrame:
    return fill_along(df, columns, order_by, partition_by, False, default, buckets)


def backward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (),
                  default=None, buckets: int | None = None) -> DataFrame:
    return fill_along(df, columns, order_by, partition_by, True, default, buckets)


def missing_report(df: DataFrame) -> DataFrame:
    """``column, missing, missing_pct`` for all columns from one aggregate."""
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(c)).alias(c) for c in names])
    long = wide.unpivot(["_rows"], names, "column", "missing")
    pct = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), F.lit(0.0))
    return long.select("column", "missing", pct.alias("missing_pct"))
