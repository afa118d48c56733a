"""Type inference by votes over all cells, and casting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions import cells
from tablecraft.operators.cell_counts import digest, distinct_cells
from tablecraft.operators.projection import rows_of

VALUE_TYPES = (
    "integer", "float", "currency", "percentage", "date", "boolean", "email", "url", "phone", "string", "null",
)
# Names that decide a column's role. -----------------------------------------------
ID_NAMES = ("id", "identifier", "uuid", "guid", "code")
ID_SUFFIX = "_id"
DATE_WORDS = ("date", "time", "created", "timestamp", "year", "month")
PROFILE_ID_NAME = r"(?i)(id|key|code|uuid|number|no)$"
NEGATIVE_SUSPECT_NAME = r"(?i)(age|salary|price|revenue|cost|quantity|sales|units|count|score)"
# -----------------------------------------------------------------------------------------------


def long_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value``: every cell as text.

    ``inline`` rather than ``unpivot``: an Expand fused with long expressions over its output is
    refused by Spark's code generator and would run interpreted.
    """
    names = list(columns or df.columns)
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), cells.text(c).alias("value")) for c in names
    ])))


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct cells of each column as text with their counts, for steps that return all of these texts."""
    return long_cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def type_votes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: cells of each value type and distinct caseless values."""
    kinds = distinct_cells(
        df, columns, cell=digest(F.lower(cells.trim_ws("value"))), type=cells.infer_value_type("value"))
    votes = kinds.groupBy("column").agg(
        *[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}") for t in VALUE_TYPES]
    )
    distinct = kinds.filter("type <> 'null'").select("column", "cell").distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_count"))
    # Columns of the input table bound both sides: one row per column name.
    return votes.join(distinct, "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def tell_column_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Primary type, category and confidence of each column from the share of each cell type."""
    v = type_votes(df, columns)
    filled = F.col("n_non_null")
    numeric = F.col("n_integer") + F.col("n_float") + F.col("n_currency") + F.col("n_percentage")

    def share(name):
        return F.col(f"n_{name}") / filled

    def pct(c):
        return F.round(c * 100).cast("int")

    v = v.withColumn("n_non_null", sum((F.col(f"n_{t}") for t in VALUE_TYPES[:-1]), F.lit(0)))
    v = v.withColumn("numeric_pct", pct(F.try_divide(numeric, filled)))
    v = v.withColumn(
        "base",
        F.when(filled == 0, "empty")
        .when(
            F.col("numeric_pct") >= 60,
            F.when(
                (F.col("n_currency") > F.col("n_integer")) & (F.col("n_currency") > F.col("n_float")), "currency"
            )
            .when(
                (F.col("n_percentage") > F.col("n_integer")) & (F.col("n_percentage") > F.col("n_float")), "percentage"
            )
            .when(F.col("n_integer") >= F.col("n_float"), "integer")
            .otherwise("float"),
        )
        .when(share("date") >= 0.6, "date")
        .when(share("boolean") >= 0.7, "boolean")
        .when(share("email") >= 0.5, "email")
        .when(share("url") >= 0.5, "url")
        .when(share("phone") >= 0.5, "phone")
        .when((F.col("distinct_count") == 2) & (filled >= 2), "binary")
        .when((F.col("distinct_count") <= 15) & (F.col("distinct_count") < filled * 0.5), "categorical")
        .otherwise("string"),
    )
    v = v.withColumn("unique_ratio", F.coalesce(pct(F.try_divide(F.col("distinct_count"), filled)), F.lit(0)))
    is_id = (F.col("unique_ratio") > 95) & (filled > 10) & F.col("base").isin("string", "integer")
    v = v.withColumn("primary_type", F.when(is_id, "id").otherwise(F.col("base")))
    kind = F.col("primary_type")
    category = (
        F.when(kind.isin("integer", "float", "currency", "percentage"), "numeric")
        .when(kind.isin("email", "phone"), "contact")
        .when(kind == "url", "web")
        .when(kind == "categorical", "category")
        .when(kind == "string", "text")
        .otherwise(kind)
    )
    confidence = (
        F.when(kind == "empty", 100)
        .when(kind == "id", 92)
        .when(kind == "binary", 95)
        .when(kind == "categorical", 90)
        .when(kind.isin("integer", "float", "currency", "percentage"), F.col("numeric_pct"))
    )
    for t in ("date", "boolean", "email", "url", "phone", "string"):
        confidence = confidence.when(kind == t, pct(F.try_divide(F.col(f"n_{t}"), filled)))
    return v.select(
        "column", "primary_type", category.alias("category"), confidence.alias("confidence"),
        "distinct_count", "unique_ratio", *[f"n_{t}" for t in VALUE_TYPES],
    )


def semantic_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """id_like, boolean, numeric, datetime, categorical or text, decided over all rows."""
    values = distinct_cells(
        df, columns,
        not_boolean=~F.lower(cells.trim_ws("value")).isin(*cells.BOOLEAN_SET),
        number=cells.to_numeric_strip("value").isNotNull(),
        not_date=F.col("value").isNotNull() & cells.parse_date("value").isNull(),
    )

    def cells_with(fact):
        return F.coalesce(F.sum(F.when(fact, F.col("n"))), F.lit(0))

    filled = values.groupBy("column").agg(
        cells_with(F.col("cell").isNotNull()).alias("filled"), F.count("cell").alias("distinct_count"),
        cells_with(F.col("not_boolean")).alias("not_boolean"), cells_with(F.col("number")).alias("numbers"),
        cells_with(F.col("not_date")).alias("not_dates"),
    )
    name = F.lower("column")
    has_date_word = name.rlike("|".join(DATE_WORDS))
    kind = (
        F.when(F.col("filled") == 0, "text")
        .when(name.isin(*ID_NAMES) | name.endswith(ID_SUFFIX), "id_like")
        .when(F.col("not_boolean") == 0, "boolean")
        .when(F.col("numbers") >= 0.8 * F.col("filled"), "numeric")
        .when(has_date_word & (F.col("not_dates") == 0), "datetime")
        .when((F.col("distinct_count") < 0.25 * F.col("filled")) | (F.col("distinct_count") <= 20), "categorical")
        .otherwise("text")
    )
    return filled.select("column", kind.alias("semantic_type"), "filled", "distinct_count")


def dominant_type(df: DataFrame, overrides: Mapping[str, str] | None = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Profiler's view of each column: dominant type, currency and percent cells, mixed flag."""
    return dominant_from_cells(typed_cells(df, columns), overrides)


def typed_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct cells with what the profiler asks: value type, digests of the trimmed and of the caseless cell, outer
    blanks, and the number of a cell that reads as one. ``type`` is null for null and empty cells."""
    filled, trimmed = F.col("value").isNotNull() & (F.col("value") != ""), cells.trim_ws("value")
    kind = F.when(filled, cells.infer_value_type("value"))
    numeric = cells.infer_value_type("value").isin("integer", "float", "currency", "percentage")
    return distinct_cells(
        df, columns, type=kind, trimmed=digest(trimmed), caseless=digest(F.lower(trimmed)), blanks=trimmed != F.col("value"),
        number=F.when(filled & numeric, cells.parse_numeric("value")))


def dominant_from_cells(values: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """As ``dominant_type``, from stored ``typed_cells``. Only null and empty cells count as missing."""
    kinds = values.filter("type is not null")

    def votes(*names):
        return F.coalesce(F.sum(F.when(F.col("type").isin(*names), F.col("n"))), F.lit(0))

    base = kinds.groupBy("column").agg(
        F.sum("n").alias("filled"),
        votes("integer", "float").alias("n_numeric"),
        votes("currency").alias("n_currency"),
        votes("percentage").alias("n_percentage"),
        votes("date").alias("n_date"),
        votes("boolean").alias("n_boolean"),
        votes("email", "url", "phone", "string", "null").alias("n_string"),
    )
    distinct = (
        kinds.select("column", "trimmed").distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    )
    rows = values.groupBy("column").agg(F.sum("n").alias("rows"))
    t = rows.join(base, "column", "left").join(distinct, "column", "left").fillna(0)
    n = F.col("filled")
    numeric = F.col("n_numeric") + F.col("n_currency") + F.col("n_percentage")
    is_numeric = (n > 0) & (numeric >= 0.7 * n)
    is_date = (n > 0) & ~is_numeric & (F.col("n_date") >= 0.7 * n)
    limit = F.least(F.lit(25), F.greatest(F.lit(2), F.floor(n * 0.25)))
    kind = (
        F.when(n == 0, "text")
        .when(
            is_numeric,
            F.when(F.col("n_percentage") > 0, "percentage").when(F.col("n_currency") > 0, "currency").otherwise("numeric"),
        )
        .when(is_date, "date")
        .when(F.col("n_boolean") >= 0.7 * n, "boolean")
        .when(F.col("distinct_count") == 2, "binary")
        .when(F.col("distinct_count") <= limit, "categorical")
        .otherwise("text")
    )
    is_id = (F.col("distinct_count") > 10) & (F.col("distinct_count") == n) & F.col("column").rlike(PROFILE_ID_NAME)
    kind = F.when(is_id, "id").otherwise(kind)
    for name, forced in (overrides or {}).items():
        kind = F.when(F.col("column") == name, forced).otherwise(kind)
    mixed = (
        is_numeric & ((F.col("n_string") > 0) | ((F.col("n_currency") > 0) & (F.col("n_numeric") > 0)))
    ) | (is_date & ((F.col("n_string") > 0) | (F.col("n_numeric") > 0)))
    return t.select(
        "column", kind.alias("dominant_type"), "rows", (F.col("rows") - n).alias("nulls"), "distinct_count",
        "n_currency", "n_percentage", mixed.alias("is_mixed"),
    )


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Integer, Float, Datetime or Text; cells that do not fit become null."""
    def to(c, kind):
        kind = kind.lower()
        if kind == "integer":
            return F.round(cells.parse_numeric(c, False)).cast("bigint")
        if kind == "float":
            return cells.parse_numeric(c, False)
        if kind == "datetime":
            return F.coalesce(cells.text(c).try_cast("timestamp"), cells.parse_date(c).cast("timestamp"))
        return cells.text(c)

    return df.withColumns({c: to(c, kind) for c, kind in types.items() if c in df.columns})


def cast_value_columns(df: DataFrame, types: Mapping[str, str], count_failures: bool = False) -> DataFrame:
    """Named target types per column; ``count_failures`` returns ``column, converted, cast_failed`` instead."""
    present = {c: t for c, t in types.items() if c in df.columns}
    if not count_failures:
        return df.withColumns({c: cells.cast_value(c, t) for c, t in present.items()})
    done = df.agg(*[
        F.struct(
            F.count(cells.cast_value(c, t)).alias("converted"),
            F.count_if(cells.cast_value(c, t).isNull() & ~cells.is_missing(c)).alias("cast_failed"),
        ).alias(c)
        for c, t in present.items()
    ])
    return rows_of(done, list(present))


def clean_numeric_column(df: DataFrame, column: str) -> DataFrame:
    """Text numbers become doubles in place."""
    return df.withColumn(column, cells.parse_numeric(column))
