"""Column profiles in long form, quality scores, problem lists and suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions import cells
from tablecraft.operators import typing_ops
from tablecraft.operators.cell_counts import distinct_cells, top_cells
from tablecraft.operators.dedup import duplicate_count
from tablecraft.operators.lookup import beside
from tablecraft.operators.missing import column_modes
from tablecraft.operators.outliers import fit_bounds, outside
from tablecraft.operators.projection import as_number, is_numeric, numeric_columns, rows_of, text_columns
from tablecraft.operators.quantiles import column_quantiles
from tablecraft.operators.statistics import correlation_pairs, varies
from tablecraft.session import materialize

NUMERIC_TYPES = ("numeric", "currency", "percentage", "integer", "float")


def position(columns: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))


def adjusted_skew(v: Column) -> Column:
    n = F.count(v)
    return F.when((n > 2) & varies(v), F.skewness(v) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: all scalar aggregates of all columns come from one scan."""
    names = list(columns or numeric_columns(df))
    data = df.select(*[as_number(df, c, False).alias(c) for c in names])
    data = data.select(*[cells.finite_or_null(c).alias(c) for c in names])
    q = column_quantiles(data, names, [0.25, 0.5, 0.75])
    none = [None, None, None]

    def stats(c):
        v, (q1, med, q3) = F.col(c), q[c] or none
        return F.struct(
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.lit(med).cast("double").alias("median"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.when(F.min(v) == F.max(v), F.when(F.count(v) > 1, 0.0)).otherwise(F.stddev_samp(v)).alias("std"),
            F.when(F.min(v) == F.max(v), F.when(F.count(v) > 1, 0.0)).otherwise(F.var_samp(v)).alias("variance"),
            F.lit(q1).cast("double").alias("q1"),
            F.lit(q3).cast("double").alias("q3"),
            F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"),
            adjusted_skew(v).alias("skewness"),
            F.count_if(v == 0).alias("zero_count"),
            F.count_if(v < 0).alias("negative_count"),
            F.count_if(
                (v < F.lit(None if q1 is None else q1 - 1.5 * (q3 - q1)))
                | (v > F.lit(None if q1 is None else q3 + 1.5 * (q3 - q1)))
            ).alias("outlier_count"),
        ).alias(c)

    wide = data.agg(*[stats(c) for c in names])
    return rows_of(wide, names)


def type_label(df: DataFrame, name: str) -> str:
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "Integer"
    if is_numeric(df, name):
        return "Float"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return "Datetime"
    return "Boolean" if kind == "boolean" else "Text"


def metadata_profile(df: DataFrame) -> DataFrame:
    """Shape, type label, missing cells and numeric figures or the most frequent text of each column."""
    names = df.columns
    scalar = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    ).unpivot(["_rows"], names, "column", "missing")
    numbers = numeric_columns(df)
    levels = distinct_cells(df).groupBy("column").agg(F.count("cell").alias("unique"))
    tops = top_cells(df, [c for c in names if c not in numbers]).select("column", F.col("value").alias("top"))
    stats = numeric_stats(df, numbers).select("column", "mean", "median", "min", "max", "std") if numbers else None
    labels = F.create_map(*[F.lit(x) for c in names for x in (c, type_label(df, c))])
    out = scalar.select(
        "column",
        labels[F.col("column")].alias("type"),
        F.col("_rows").alias("rows"),
        "missing",
        F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), F.lit(0.0)).alias("missing_pct"),
    ).join(levels, "column", "left").join(tops, "column", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    return out.join(stats, "column", "left") if stats is not None else out


def full_profile(df: DataFrame) -> DataFrame:
    """Semantic type with number, date and yes/no figures of each column."""
    kinds = materialize(typing_ops.semantic_type(df))
    rows = df.agg(F.count(F.lit(1)).alias("r")).first()["r"]
    by_kind: dict[str, list[str]] = {}
    for r in kinds.collect():  # one row per column
        by_kind.setdefault(r["semantic_type"], []).append(r["column"])
    out = kinds.select(
        "column", "semantic_type", F.lit(rows).alias("rows"), (F.lit(rows) - F.col("filled")).alias("null_count"),
        F.col("distinct_count").alias("unique_count"),
    )
    numbers = by_kind.get("numeric", [])
    if numbers:
        stats = numeric_stats(df, numbers).drop("count")
        out = out.join(stats, "column", "left")
    dates, flags = by_kind.get("datetime", []), by_kind.get("boolean", [])

    def day(c):
        return F.coalesce(F.col(c).cast("string").try_cast("date"), cells.parse_date(c))

    def says(c, *words):
        return F.count_if(F.lower(cells.trim_ws(c)).isin(*words))

    spans = [F.struct(F.min(day(c)).alias("a"), F.max(day(c)).alias("b")).alias(c) for c in dates]
    tallies = [
        F.struct(says(c, "true", "1", "yes", "t").alias("true_count"), says(c, "false", "0", "no", "f").alias("false_count")).alias(c)
        for c in flags
    ]
    if spans or tallies:
        wide = materialize(df.agg(*spans, *tallies))
    if dates:
        out = out.join(rows_of(wide, dates).select(
            "column",
            F.date_format("a", "yyyy-MM-dd").alias("min_date"),
            F.date_format("b", "yyyy-MM-dd").alias("max_date"),
            F.datediff("b", "a").alias("range_days"),
        ), "column", "left")
    if flags:
        out = out.join(rows_of(wide, flags), "column", "left")
    return out


def top_categories(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """``column, value, count, percentage`` of the k most frequent cells of every text column."""
    names = list(columns or text_columns(df))
    return top_cells(df, names, k).select(
        "column", "rank", "value", F.col("n").alias("count"), (F.col("n") * 100.0 / F.col("total")).alias("percentage")
    )


def structure_issues(df: DataFrame) -> DataFrame:
    """``issue, column, count``: fully empty rows, empty columns, constant columns."""
    empty_row = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    rows = df.agg(
        F.count_if(empty_row).alias("empty_rows"),
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count(c).alias("n"), F.min(cells.text(c)).alias("lo"), F.max(cells.text(c)).alias("hi")).alias(f"c_{c}") for c in df.columns],
    )
    kinds = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c_{c}.n").alias("n"),
                 (F.col(f"c_{c}.lo") == F.col(f"c_{c}.hi")).alias("same"))
        for c in df.columns
    ])
    per = rows.select("rows", F.inline(kinds))
    empty = per.filter("n = 0").select(F.lit("empty_column").alias("issue"), "column", F.col("rows").alias("count"))
    constant = per.filter((F.col("rows") > 1) & ((F.col("n") == 0) | F.col("same"))).select(
        F.lit("constant_column").alias("issue"), "column", F.col("rows").alias("count")
    )
    whole = rows.select(F.lit("empty_rows").alias("issue"), F.lit("*").alias("column"), F.col("empty_rows").alias("count"))
    return whole.unionByName(empty).unionByName(constant)


def browser_profile(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Dominant type, spellings, white space and number figures; everything from one stored table of distinct cells.

    Numbers are the cells read as numbers weighted by their counts; quartiles are the elements at
    rank floor(n / 4) and floor(3 n / 4).
    """
    values = materialize(typing_ops.typed_cells(df), once=True)
    kinds = typing_ops.dominant_from_cells(values, overrides)
    present = values.filter("type is not null")
    outer = present.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("blanks"), F.col("n"))), F.lit(0)).alias("whitespace"))
    variants = (
        present.select("column", "trimmed", "caseless").distinct()
        .groupBy("column", "caseless").agg(F.count(F.lit(1)).alias("ways"))
        .groupBy("column").agg(F.count_if(F.col("ways") > 1).alias("casing_groups"))
    )
    stats = _weighted_numbers(present)
    p = kinds.join(outer, "column", "left").join(variants, "column", "left").join(stats, "column", "left")
    suspicious = F.coalesce(F.col("min") < 0, F.lit(False)) & F.col("column").rlike(typing_ops.NEGATIVE_SUSPECT_NAME)
    return p.withColumn("suspicious_negatives", suspicious).fillna(
        0, subset=["whitespace", "casing_groups", "numbers", "outliers"]
    )


def _weighted_numbers(present: DataFrame) -> DataFrame:
    from tablecraft.operators.ordering import running_sum

    numbers = materialize(
        present.filter("number is not null").groupBy("column", F.col("number").alias("v")).agg(F.sum("n").alias("n")), once=True)
    cum = running_sum(numbers, ["v"], F.col("n"), "hi", partition_by=["column"])
    x, n = F.col("v"), F.col("n")
    # The three lookups hold one row per column of the table, so they are broadcast.
    totals = numbers.groupBy("column").agg(
        F.sum("n").alias("numbers"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.sum(x * n) / F.sum("n")).alias("mean"),
    )
    with_total = cum.join(F.broadcast(totals.select("column", "numbers", "mean")), "column")

    def at(rank):
        return F.max(F.when((F.col("hi") > rank) & (F.col("hi") - n <= rank), x))

    half = F.floor(F.col("numbers") / 2)
    even = F.col("numbers") % 2 == 0
    ranks = materialize(with_total.groupBy("column").agg(
        at(F.floor(F.col("numbers") * 0.25)).alias("q1"),
        at(F.floor(F.col("numbers") * 0.75)).alias("q3"),
        at(half).alias("upper_mid"),
        at(F.when(even, half - 1).otherwise(half)).alias("lower_mid"),
        F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.sum(n)).alias("std_pop"),
    ))
    fenced = numbers.join(F.broadcast(ranks.select("column", "q1", "q3")), "column")
    span = (F.col("q3") - F.col("q1")) * 1.5
    beyond = fenced.groupBy("column").agg(
        F.coalesce(F.sum(F.when((x < F.col("q1") - span) | (x > F.col("q3") + span), n)), F.lit(0)).alias("outliers")
    )
    out = totals.join(F.broadcast(ranks), "column").join(F.broadcast(beyond), "column")
    return out.select(
        "column", "numbers", "min", "max", "mean", ((F.col("lower_mid") + F.col("upper_mid")) / 2).alias("median"),
        "std_pop", F.when(F.col("numbers") >= 4, F.col("outliers")).otherwise(0).alias("outliers"),
    ).filter("numbers >= 2")


def server_problems(df: DataFrame) -> DataFrame:
    """``type, column, severity, count`` found by the semantic profile."""
    profile = materialize(full_profile(df))
    dups = duplicate_count(df).select(
        F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"),
        F.lit("medium").alias("severity"), F.col("duplicates").alias("count"),
    )
    high = F.round(F.col("null_count") * 100.0 / F.col("rows"), 2) > 30
    missing = profile.filter(F.round(F.col("null_count") * 100.0 / F.col("rows"), 2) > 0).select(
        F.lit("missing_values").alias("type"), "column",
        F.when(high, "high").otherwise("medium").alias("severity"), F.col("null_count").alias("count"),
    )
    parts = [dups, missing]
    if "outlier_count" in profile.columns:
        parts.append(profile.select(F.lit("outliers").alias("type"), "column", F.lit("medium").alias("severity"),
                                    F.coalesce("outlier_count", F.lit(0)).alias("count")))
    worded = [r["column"] for r in profile.filter("semantic_type in ('categorical', 'text')").select("column").collect()]
    if worded:
        wide = df.agg(*[F.count_if(cells.text(c).rlike(cells.RX_WHITESPACE_ISSUE)).alias(c) for c in worded])
        parts.append(wide.unpivot([], worded, "column", "count").select(
            F.lit("whitespace").alias("type"), "column", F.lit("low").alias("severity"), "count"))
    return reduce(DataFrame.unionByName, parts).filter("count > 0")


def browser_problems(df: DataFrame) -> DataFrame:
    profile = materialize(browser_profile(df))
    return browser_problems_from(profile, df)


def browser_problems_from(profile: DataFrame, df: DataFrame) -> DataFrame:
    def found(kind, severity, count, when):
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.col("column"), severity.alias("severity"), count.cast("bigint").alias("count")))

    low, medium, high = F.lit("low"), F.lit("medium"), F.lit("high")
    c = F.col
    checks = F.array_compact(F.array(
        found("missing_values", F.when(c("nulls") > 0.3 * c("rows"), "high").otherwise("medium"), c("nulls"), c("nulls") > 0),
        found("whitespace", low, c("whitespace"), c("whitespace") > 0),
        found("currency_format", medium, c("n_currency"), (c("n_currency") > 0) & (c("dominant_type") != "text")),
        found("inconsistent_categories", medium, c("casing_groups"), c("casing_groups") > 0),
        found("outliers", low, c("outliers"), c("outliers") > 0),
        found("suspicious_value", high, F.lit(1), c("suspicious_negatives")),
        found("empty_column", high, c("rows"), c("nulls") == c("rows")),
    ))
    per_column = profile.select(F.inline(checks))
    dups = duplicate_count(df, normalize="trim").filter("duplicates > 0").select(
        F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"), F.lit("high").alias("severity"),
        F.col("duplicates").alias("count"),
    )
    return per_column.unionByName(dups)


def quality_score(df: DataFrame, formula: str = "server") -> DataFrame:
    """Score from 0 to 100 with its ingredients; formulas server and browser."""
    width = len(df.columns)
    if formula == "server":
        problems = server_problems(df).agg(F.count(F.lit(1)).alias("problems"))
        nulls = df.agg(
            F.count(F.lit(1)).alias("rows"),
            sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("nulls"),
        )
        facts = beside(nulls, duplicate_count(df).select("duplicates"), problems)
        null_pct = F.round(F.col("nulls") * 100.0 / (F.col("rows") * width), 2)
        score = (
            100 - F.least(F.lit(40.0), null_pct * 1.5)
            - F.least(F.lit(25.0), F.col("duplicates") / F.greatest(F.col("rows"), F.lit(1)) * 50)
            - F.least(F.lit(15.0), F.col("problems") * 2.0)
        )
        return facts.select("rows", "nulls", "duplicates", "problems",
                            F.greatest(F.lit(5), F.bround(score).cast("int")).alias("score"))
    profile = materialize(browser_profile(df))
    sums = profile.agg(
        F.max("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("whitespace").alias("whitespace"),
        F.count_if("is_mixed").alias("mixed"), F.sum("outliers").alias("outliers"),
    )
    facts = beside(sums, duplicate_count(df, normalize="trim").select("duplicates"))
    table_cells = F.col("rows") * width
    score = (
        100 - F.least(F.lit(30.0), F.col("nulls") / table_cells * 80)
        - F.least(F.lit(25.0), F.col("duplicates") / F.col("rows") * 60)
        - F.least(F.lit(15.0), F.col("mixed") * 5.0)
        - F.least(F.lit(10.0), F.col("whitespace") / table_cells * 40)
        - F.least(F.lit(10.0), F.col("outliers").cast("double"))
    )
    return facts.select("rows", "nulls", "duplicates", "mixed", "whitespace", "outliers",
                        F.greatest(F.lit(10), F.least(F.lit(100), F.round(score).cast("int"))).alias("score"))


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers with mode and range for numeric columns, count, levels and mode for the others."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    numbers = [c for c in names if is_numeric(df, c)]
    others = [c for c in names if c not in numbers]
    modes = column_modes(df, names)
    mode_of = F.create_map(*[F.lit(x) for c in names for x in (c, None if modes[c] is None else str(modes[c]))])
    parts = []
    if numbers:
        parts.append(numeric_stats(df, numbers).select(
            "column", F.lit("numeric").alias("type"), "count", "mean", "median", "min", "max",
            (F.col("max") - F.col("min")).alias("range"), "variance", "std", "q1", "q3", "iqr", "skewness",
            F.lit(None).cast("bigint").alias("unique_count"),
            F.lit(None).cast("string").alias("mode_text"),
            mode_of[F.col("column")].try_cast("double").alias("mode_number"),
        ))
    if others:
        values = distinct_cells(df, others).filter("cell is not null")
        parts.append(values.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_count")).select(
            "column", F.lit("categorical").alias("type"), "count", "unique_count", mode_of[F.col("column")].alias("mode_text"),
        ))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shannon entropy in bits per text column; more than 2.5 bits counts as diverse."""
    values = distinct_cells(df, columns or text_columns(df)).filter("cell is not null")
    n = F.col("n").cast("double")
    # -sum(p log p) = log N - sum(n log n) / N needs no second pass for the total.
    out = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("levels"), (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("bits")
    )
    return out.withColumn(
        "balance",
        F.when(F.col("bits") > 2.5, "Uniform / High Diversity").otherwise("Imbalanced / Low Diversity"),
    )


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis with a shape flag, for more than three values."""
    names = list(columns or numeric_columns(df))
    wide = df.agg(*[
        F.struct(
            F.count(as_number(df, c)).alias("n"),
            F.when(varies(as_number(df, c)), F.skewness(as_number(df, c))).alias("skewness"),
            F.when(varies(as_number(df, c)), F.kurtosis(as_number(df, c))).alias("kurtosis"),
        ).alias(c)
        for c in names
    ])
    long = rows_of(wide, names).filter("n > 3")
    flag = (
        F.when((F.abs("skewness") < 0.5) & (F.abs("kurtosis") < 1), "Gaussian-like")
        .when(F.col("skewness") > 0.5, "Right-Skewed")
        .otherwise("Left-Skewed")
    )
    return long.withColumn("shape", flag)


def multicollinearity(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.85) -> DataFrame:
    return correlation_pairs(df, columns).filter(F.abs("r") > limit).select("a", "b", F.abs("r").alias("correlation"))


def smart_analytics(df: DataFrame) -> DataFrame:
    """``type, subject, value, detail``: strong pairs, outlier columns, dominant categories, copies."""
    profile = materialize(browser_profile(df))
    numbers = [r["column"] for r in profile.filter(
        F.col("dominant_type").isin(*NUMERIC_TYPES) & F.col("min").isNotNull()).orderBy(position(df.columns)).collect()]
    parts = []
    if len(numbers) >= 2:
        parsed = df.select(*[as_number(df, c).alias(c) for c in numbers])
        pairs = correlation_pairs(parsed, numbers, min_n=3).withColumn("r", F.round("r", 2))
        parts.append(pairs.filter(F.abs("r") >= 0.6).select(
            F.lit("correlation").alias("type"), F.concat_ws("__", "a", "b").alias("subject"), F.col("r").alias("value"),
            F.when(F.col("r") > 0, "strong positive").otherwise("strong inverse").alias("detail")))
    parts.append(profile.filter((F.col("outliers") > 0) & F.col("column").isin(*numbers)).select(
        F.lit("outliers").alias("type"), F.col("column").alias("subject"), F.col("outliers").cast("double").alias("value"),
        F.lit("outside IQR bounds").alias("detail")))
    worded = [r["column"] for r in profile.filter("dominant_type in ('categorical', 'binary')").collect()]
    if worded:
        tops = top_cells(df, worded, 1, lambda value: F.when(value != "", cells.trim_ws(value)))
        rows = profile.select("column", "rows")
        pct = F.round(F.col("n") * 100.0 / F.col("rows"))
        parts.append(tops.join(rows, "column").filter(pct >= 50).select(
            F.lit("distribution").alias("type"), F.col("column").alias("subject"), pct.alias("value"),
            F.col("value").alias("detail")))
    parts.append(duplicate_count(df, normalize="trim").filter("duplicates > 0").select(
        F.lit("duplicates").alias("type"), F.lit("*").alias("subject"), F.col("duplicates").cast("double").alias("value"),
        F.lit("duplicate rows").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def column_facts(df: DataFrame, readable: bool = False) -> DataFrame:
    """Per column: rows, missing, distinct, storage family, share of cells that read as dates, binary flag.

    ``readable`` adds ``all_numbers``: whether every cell that is there reads as a number.
    """
    as_double = F.col("value").try_cast("double")
    values = distinct_cells(df, valid_date=cells.is_valid_date("value"), zero_one=as_double.isin(0.0, 1.0), readable=as_double.isNotNull())
    numbers = numeric_columns(df)
    stored_dates = [c for c, k in df.dtypes if k in ("date", "timestamp", "timestamp_ntz")]
    present = F.col("cell").isNotNull()
    facts = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("cell").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("valid_date"), F.col("n"))), F.lit(0)).alias("dates"),
        F.coalesce(F.bool_and(F.when(present, F.col("zero_one"))), F.lit(True)).alias("zero_one"),
        F.coalesce(F.bool_and(F.when(present, F.col("readable"))), F.lit(True)).alias("all_numbers"),
    )
    family = (
        F.when(F.col("column").isin(*numbers), "number")
        .when(F.col("column").isin(*stored_dates) | (F.col("dates") > 0.7 * F.col("rows")), "date")
        .otherwise("text")
    )
    binary = (family == "number") & (F.col("distinct_count") <= 2) & F.coalesce("zero_one", F.lit(False))
    return facts.select("column", position(df.columns).alias("position"), "rows", "missing", "distinct_count",
                        family.alias("family"), binary.alias("is_binary"), *(["all_numbers"] if readable else []))


def suggest_axes(df: DataFrame) -> DataFrame:
    """``column, axis, score, kind``: x and y candidates; axis null marks an excluded column."""
    return axes_from_facts(column_facts(df))


def axes_from_facts(facts: DataFrame) -> DataFrame:
    missing_pct = F.round(F.col("missing") * 100.0 / F.greatest(F.col("rows"), F.lit(1)), 1)
    number, date = F.col("family") == "number", F.col("family") == "date"
    n = F.col("distinct_count")
    kind = (
        F.when(missing_pct > 50, "too many missing")
        .when(~number & (n == F.col("rows")), "unique id")
        .when(F.col("is_binary"), "Boolean-like")
        .when(number, "Numeric")
        .when(date, "DateTime")
        .when(n <= 30, "Categorical")
        .when(n <= 0.8 * F.col("rows"), "Text")
        .otherwise("too many values")
    )
    axis = F.when(F.col("kind") == "Numeric", "y").when(
        F.col("kind").isin("Boolean-like", "DateTime", "Categorical", "Text"), "x")
    score = (
        F.when(F.col("kind") == "Boolean-like", F.lit(30))
        .when(F.col("kind") == "Numeric", F.when(n > 10, 90).otherwise(70))
        .when(F.col("kind") == "DateTime", 100)
        .when(F.col("kind") == "Categorical", 85 - n)
        .when(F.col("kind") == "Text", 40)
    )
    return facts.withColumn("kind", kind).select(
        "column", "position", axis.alias("axis"), score.cast("int").alias("score"), "kind", n.alias("distinct_count"))


def suggest_chart(axes: DataFrame) -> DataFrame:
    """One row: top x and y, chart type and whether a forecast is possible."""
    best = F.struct("score", (-F.col("position")).alias("p"))
    one = axes.agg(
        F.max_by(F.when(F.col("axis") == "x", F.col("column")), F.when(F.col("axis") == "x", best)).alias("top_x"),
        F.max_by(F.col("distinct_count"), F.when(F.col("axis") == "x", best)).alias("_nx"),
        F.max_by(F.when(F.col("axis") == "y", F.col("column")), F.when(F.col("axis") == "y", best)).alias("top_y"),
        F.count_if(F.col("axis") == "x").alias("x_count"),
        F.count_if(F.col("axis") == "y").alias("y_count"),
        F.coalesce(F.bool_or(F.col("kind") == "DateTime"), F.lit(False)).alias("has_date"),
    )
    y, x = F.col("y_count"), F.col("x_count")
    chart = (
        F.when(F.col("has_date") & (y >= 1), "line")
        .when((y >= 2) & (x >= 1), "bar")
        .when((y == 1) & (x >= 1), F.when(F.col("_nx") <= 8, "pie").otherwise("bar"))
        .otherwise("bar")
    )
    return one.select("top_x", "top_y", chart.alias("chart"), (F.col("has_date") & (y >= 1)).alias("forecast_eligible"))


def target_suggestions(df: DataFrame) -> DataFrame:
    """Columns that could be a prediction target: few-class text, or mostly numeric."""
    values = distinct_cells(df, readable=F.col("value").try_cast("double").isNotNull())
    texts = text_columns(df)
    facts = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("cell").alias("classes"),
        F.coalesce(F.sum(F.when(F.col("readable"), F.col("n"))), F.lit(0)).alias("numbers"),
    )
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    reason = F.when(is_text & F.col("classes").between(2, 20), "classification").when(
        ~is_text & (F.col("numbers") > 0.5 * F.col("rows")), "regression or classification")
    return facts.select("column", position(df.columns).alias("position"), reason.alias("reason"), "classes").filter(
        "reason is not null").orderBy("position")


def cleaning_plan(df: DataFrame) -> DataFrame:
    """``step, action, column, detail``: ordered suggestions that a recipe can run."""
    return plan_from_profile(materialize(browser_profile(df)), df)


def plan_from_profile(profile: DataFrame, df: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("string")
    dup = duplicate_count(df, normalize="trim").filter("duplicates > 0").select(
        F.lit(1).alias("stage"), F.lit(0).alias("position"), F.lit("drop_duplicates").alias("action"),
        empty.alias("column"), empty.alias("detail"))
    trim = profile.agg(F.sum("whitespace").alias("w")).filter("w > 0").select(
        F.lit(0).alias("stage"), F.lit(0).alias("position"), F.lit("trim").alias("action"), empty.alias("column"),
        empty.alias("detail"))
    c = F.col
    numeric = c("dominant_type").isin(*NUMERIC_TYPES)

    def step(order, action, detail, when):
        return F.when(when, F.struct(F.lit(order).alias("o"), F.lit(action).alias("action"), detail.alias("detail")))

    steps = F.array_compact(F.array(
        step(2, "to_numeric", empty, c("n_currency") > 0),
        step(3, "normalize_categories", empty, c("casing_groups") > 0),
        step(4, "impute", F.when(numeric, "median").otherwise("mode"), c("nulls") > 0),
        step(5, "iso_dates", empty, c("dominant_type") == "date"),
    ))
    per = profile.select("column", position(df.columns).cast("int").alias("position"), F.inline(steps)).select(
        F.lit(2).alias("stage"), (F.col("position") * 10 + F.col("o")).alias("position"), "action", "column", "detail")
    every = trim.unionByName(dup).unionByName(per)
    # A handful of rows per column of the table.
    return every.withColumn("step", F.row_number().over(Window.orderBy("stage", "position"))).select(
        "step", "action", "column", "detail")


def dataset_analysis(df: DataFrame) -> DataFrame:
    """Shape, family, missing share and number figures of each column."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    base = rows.unpivot(["_rows"], df.columns, "column", "missing")
    numbers = numeric_columns(df)
    family = F.when(F.col("column").isin(*numbers), "numeric").otherwise("categorical") if numbers else F.lit("categorical")
    out = base.select("column", F.col("_rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                      family.alias("family"), "missing", (F.col("missing") * 100.0 / F.col("_rows")).alias("missing_pct"))
    if numbers:
        out = out.join(numeric_stats(df, numbers).select("column", "mean", "std", "min", "max", "median"), "column", "left")
    return out


def dataset_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, column, before, after`` of every changed cell of rows present on both sides."""
    shared = [c for c in before.columns if c in after.columns and c != key]
    a = before.select(F.col(key), *[cells.text(c).alias(f"a_{c}") for c in shared])
    b = after.select(F.col(key), *[cells.text(c).alias(f"b_{c}") for c in shared])
    changes = F.filter(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after"))
            for c in shared
        ]),
        lambda e: ~e["before"].eqNullSafe(e["after"]),
    )
    return a.join(b, key).select(key, F.inline(changes))


def diff_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows on both sides, removed rows, changed rows and cells, gaps that were filled."""
    cells_changed = dataset_diff(before, after, key)
    was_gap = F.col("before").isNull() | F.lower("before").isin("", "null")
    inner = cells_changed.agg(
        F.count(F.lit(1)).alias("cells_changed"), F.count_distinct(key).alias("rows_changed"),
        F.count_if(was_gap & F.col("after").isNotNull()).alias("nulls_handled"))
    sizes = beside(before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows_after")))
    return beside(inner, sizes).withColumn(
        "rows_removed", F.greatest(F.lit(0), F.col("rows_before") - F.col("rows_after")))


def version_diff(before: DataFrame, after: DataFrame, version: int = 1) -> DataFrame:
    """Added and removed rows and columns between two versions of a table."""
    added = sorted(set(after.columns) - set(before.columns))
    removed = sorted(set(before.columns) - set(after.columns))
    sizes = beside(before.agg(F.count(F.lit(1)).alias("prev_rows")), after.agg(F.count(F.lit(1)).alias("new_rows")))
    update = (F.col("prev_rows") != F.col("new_rows")) | F.lit(bool(added or removed))
    return sizes.select(
        "prev_rows", "new_rows",
        F.greatest(F.lit(0), F.col("new_rows") - F.col("prev_rows")).alias("added_rows"),
        F.greatest(F.lit(0), F.col("prev_rows") - F.col("new_rows")).alias("removed_rows"),
        F.lit(",".join(added)).alias("new_columns"), F.lit(",".join(removed)).alias("removed_columns"),
        update.alias("is_update"), F.when(update, version + 1).otherwise(version).alias("version"))


