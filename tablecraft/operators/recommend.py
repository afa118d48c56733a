"""Chart recommendations: columns get roles, roles give picks, a table of rules turns picks into charts.

All of it is expressions over one small row for each column and one row of picks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.operators.corpus import classify_domain
from tablecraft.operators.lookup import beside
from tablecraft.operators.profile import NUMERIC_TYPES, column_facts, position
from tablecraft.operators.taxonomies import PRIMARY_DIMENSIONS, PRIMARY_METRICS
from tablecraft.operators.typing_ops import dominant_type
from tablecraft.session import materialize

# Words that mark a time column, and words that unmark it. ---------------------------
TIME_WORDS = ("date", "launch", "timestamp", "month", "quarter")
NOT_YEAR_WORDS = ("resale", "price", "value", "rate", "cost")
GALLERY_TIME = r"(?i)date|time|year|month|period|day|epoch|session|semester|survival"
# ---------------------------------------------------------------------------------------------------

# Rules: rank, id, chart, x, y, aggregation, group_by, condition. Names are picks, see ``recommend_charts``.
STRATEGIC = (
    (1, "rec_trend", "line", "x", "y", "if(lower(y) rlike 'price|rate', 'avg', 'sum')", "coalesce(grouping, '')", "x_role = 'time'"),
    (1, "rec_bar", "bar", "x", "y", "if(lower(y) rlike 'rate', 'avg', 'sum')", "coalesce(grouping, '')", "x_role <> 'time'"),
    (2, "rec_donut", "doughnut", "coalesce(grouping, other, x)", "y", "'sum'", "''", "true"),
    (3, "rec_scatter", "scatter", "y", "second", "'none'", "coalesce(grouping, '')", "second is not null"),
    (3, "rec_horiz", "horizontalBar", "x", "y", "'avg'", "''", "second is null"),
)
# Rules: order, chart, x, y, condition.
SUGGESTED = (
    (1, "line", "dated", "number", "dated is not null and number is not null"),
    (2, "forecast", "dated", "number", "dated is not null and number is not null"),
    (3, "bar", "word", "number", "word is not null and number is not null"),
    (4, "pie", "word", "number", "word is not null"),
    (5, "trend_scatter", "number", "number2", "number2 is not null"),
    (6, "correlation_heatmap", "null", "null", "number2 is not null"),
    (7, "histogram", "number", "null", "number is not null"),
    (8, "box", "word", "number", "number is not null"),
)
GALLERY = (
    (1, "forecast", "coalesce(moment, label)", "measure", "number is not null"),
    (2, "bar", "label", "measure", "number is not null and free is not null"),
    (3, "line", "coalesce(moment, label)", "measure", "true"),
    (4, "area", "label", "measure", "number is not null"),
    (5, "donut", "label", "measure", "free is not null"),
    (6, "trend_scatter", "measure", "number2", "number2 is not null"),
    (7, "boxplot", "label", "measure", "number is not null"),
    (8, "heatmap", "null", "null", "number2 is not null"),
    (9, "histogram", "measure", "null", "number is not null"),
)


def schema_domain(df: DataFrame, table_name: str = "") -> str:
    """Domain of a table from its name and column names."""
    words = " ".join([table_name, table_name, *df.columns]).replace("_", " ").replace("-", " ")
    one = df.sparkSession.createDataFrame([(1, words)], "id int, words string")
    return classify_domain(one, "words", "id").first()["domain"]


def _place(words: Sequence[str], name: Column) -> Column:
    """Place of the first of the words that the name holds; past the last where it holds none."""
    hits = [F.when(name.contains(w), i) for i, w in enumerate(words)]
    return F.coalesce(*hits, F.lit(len(words)))


def _pick(condition: Column, *order: Column) -> Column:
    """The column that meets the condition and is first in the order, then by position."""
    return F.min_by("column", F.when(condition, F.struct(*[o.alias(f"o{i}") for i, o in enumerate((*order, F.col("position")))])))


def _apply(picks: DataFrame, rules: Sequence[tuple], names: Sequence[str], literal: Sequence[int]) -> DataFrame:
    """A row for each rule whose condition, its last entry, holds; the entries numbered in ``literal`` are plain values."""
    rows = [
        F.when(F.expr(rule[-1]), F.struct(*[
            (F.lit(e) if i in literal else F.expr(e).cast("string")).alias(n) for i, (e, n) in enumerate(zip(rule, names))]))
        for rule in rules
    ]
    return picks.select(F.inline(F.array_compact(F.array(*rows))))


def recommend_charts(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Three chart setups from names, storage types and cardinalities.

    Roles: time by name; category for text of at most 40 values and numbers of at most 8 that are no ids; measure for
    other numbers. Without measures, columns whose cells all read as numbers are measures; without categories, all that
    are no measures are. Picks: y, the measure the domain prefers; x, a time or the category the domain prefers;
    grouping, another category of 2 to 8 values; other, the second category; second, another measure.
    """
    domain = domain or schema_domain(df)
    c, name = F.col, F.lower("column")
    timed = name.rlike("|".join(TIME_WORDS)) | (name.contains("year") & ~name.rlike("|".join(NOT_YEAR_WORDS)))
    few = (c("distinct_count") <= 8) & ~name.contains("id")
    role = (
        F.when(timed, "time").when(c("family") == "number", F.when(few, "category").otherwise("measure"))
        .when(c("distinct_count") <= 40, "category").otherwise("none")
    )
    facts = column_facts(df, readable=True).withColumn("role", role)
    facts = beside(facts, facts.agg(F.bool_or(c("role") == "measure").alias("measured"), F.bool_or(c("role") == "category").alias("sorted")))
    facts = facts.withColumn("measure", (c("role") == "measure") | ~c("measured") & c("all_numbers"))
    facts = facts.withColumn("category", F.when(c("sorted"), c("role") == "category").otherwise(~c("measure")))
    dimension = _place(PRIMARY_DIMENSIONS.get(domain, ()), name)
    axes = facts.agg(
        _pick(c("measure"), _place(PRIMARY_METRICS.get(domain, ()), name)).alias("y"),
        F.coalesce(_pick(c("role") == "time"), _pick(c("category"), dimension), _pick(F.lit(True))).alias("x"),
        _pick(c("category")).alias("leading"))
    ready = beside(facts, axes)
    picks = ready.agg(
        F.first("y").alias("y"), F.first("x").alias("x"), F.max_by("role", c("column") == c("x")).alias("x_role"),
        _pick(c("category") & (c("column") != c("x")) & c("distinct_count").between(2, 8)).alias("grouping"),
        _pick(c("category") & (c("column") != c("leading"))).alias("other"),
        _pick(c("measure") & ~c("column").eqNullSafe(c("y"))).alias("second"))
    return _apply(picks, STRATEGIC, ("rank", "id", "chart", "x", "y", "aggregation", "group_by"), (0, 1, 2))


def _numbered(charts: DataFrame) -> DataFrame:
    """Rank by the order of the rules; at most as many rows as rules."""
    return charts.select(F.row_number().over(Window.orderBy("order")).alias("rank"), "chart", "x", "y")


def _kinds(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("dominant_type").isin(*NUMERIC_TYPES), "number").when(F.col("dominant_type") == "date", "date").otherwise("word")
    kinds = dominant_type(df).select("column", position(df.columns).alias("position"), kind.alias("kind"))
    return materialize(kinds, once=True)  # a row for each column, asked for several times


def _number_picks(kinds: DataFrame) -> DataFrame:
    first = beside(kinds, kinds.agg(_pick(F.col("kind") == "number").alias("number")))
    return first.agg(F.first("number").alias("number"), _pick((F.col("kind") == "number") & (F.col("column") != F.col("number"))).alias("number2"))


def suggest_charts(df: DataFrame) -> DataFrame:
    """Charts that the available column families allow."""
    kinds = _kinds(df)
    picks = beside(_number_picks(kinds), kinds.agg(
        _pick(F.col("kind") == "date").alias("dated"), _pick(F.col("kind") == "word").alias("word")))
    return _numbered(_apply(picks, SUGGESTED, ("order", "chart", "x", "y"), (0, 1)))


def chart_gallery(df: DataFrame) -> DataFrame:
    """The full gallery with axes; the time axis also follows from the column name."""
    kinds = _kinds(df)
    c = F.col
    moments = kinds.agg(F.coalesce(_pick(c("kind") == "date"), _pick(c("column").rlike(GALLERY_TIME))).alias("moment"))
    rest = beside(kinds, moments).agg(
        F.first("moment").alias("moment"),
        _pick((c("kind") != "number") & ~c("column").eqNullSafe(c("moment"))).alias("free"))
    columns = df.columns
    picks = beside(_number_picks(kinds), rest).withColumns({
        "measure": F.coalesce("number", F.lit(columns[min(1, len(columns) - 1)])), "label": F.coalesce("free", F.lit(columns[0]))})
    return _numbered(_apply(picks, GALLERY, ("order", "chart", "x", "y"), (0, 1)))
