"""Counts by digest against plain counting, and what a profile sends through its shuffles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablecraft.functions import cells
from tablecraft.operators import profile, typing_ops
from tablecraft.operators.cell_counts import distinct_cells, top_cells


def by_hand(values, k):
    counts = Counter(v for v in values if v is not None)
    return [(i, v, n, sum(counts.values())) for i, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k], 1)]


def found(df, columns, k, **options):
    out = {c: [] for c in columns}
    for r in top_cells(df, columns, k, **options).collect():
        out[r["column"]].append((r["rank"], r["value"], r["n"], r["total"]))
    return {c: sorted(rows) for c, rows in out.items()}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_cells(spark, k):
    """Ties everywhere, equal beginnings longer than one comparison, letters of several bytes over its border, one hot value."""
    rng = random.Random(k)
    names = ["x" * 15 + "é" + t for t in "abc"] + ["Customer#" + "0" * n + str(i) for n in (20, 40) for i in range(12)] + ["", " ", "日本語" * 9, "日本語" * 9 + "x"]
    columns = {
        "ties": names * 2,
        "unique": [f"{'p' * 33}{i:05d}" for i in range(2 * len(names))],
        "hot": ["same" if i % 3 == 0 else rng.choice(names) for i in range(2 * len(names))],
        "empty": [None] * (2 * len(names)),
        "gaps": [None if i % 2 else rng.choice(names[:5]) for i in range(2 * len(names))],
    }
    rows = list(zip(*columns.values()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(5)
    assert found(df, list(columns), k) == {c: by_hand(v, k) for c, v in columns.items()}
    trimmed = found(df, ["ties"], k, shape=lambda v: F.when(v != "", cells.trim_ws(v)))
    assert trimmed["ties"] == by_hand([v.strip() for v in columns["ties"] if v], k)


def test_no_rows_and_no_columns(spark):
    df = spark.createDataFrame([], "a string, b bigint")
    assert top_cells(df, ["a", "b"]).count() == 0 and top_cells(df, []).count() == 0
    assert distinct_cells(df).count() == 0


def test_distinct_cells_count_every_cell(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (1, None, None), (2, "A ", 1.5), (None, "a", 2.0)], "a bigint, b string, c double")
    got = sorted((r["column"], r["n"], r["cell"] is None) for r in distinct_cells(df).collect())
    assert got == [("a", 1, False), ("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 1, True), ("b", 2, False), ("c", 1, False), ("c", 1, True), ("c", 2, False)]
    folded = distinct_cells(df, ["b"], cell=F.lower(cells.trim_ws("value")))
    assert sorted((r["cell"] or "", r["n"]) for r in folded.collect()) == [("", 1), ("a", 3)]


def exchanged(plan):
    """Names of the text columns that leave any exchange of a physical plan."""
    out, children = [], plan.children()
    if plan.nodeName() in ("Exchange", "BroadcastExchange"):
        attributes = plan.output()
        out += [attributes.apply(i).name() for i in range(attributes.size()) if attributes.apply(i).dataType().typeName() == "string"]
    for i in range(children.size()):
        out += exchanged(children.apply(i))
    return out


@pytest.mark.parametrize("rule", [
    typing_ops.type_votes, typing_ops.tell_column_type, typing_ops.semantic_type, typing_ops.dominant_type, typing_ops.typed_cells,
    profile.column_facts, profile.entropy, profile.target_suggestions, profile.browser_profile])
def test_profiles_shuffle_no_cells(spark, rule):
    """Beside names of columns and labels of the rules no text passes an exchange, however long the cells are."""
    df = spark.createDataFrame([(f"{'long text ' * 20}{i}", str(i % 7), float(i)) for i in range(50)], "note string, code string, x double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = exchanged(rule(df)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert set(texts) <= {"column", "type", "dominant_type", "reason"}
