"""Cleaning recipes: an ordered list of operations folded over a frame, replayable at any prefix."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tablecraft.functions import cells
from tablecraft.operators import dedup, filters, missing, outliers, profile, projection, texts, typing_ops
from tablecraft.session import ensure_checkpoint_dir, materialize

Step = Mapping[str, object]


def _present(df: DataFrame, names) -> list[str]:
    return [n for n in ([names] if isinstance(names, str) else names or []) if n in df.columns]


def _impute(df: DataFrame, column: str, method: str = "median", value=None, order_by=(), partition_by=()) -> DataFrame:
    if column not in df.columns:
        return df
    if method in ("ffill", "bfill"):
        fill = missing.forward_fill if method == "ffill" else missing.backward_fill
        return fill(df, [column], order_by, partition_by)
    if method == "drop":
        return filters.drop_missing(df, [column])
    return missing.fill_missing(df, {column: f"={value}" if method == "custom" else method})


# Both spellings of an action (server first, browser second) lead to the same operator.
ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "drop_columns": lambda df, columns: projection.drop_columns(df, columns),
    "rename_columns": lambda df, mapping: projection.rename_columns(df, mapping),
    "reorder_columns": lambda df, columns: projection.reorder_columns(df, columns),
    "add_measure": lambda df, **k: projection.add_measure(df, **k),
    "add_expression": lambda df, **k: projection.add_expression(df, **k),
    "cast_columns": lambda df, types: typing_ops.cast_columns(df, types),
    "cast_values": lambda df, types: typing_ops.cast_value_columns(df, types),
    "to_numeric": lambda df, column: typing_ops.clean_numeric_column(df, column) if column in df.columns else df,
    "drop_duplicates": lambda df, **k: dedup.dedup(df, **k),
    "trim": lambda df, columns=None: texts.trim_text(df, columns),
    "squeeze": lambda df, columns=None: texts.squeeze_text(df, columns),
    "text_case": lambda df, style, columns=None: texts.change_case(df, style, columns),
    "normalize_categories": lambda df, column: texts.normalize_categories(df, column) if column in df.columns else df,
    "map_categories": lambda df, column, mapping: texts.map_categories(df, column, mapping),
    "iso_dates": lambda df, column: texts.standardize_dates(df, _present(df, column)),
    "mask": lambda df, style="server", columns=None: texts.mask_columns(df, style, columns),
    "null_tokens": lambda df, columns=None: df.withColumns(
        {c: cells.blank_missing(c) for c in (columns or projection.text_columns(df))}),
    "impute": _impute,
    "impute_columns": lambda df, methods: missing.fill_missing(df, methods),
    "normalize_columns": lambda df, columns: texts.normalize_columns(df, columns),
    "bulk_fill": lambda df, how="mean": missing.bulk_fill(df, how),
    "drop_missing": lambda df, columns=None: filters.drop_missing(df, columns),
    "nan_to_null": lambda df: missing.nan_to_null(df),
    "remove_outliers": lambda df, **k: outliers.remove_outliers(df, **k),
    "treat_outliers": lambda df, **k: outliers.treat_outliers(df, **k),
    "filter": lambda df, column, op, value=None: filters.filter_rows(df, column, op, value),
}
ALIASES = {
    "drop": "drop_columns", "rename": "rename_columns", "cast": "cast_columns", "remove_duplicates": "drop_duplicates",
    "fill_missing": "impute", "trim_whitespace": "trim", "standardize_text": "text_case", "standardize_dates": "iso_dates",
    "mask_pii": "mask", "cap_outliers": "treat_outliers",
}


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """One operation; an unknown action changes nothing."""
    name = str(step["action"])
    run = ACTIONS.get(ALIASES.get(name, name))
    return run(df, **{k: v for k, v in step.items() if k != "action"}) if run else df


def fuse(recipe: Sequence[Step]) -> list[Step]:
    """Neighbouring imputations, and neighbouring category alignments, of different columns become one
    step each, so that their statistics come from shared passes."""
    out: list[dict] = []
    for step in recipe:
        name = ALIASES.get(str(step["action"]), str(step["action"]))
        last = out[-1] if out else {}
        if name == "impute" and step.get("method", "median") in ("mean", "median", "mode", "zero", "unknown"):
            if last.get("action") != "impute_columns" or step["column"] in last["methods"]:
                out.append({"action": "impute_columns", "methods": {}})
            out[-1]["methods"][step["column"]] = step.get("method", "median")
        elif name == "normalize_categories":
            if last.get("action") != "normalize_columns" or step["column"] in last["columns"]:
                out.append({"action": "normalize_columns", "columns": []})
            out[-1]["columns"].append(step["column"])
        else:
            out.append(dict(step))
    return out


# Steps that need one row at a time.
ROW_LOCAL = {
    "drop_columns", "rename_columns", "reorder_columns", "add_measure", "add_expression", "cast_columns", "cast_values",
    "to_numeric", "trim", "squeeze", "text_case", "map_categories", "iso_dates", "mask", "null_tokens", "drop_missing",
    "nan_to_null", "filter",
}
# Steps that change cells where they are, under their column's name.
IN_PLACE = {
    "cast_columns", "cast_values", "to_numeric", "trim", "squeeze", "text_case", "map_categories", "iso_dates", "mask", "null_tokens",
    "nan_to_null", "impute", "impute_columns", "normalize_categories", "normalize_columns", "bulk_fill", "treat_outliers",
}
# Steps that read the whole table for statistics before they change anything.
STATISTICAL = {"impute", "impute_columns", "normalize_columns", "bulk_fill", "remove_outliers", "treat_outliers"}


def run_recipe(df: DataFrame, recipe: Sequence[Step]) -> DataFrame:
    """Apply the steps in order. De-duplicated rows are stored when later steps read them for statistics,
    so that the shuffle of whole rows happens once."""
    steps = fuse(recipe)
    for i, step in enumerate(steps):
        df = apply_step(df, step)
        later = {ALIASES.get(str(s["action"]), str(s["action"])) for s in steps[i + 1:]}
        if ALIASES.get(str(step["action"]), step["action"]) == "drop_duplicates" and later & STATISTICAL:
            df = materialize(df)
    return df


def run_logged(df: DataFrame, recipe: Sequence[Step]) -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """As ``run_recipe``; each step's row count is observed when the result is computed."""
    log = []
    for i, step in enumerate(recipe):
        seen = Observation(f"step_{i}")
        df = apply_step(df, step).observe(seen, F.count(F.lit(1)).alias("rows"))
        log.append((str(step["action"]), seen))
    return df, log


def change_log(df: DataFrame, recipe: Sequence[Step]) -> DataFrame:
    """``step, action, rows, columns`` after every operation of a recipe."""
    parts = []
    for i, step in enumerate(recipe, start=1):
        df = apply_step(df, step)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("step"), F.lit(str(step["action"])).alias("action"), "rows", F.lit(len(df.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


def _own(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. Columns are numbered in it, so that any name will do."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/recipe-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema if f.dataType.typeName() == "void"}  # files hold none
    plain = df.select(*[(_own(c).cast("string") if c in void else _own(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def run_counted(df: DataFrame, recipe: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """The result, and ``step, action, rows_before, rows_after, cells_changed, columns`` of every step, counted while it runs.

    Steps of single rows are observed inside the one plan that computes them; no prefix runs twice. Rows are written out before each step
    that needs the whole table and at the end, so every count is made in the tasks that write: a task that is run again after a lost
    executor counts once. A cell has changed if it differs from the one of its column before, as text where the type differs. Steps
    that drop, add, rename or reorder columns or rows change no cells, unknown actions nothing. An empty recipe gives an empty log.
    """
    log: list[tuple[int, str, Observation, int]] = []
    start = Observation("start")
    df = df.observe(start, F.count(F.lit(1)).alias("rows"))
    for i, step in enumerate(recipe, start=1):
        name = ALIASES.get(str(step["action"]), str(step["action"]))
        if name in ACTIONS and name not in ROW_LOCAL:
            df = _written(df)
        was, before = "__was", df
        while was in {c.lower() for c in df.columns}:
            was = f"_{was}"
        if name in IN_PLACE:
            df = df.withColumn(was, F.struct(*[_own(c).alias(f"c{j}") for j, c in enumerate(before.columns)]))
        df = apply_step(df, step)
        same = []
        if name in IN_PLACE:
            for j, c in enumerate(before.columns):
                if c in df.columns:
                    now, old = _own(c), F.col(was)[f"c{j}"]
                    if df.schema[c].dataType != before.schema[c].dataType:
                        now, old = now.cast("string"), old.cast("string")
                    same.append(now.eqNullSafe(old))
        changed = reduce(lambda a, b: a + b, [F.when(x, 0).otherwise(1) for x in same], F.lit(0))
        seen = Observation(f"step_{i}")
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(changed), F.lit(0)).alias("cells"))
        df = df.drop(was) if name in IN_PLACE else df
        log.append((i, str(step["action"]), seen, len(df.columns)))
    result = _written(df)
    rows, effects = start.get["rows"], []
    for i, action, seen, columns in log:
        found = seen.get
        effects.append((i, action, rows, found["rows"], found["cells"], columns))
        rows = found["rows"]
    schema = "step int, action string, rows_before bigint, rows_after bigint, cells_changed bigint, columns int"
    return result, df.sparkSession.createDataFrame(effects, schema)


class History:
    """Undo and redo over a recipe: states are prefixes, nothing is copied."""

    def __init__(self, source: DataFrame, recipe: Sequence[Step] = ()):
        self.source, self.recipe, self.at = source, list(recipe), len(recipe)

    def push(self, step: Step) -> "History":
        self.recipe = self.recipe[: self.at] + [step]
        self.at += 1
        return self

    def undo(self) -> "History":
        self.at = max(0, self.at - 1)
        return self

    def redo(self) -> "History":
        self.at = min(len(self.recipe), self.at + 1)
        return self

    def reset(self) -> "History":
        self.at = 0
        return self

    def current(self) -> DataFrame:
        return run_recipe(self.source, self.recipe[: self.at])


def auto_clean_recipe(df: DataFrame, overrides: Mapping[str, str] | None = None, order_by: Sequence[str] = ()) -> list[Step]:
    """The recipe one-click cleaning would run, derived from the column profiles (one row per column)."""
    found = {r["column"]: r for r in profile.browser_profile(df, overrides).collect()}
    first: list[Step] = [{"action": "trim"}, {"action": "drop_duplicates", "normalize": "trim_lower", "order_by": list(order_by)}]
    # Steps of different columns do not touch each other; grouped by kind they share statistics passes.
    numbers, dates, labels, gaps = [], [], [], []
    for c in df.columns:
        p = found.get(c)
        if p is None:
            continue
        kind = p["dominant_type"]
        is_text = not projection.is_numeric(df, c)
        if is_text and (kind in ("numeric", "currency") or p["n_currency"] > 0):
            numbers.append({"action": "to_numeric", "column": c})
        if kind == "date" and is_text:
            dates.append({"action": "iso_dates", "column": c})
        if is_text and (kind == "categorical" or p["casing_groups"] > 0):
            labels.append({"action": "normalize_categories", "column": c})
        if p["nulls"] > 0:
            if kind in ("numeric", "currency"):
                gaps.append({"action": "impute", "column": c, "method": "median"})
            elif kind == "date" and order_by:
                gaps.append({"action": "impute", "column": c, "method": "ffill", "order_by": list(order_by)})
            else:
                gaps.append({"action": "impute", "column": c, "method": "mode"})
    return [*first, *numbers, *dates, *labels, *sorted(gaps, key=lambda s: s["method"])]


def auto_clean(df: DataFrame, order_by: Sequence[str] = (), null_tokens: bool = True) -> DataFrame:
    """Trim, drop copies, parse numbers, ISO dates, align categories, fill gaps."""
    landed = apply_step(df, {"action": "null_tokens"}) if null_tokens else df
    return run_recipe(landed, auto_clean_recipe(landed, order_by=order_by))
