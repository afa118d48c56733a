"""Row-local cleaning of a stream: the same expressions as in batch, no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablecraft.plans.recipe import ALIASES, ROW_LOCAL, Step, run_recipe

def clean_stream(stream: DataFrame, recipe: Sequence[Step]) -> DataFrame:
    """Apply a recipe of row-local steps; a step that needs the whole table is refused."""
    for step in recipe:
        name = str(step["action"])
        if ALIASES.get(name, name) not in ROW_LOCAL:
            raise ValueError(f"{name} needs the whole table and cannot run on a stream")
    return run_recipe(stream, recipe)
