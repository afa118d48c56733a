import pytest
from pyspark.sql import functions as F

from tablecraft.plans import recipe


def effects_of(df, steps):
    result, effects = recipe.run_counted(df, steps)
    return result, [tuple(r)[1:] for r in effects.orderBy("step").collect()]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(
        [(1, " a ", "x", 1.0), (2, "b", "N/A", None), (3, " a ", None, 3.0), (3, " a ", None, 3.0), (4, None, "y", 5.0)],
        "id int, name string, `odd name` string, v double")


STEPS = [{"action": "trim_whitespace", "columns": ["name"]}, {"action": "remove_duplicates"},
         {"action": "impute", "column": "v", "method": "mean"}, {"action": "cast_columns", "types": {"id": "numeric"}},
         {"action": "rename_columns", "mapping": {"v": "__was"}}, {"action": "text_case", "style": "upper", "columns": ["name"]},
         {"action": "drop_missing", "columns": ["name"]}, {"action": "none_such"}]


def test_every_step_is_counted(rows):
    result, found = effects_of(rows, STEPS)
    plain = recipe.run_recipe(rows, STEPS)
    assert sorted(map(str, result.collect())) == sorted(map(str, plain.collect())) and result.schema.names == plain.schema.names
    by_name = {f[0]: f[1:] for f in found}
    assert by_name["trim_whitespace"] == (5, 5, 3, 4) and by_name["remove_duplicates"] == (5, 4, 0, 4)
    assert by_name["impute"] == (4, 4, 1, 4) and by_name["rename_columns"] == (4, 4, 0, 4)
    assert by_name["text_case"] == (4, 4, 3, 4) and by_name["drop_missing"] == (4, 3, 0, 4) and by_name["none_such"] == (3, 3, 0, 4)


def test_rows_are_computed_once(spark, rows):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        made.add(1)
        return x

    local = [s for s in STEPS if s["action"] in ("trim_whitespace", "drop_missing", "text_case")]
    result, found = effects_of(rows.withColumn("name", told.asNondeterministic()("name")), local)
    assert made.value == 5 and found[-1][:3] == ("drop_missing", 5, 4)
    result.count()
    assert made.value == 5  # the result is stored


def test_empty_tables_recipes_and_void_columns(spark, rows):
    _, found = effects_of(rows.limit(0), STEPS[:3])
    assert [f[1:4] for f in found] == [(0, 0, 0)] * 3
    result, found = effects_of(rows, [])
    assert found == [] and result.count() == 5
    result, found = effects_of(rows.withColumn("nothing", F.lit(None)), [{"action": "trim"}])
    assert result.count() == 5 and found == [("trim", 5, 5, 3, 5)]
