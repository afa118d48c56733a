import datetime

import pytest
from pyspark.sql import functions as F

from tablecraft.functions import cells


def run(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_parse_numeric(spark):
    values = ["$1,200.50", "12%", "-3", "€ 50", "abc", "", None, "1d", "NaN", "Infinity", "1e3", "12.", ".5", "1-2"]
    expected = [1200.5, 0.12, -3.0, 50.0, None, None, None, None, None, None, 1000.0, 12.0, 0.5, None]
    assert run(spark, cells.parse_numeric, values) == expected


def test_percent_unscaled(spark):
    assert run(spark, cells.to_numeric_strip, ["12%", "$5"]) == [12.0, 5.0]


@pytest.mark.parametrize("value, kind", [
    ("N/A", "null"), ("-", "null"), (None, "null"), ("Yes", "boolean"), ("a@b.co", "email"), ("https://x.org/a b", "url"),
    ("555-123-4567", "phone"), ("$1,200.50", "currency"), ("-12.4%", "percentage"), ("1,200", "integer"), ("12", "integer"),
    ("3.14", "float"), ("2024-01-31", "date"), ("1/31/2024", "date"), ("March 5, 2024", "date"), ("2024-13-45", "string"), ("hello there", "string"),
])
def test_infer_value_type(spark, value, kind):
    assert run(spark, cells.infer_value_type, [value]) == [kind]


def test_parse_date(spark):
    values = ["2024-1-5", "2024/01/05 10:00", "01-05-2024", "1/5/49", "1/5/51", "Jan 5 2024", "january 5, 2024", "Foo 5 2024", "2024-02-30", "20240105"]
    day = datetime.date(2024, 1, 5)
    assert run(spark, cells.parse_date, values) == [day, day, day, datetime.date(2049, 1, 5), datetime.date(1951, 1, 5), day, day, None, None, None]


def test_title_case(spark):
    assert run(spark, cells.title_case, ["o'neil world2x élan"]) == ["O'Neil World2X Élan"]
    assert run(spark, lambda c: cells.title_case(c, "word"), ["o'neil world2x"]) == ["O'neil World2x"]


def test_trim_is_unicode(spark):
    assert run(spark, cells.trim_ws, ["  a 　"]) == ["a"]


def test_floor_mod(spark):
    df = spark.createDataFrame([(7.0, -3.0), (-7.0, 3.0), (7.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(cells.floor_mod("a", "b")).collect()] == [-2.0, 2.0, None]


def test_masks(spark):
    assert run(spark, cells.mask_server, ["rahul@x.com", "Rahul", "A12345", None]) == ["ra***@x.com", "Anon_69838bb0", "A1****45", None]
    assert run(spark, cells.mask_browser, ["a@", "+1 555-123-4567", "Priya Shah", "abc"]) == ["***@domain.com", "+1 ****67", "Pr******ah", "***"]
    assert run(spark, cells.redact_email_cell, ["a@b", "c"]) == ["[EMAIL]", "c"]


def test_row_local_expressions_stay_out_of_python(spark):
    df = spark.createDataFrame([("a",)], "c string")
    plan = df.select(cells.infer_value_type("c"), cells.parse_numeric("c"), cells.mask_server("c"), cells.title_case("c"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
