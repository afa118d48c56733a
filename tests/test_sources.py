import json

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import charts
from tablecraft.sources import files, web
from tablecraft.sources.dom import parse
from tablecraft.streaming.rows import clean_stream
from tests.conftest import rows_of


def test_sniff_delimiter():
    assert files.sniff_delimiter(["a;b;c", "1;2;3"]) == ";"
    assert files.sniff_delimiter(["a|b", "1|2", "3|4"]) == "|"
    assert files.sniff_delimiter(["a,b;c", "1,2", "", "3,4"]) == ","
    assert files.sniff_delimiter(["word", "other"]) is None


def test_read_delimited(spark, tmp_path):
    (tmp_path / "t.txt").write_text('name\t\tcity\n"a ""q"" b"\t1\tN/A\n\n-\tnull\t\nx\t2\tRome\n')
    got = files.read_delimited(spark, str(tmp_path / "t.txt"))
    assert got.columns == ["name", "Col_2", "city"]
    assert rows_of(got) == [('a "q" b', "1", None), ("x", "2", "Rome")]


def test_read_json_shapes(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "one.json").write_text(json.dumps(rows[0], indent=1))
    assert rows_of(files.read_json(spark, str(tmp_path / "array.json"))) == [(1, "x"), (2, "y")]
    assert rows_of(files.read_json(spark, str(tmp_path / "lines.json"))) == [(1, "x"), (2, "y")]
    assert rows_of(files.read_json(spark, str(tmp_path / "one.json"))) == [(1, "x")]


def test_read_request(spark):
    assert rows_of(files.read_request(spark, {"records": [{"a": 1, "b": "x"}, {"a": 2.5}]})) == [(1.0, "x"), (2.5, None)]
    assert rows_of(files.read_request(spark, {"csv_text": 'a;b\n1;"x;y"\n'})) == [("1", "x;y")]


def test_latin1(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,n\ncafé,1\n".encode("latin1"))
    assert rows_of(files.read_csv(spark, str(tmp_path / "l.csv"))) == [("café", 1)]


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    files.save_version(spark.range(5).toDF("a"), folder, 1)
    files.save_version(spark.range(3).select(F.col("id").alias("b")), folder, 2)
    assert [(r["version"], r["row_count"], r["columns"]) for r in files.list_versions(spark, folder).collect()] == [(1, 5, ["a"]), (2, 3, ["b"])]
    diff = files.compare_versions(spark, folder, 1, 2).first()
    assert (diff["removed_rows"], diff["new_columns"], diff["removed_columns"], diff["version"]) == (2, "b", "a", 2)


def test_a_failed_save_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "v")
    files.save_version(spark.range(5).toDF("a"), folder, 1)
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("a"))
    for version in (1, 2):
        with pytest.raises(Exception, match="lost"):
            files.save_version(broken, folder, version)
    assert [(r["version"], r["row_count"]) for r in files.list_versions(spark, folder).collect()] == [(1, 5)]
    assert files.load_version(spark, folder, 1).count() == 5
    with pytest.raises(ValueError, match="version 2"):
        files.load_version(spark, folder, 2)


def test_the_last_save_of_a_version_counts(spark, tmp_path):
    folder = str(tmp_path / "v")
    files.save_version(spark.range(5).toDF("a"), folder, 1)
    before = files.load_version(spark, folder, 1)
    files.save_version(before.where("a < 2").withColumn("b", F.lit("x")), folder, 1)  # reads what it replaces
    assert rows_of(files.load_version(spark, folder, 1)) == [(0, "x"), (1, "x")] and before.count() == 5
    assert [(r["row_count"], r["columns"]) for r in files.list_versions(spark, folder).collect()] == [(2, ["a", "b"])]


def test_an_empty_version(spark, tmp_path):
    folder = str(tmp_path / "v")
    files.save_version(spark.range(0).toDF("a"), folder, 3)
    assert files.load_version(spark, folder, 3).columns == ["a"]
    assert [(r["version"], r["row_count"]) for r in files.list_versions(spark, folder).collect()] == [(3, 0)]


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id bigint, html string")


def test_dom_repairs_missing_end_tags():
    root = parse("<table><tr><td>a<td>b<tr><td>c</table><p>x<p>y")
    assert [[c.text() for c in r.tagged("td")] for r in root.tagged("tr")] == [["a", "b"], ["c"]]
    assert [p.text() for p in root.tagged("p")] == ["x", "y"]


def test_table_without_thead_and_layout_tables(spark):
    html = """<table role="presentation"><tr><td>no</td></tr><tr><td>no</td></tr></table>
    <section><strong>Cars</strong><table><tr><th>Brand</th><th> </th></tr><tr><td>Toyota<br>x</td><td>N/A</td></tr><tr><td>-</td><td></td></tr></table></section>"""
    cells = web.extract_cells(page(spark, html), "html_table")
    assert rows_of(cells, "title", "row_idx", "header", "value") == [("Cars", 0, "Brand", "Toyota\nx"), ("Cars", 0, "Column_2", None)]
    summary = web.table_summary(web.element_cells(page(spark, html))).first()
    assert (summary["rows"], summary["cols"], summary["missing"], summary["duplicates"]) == (1, 2, 3, 0)


def test_round_trip_of_rendered_rows(spark, employees):
    cell = [F.concat(F.lit("<td>"), F.col(c), F.lit("</td>")) for c in employees.columns]
    row = employees.select(F.concat(F.lit("<tr>"), *cell, F.lit("</tr>")).alias("r"))
    body = "".join(r["r"] for r in row.collect())
    head = "".join(f"<th>{c}</th>" for c in employees.columns)
    cells = web.extract_cells(page(spark, f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"), "html_table")
    back = cells.groupBy("row_idx").pivot("header", employees.columns).agg(F.first("value")).drop("row_idx")
    assert rows_of(back) == sorted([("Rahul", "23", "$50,000", "hr"), ("Amit", None, "$55,000", "HR"), ("Priya", "25", None, "Human Resources"), ("Rahul", "23", "$50,000", "hr")], key=str)


def test_pre_block_without_delimiter(spark):
    assert web.pre_rows(page(spark, "<pre>just some words here\nand some more words</pre>")).count() == 0


def test_dataset_page(spark):
    got = web.dataset_pages(page(spark, "<p>1. only_one: x</p>")).first()
    assert got["columns"] == [] and got["name"] is None


def test_row_local_recipe_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, " Ann ", "$5"), (2, "n/a", "x")], "id int, name string, pay string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, name string, pay string").json(str(tmp_path / "in"))
    steps = [{"action": "trim"}, {"action": "null_tokens"}, {"action": "to_numeric", "column": "pay"}, {"action": "mask", "style": "server"}]
    out = clean_stream(stream, steps)
    query = out.writeStream.format("memory").queryName("cleaned_rows").trigger(availableNow=True).start()
    query.processAllAvailable()
    query.stop()
    assert rows_of(spark.table("cleaned_rows"), "id", "pay") == [(1, 5.0), (2, None)]
    with pytest.raises(ValueError):
        clean_stream(stream, [{"action": "impute", "column": "pay", "method": "median"}])


def test_plans_scan_once_and_push_down(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = charts.chart_query(lineitem.filter("l_discount > 0.05D"), "l_returnflag", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "PushedFilters: [IsNotNull(l_discount)" in plan and "l_extendedprice" not in plan
    assert "TakeOrderedAndProject" in plan
