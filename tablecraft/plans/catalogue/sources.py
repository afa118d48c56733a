"""Source, sink, page extraction and snapshot queries. Files go to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecraft.operators import missing, projection
from tablecraft.plans.catalogue.registry import query, r, rounded
from tablecraft.plans.catalogue.tables import MISSING, TRIM
from tablecraft.sources import files, web


@query("io01_read_csv_multiline", "SELECT doc_id, text FROM documents")
def _(t):
    """Texts with line breaks, quotes and outer blanks through a file and back; nothing is said about line breaks."""
    path = t.scratch()
    files.write_csv(t("documents").select("doc_id", "text"), path)
    return files.read_csv(t.spark, path, schema="doc_id long, text string")


@query("io02_read_delimited_multiline", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, regexp_replace(concat('a', chr(10), text), '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def _(t):
    path = t.scratch()
    files.write_csv(t("conversations").select("conv_id", "turn", F.trim(F.concat(F.lit("a\n"), "text")).alias("text")), path)
    return files.read_delimited(t.spark, path)


@query("io01_read_csv", "SELECT * FROM customer")
def _(t):
    path = t.scratch()
    files.write_csv(t("customer"), path)
    return files.read_csv(t.spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("io01_read_csv_latin1", "SELECT doc_id, lang FROM documents")
def _(t):
    path = t.scratch()
    rows = t("documents").select("doc_id", "lang", F.lit("é").alias("mark"))
    rows.write.csv(path, header=True, encoding="ISO-8859-1")
    return files.read_csv(t.spark, path).filter("mark = 'é'").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang")


_LANDED = ", ".join(f"CASE WHEN {MISSING.format(c)} THEN NULL ELSE {TRIM.format(c)} END AS {c}" for c in ("name", "segment", "balance_text", "email", "active"))


@query("io02_read_delimited", f"SELECT CAST(cust_id AS VARCHAR) AS cust_id, {_LANDED} FROM dirty_customer")
def _(t):
    path = t.scratch()
    t("dirty_customer").write.csv(path, header=True, sep=";")
    return files.read_delimited(t.spark, path)


@query("io03_read_json", "SELECT order_id, amount, priority FROM dirty_orders")
def _(t):
    path = t.scratch()
    files.write_json(t("dirty_orders").select("order_id", "amount", "priority"), path)
    return files.read_json(t.spark, path, schema="order_id bigint, amount double, priority string")


@query("io04_read_parquet", f"SELECT l_returnflag, {r('sum(l_quantity)')} AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def _(t):
    rows = files.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet").filter("l_discount > 0.05D")
    return rounded(rows.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity")))


# Pages: every customer rendered as one page, next to the given pages, which hold no such tables. ----

def _cells_of(c: str):
    seg = F.when(F.col("c_nationkey") % 6 == 0, "N/A").otherwise(F.col("c_mktsegment"))
    return {"Name": F.col("c_name"), "Segment": seg, "Nation": F.col("c_nationkey").cast("string")}[c]


def _render(t, body) -> DataFrame:
    pages = t.wide("customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    return pages.unionByName(t.wide("pages").select((-1 - F.col("page_id")).alias("page_id"), "html"))


def _rows(open_row, open_cell, close_cell, close_row):
    lines = [F.concat(F.lit(open_row + open_cell + label + close_cell + open_cell), _cells_of(label), F.lit(close_cell + close_row)) for label in ("Name", "Segment", "Nation", "Nation")]
    return F.concat(*lines)


def html_pages(t):
    head = "<h2>Card</h2><nav><table><tr><th>menu</th></tr><tr><td>x</td></tr></table></nav><table><thead><tr><th>Field</th><th></th></tr></thead><tbody>"
    return _render(t, F.concat(F.lit(head), _rows("<tr>", "<td>", "</td>", "</tr>"), F.lit("<tr><td> - </td><td></td></tr></tbody></table>")))


def aria_pages(t):
    head = '<div role="grid" aria-label="People"><div role="row"><span role="columnheader">Field</span><span role="columnheader">Value</span></div>'
    return _render(t, F.concat(F.lit(head), _rows('<div role="row">', '<span role="gridcell">', "</span>", "</div>"), F.lit("</div>")))


def div_pages(t):
    head = '<div class="data-grid" id="people-list"><div><b>Field</b><b>Value</b></div>'
    return _render(t, F.concat(F.lit(head), _rows("<div>", "<span>", "</span>", "</div>"), F.lit("</div>")))


def json_pages(t):
    body = F.concat(F.lit('<script type="application/json">[{"Field":"Name","Value":"'), F.col("c_name"), F.lit('"},{"Field":"Nation","Value":'),
                    F.col("c_nationkey").cast("string"), F.lit('}]</script><script type="application/json">{"not":"an array"}</script>'))
    return _render(t, body)


def pre_pages(t):
    body = F.concat(F.lit("<pre>Field;Value\nName;&quot;"), F.col("c_name"), F.lit(";&quot;\nSegment;"), _cells_of("Segment"),
                    F.lit("\n\nNation;"), F.col("c_nationkey").cast("string"), F.lit("\n;N/A\n</pre><pre>too short</pre>"))
    return _render(t, body)


_SEG = "CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE c_mktsegment END"
_LINES = f"l AS (SELECT c_custkey AS page_id, unnest(['Name', 'Segment', 'Nation', 'Nation']) AS a, unnest([c_name, {_SEG}, CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)]) AS b, unnest(range(4)) AS i FROM customer)"


def _table_sql(kind: str, title: str, second: str, shift: int = 0) -> str:
    return f"""WITH {_LINES}
SELECT page_id, '{kind}' AS kind, 0 AS table_idx, '{title}' AS title, CAST(i AS INT) AS row_idx, 0 AS col_idx, 'Field' AS header, a AS value FROM l
UNION ALL SELECT page_id, '{kind}', 0, '{title}', CAST(i AS INT), 1, '{second}', b FROM l"""


@query("io05_html_tables", _table_sql("html_table", "Card (Table #2)", "Column_2"))
def _(t):
    return web.extract_cells(html_pages(t), "html_table")


@query("io05_html_table_summary", f"""SELECT c_custkey AS page_id, 'html_table' AS kind, 0 AS table_idx, 'Card (Table #2)' AS title, 4 AS "rows", 2 AS cols,
  CASE WHEN c_nationkey % 6 = 0 THEN 3 ELSE 2 END AS missing, 1 AS duplicates FROM customer""")
def _(t):
    return web.table_summary(web.element_cells(html_pages(t)))


@query("io06_aria_grids", _table_sql("aria_grid", "People", "Value"))
def _(t):
    return web.extract_cells(aria_pages(t), "aria_grid")


@query("io07_div_grids", _table_sql("div_grid", "People List", "Value"))
def _(t):
    return web.extract_cells(div_pages(t), "div_grid")


@query("io08_embedded_json", """SELECT c_custkey AS page_id, 0 AS table_idx, 0 AS row_idx, 'Field' AS header, 'Name' AS value FROM customer
UNION ALL SELECT c_custkey, 0, 0, 'Value', c_name FROM customer UNION ALL SELECT c_custkey, 0, 1, 'Field', 'Nation' FROM customer
UNION ALL SELECT c_custkey, 0, 1, 'Value', CAST(c_nationkey AS VARCHAR) FROM customer""")
def _(t):
    return web.json_rows(json_pages(t))


@query("io08_event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("io09_pre_blocks", f"""WITH x AS (SELECT c_custkey AS page_id, unnest(['Name', 'Segment', 'Nation', NULL]) AS a, unnest([concat(c_name, ';'), {_SEG}, CAST(c_nationkey AS VARCHAR), NULL]) AS b, unnest(range(4)) AS i FROM customer)
SELECT page_id, 0 AS table_idx, CAST(i AS INT) AS row_idx, 0 AS col_idx, 'Field' AS header, a AS value FROM x
UNION ALL SELECT page_id, 0, CAST(i AS INT), 1, 'Value', b FROM x""")
def _(t):
    return web.pre_rows(pre_pages(t))


def all_pages(t):
    """HTML table, an ARIA grid of the same shape, a div grid of another, JSON and text on one page each."""
    small = '<div class="grid"><div><b>K</b><b>V</b></div><div><i>1</i><i>2</i></div></div>'
    aria = F.concat(F.lit('<div role="grid"><div role="row"><b role="columnheader">F</b><b role="columnheader">G</b></div>'), _rows('<div role="row">', '<b role="cell">', "</b>", "</div>"), F.lit("</div>"))
    html = F.concat(F.lit("<table id='people'><tr><td>Field</td><td>Value</td></tr>"), _rows("<tr>", "<td>", "</td>", "</tr>"), F.lit("</table>"))
    data = F.concat(F.lit('<script type="application/ld+json">[{"a":1,"b":"'), F.col("c_name"), F.lit('"},{"a":2,"b":"x"},{"a":3,"b":"y"}]</script>'))
    text = F.concat(F.lit("<pre>some,thing,else\n1,2,"), F.col("c_name"), F.lit("\n</pre>"))
    return _render(t, F.concat(html, aria, F.lit(small), data, text))


@query("io10_scan_pages", """
SELECT c_custkey AS page_id, kind, 0 AS table_idx, title, CAST(n AS BIGINT) AS "rows", CAST(k AS BIGINT) AS cols FROM customer, (VALUES ('html_table', 'People', 4, 2), ('div_grid', 'Dataset Table #1', 1, 2),
  ('json_array', 'Embedded JSON Dataset #1', 3, 2), ('csv_text', 'Raw Delimited File #1', 1, 3)) v(kind, title, n, k)""")
def _(t):
    return web.scan_pages(all_pages(t))


@query("io11_dataset_pages", """
SELECT c_custkey AS page_id, ['Name', 'Nation_Key'] AS columns, c_name AS name, 'https://data.example/' || CAST(c_custkey AS VARCHAR) AS download_url, 1000 + c_custkey AS records FROM customer
UNION ALL SELECT -1 - page_id, CAST([] AS VARCHAR[]), NULL, NULL, NULL FROM pages""")
def _(t):
    key = F.col("c_custkey").cast("string")
    block = F.concat(F.lit('<script type="application/ld+json">{"@type":"Dataset","name":"'), F.col("c_name"), F.lit('","description":"with '), (F.col("c_custkey") + 1000).cast("string"),
                     F.lit(' synthetic records","distribution":[{"contentUrl":"https://data.example/'), key, F.lit('"}]}</script><p>1. Name: who</p><p>2) Nation_Key - where</p>'))
    return web.dataset_pages(_render(t, block))


# Sinks ---------------------------------------------------------------------------------------------

@query("io12_write_csv", "SELECT doc_id, text FROM documents")
def _(t):
    path = t.scratch()
    rows = t("documents").select("doc_id", "text")
    files.write_csv(rows, path, crlf=False)
    back = t.spark.read.csv(path, header=True, schema="doc_id bigint, text string", quote='"', escape='"', multiLine=True)
    return back


@query("io12_write_csv_crlf", "SELECT * FROM supplier")
def _(t):
    path = t.scratch()
    files.write_csv(t("supplier"), path, crlf=True)
    return t.spark.read.csv(path, header=True, schema=t("supplier").schema, lineSep="\r\n")


@query("io13_write_json", "SELECT * FROM part")
def _(t):
    path = t.scratch()
    files.write_json(t("part"), path)
    return t.spark.read.schema(t("part").schema).json(path)


@query("io14_write_tsv", "SELECT doc_id, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS text FROM documents")
def _(t):
    path = t.scratch()
    files.write_tsv(t("documents").select("doc_id", "text"), path)
    return t.spark.read.csv(path, header=True, sep="\t", schema="doc_id bigint, text string", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("io15_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return files.preview(t("orders"), ["o_orderkey"], 100)


_SHAPED = (("customer", 5), ("orders", 6), ("lineitem", 11), ("events", 6), ("documents", 5), ("pages", 3))


@query("io16_dataset_shapes", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, {w} AS columns FROM {n}" for n, w in _SHAPED))
def _(t):
    return files.dataset_shapes({n: t(n) for n, _ in _SHAPED})


@query("io16_dataset_catalog")
def _(t):
    return files.dataset_catalog(t.spark, t.sf_dir, "*.parquet")


@query("io17_nan_to_null", "SELECT order_id, strftime(order_ts, '%Y-%m-%dT%H:%M:%S') AS order_ts, CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio FROM dirty_orders")
def _(t):
    return missing.iso_timestamps(missing.nan_to_null(t("dirty_orders").select("order_id", "order_ts", "ratio")))


@query("io18_strip_names", "SELECT s_suppkey AS key, s_name AS label FROM supplier")
def _(t):
    return projection.strip_column_names(t("supplier").select(F.col("s_suppkey").alias(" key "), F.col("s_name").alias("label ")))


# Snapshots -----------------------------------------------------------------------------------------

@query("pl03_versions", """SELECT 1 AS version, count(*) AS row_count, 5 AS n_columns FROM customer UNION ALL SELECT 2, count(*), 4 FROM customer WHERE c_acctbal > 0""")
def _(t):
    folder = t.scratch()
    files.save_version(t("customer"), folder, 1)
    files.save_version(files.load_version(t.spark, folder, 1).filter("c_acctbal > 0").drop("c_name"), folder, 2)
    return files.list_versions(t.spark, folder).select("version", "row_count", F.size("columns").alias("n_columns"))


@query("pl03_compare_versions", """SELECT (SELECT count(*) FROM customer) AS prev_rows, count(*) AS new_rows, 0 AS added_rows, (SELECT count(*) FROM customer) - count(*) AS removed_rows,
  '' AS new_columns, 'c_name' AS removed_columns, true AS is_update, 2 AS version FROM customer WHERE c_acctbal > 0""")
def _(t):
    folder = t.scratch()
    files.save_version(t("customer"), folder, 1)
    files.save_version(t("customer").filter("c_acctbal > 0").drop("c_name"), folder, 2)
    return files.compare_versions(t.spark, folder, 1, 2)
