"""Tables found in web pages, in long form: one row per cell.

Element-based kinds (html_table, aria_grid, div_grid) need a parser and run in ``mapInPandas`` over
batches of pages; embedded JSON and preformatted text stay in built-in expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.cells import text
from tablecraft.sources.dom import Node, parse
from tablecraft.sources.files import DELIMITERS

# What marks a table, a layout container, a missing cell. ---------------------------
CELL_NULLS = ("", "null", "n/a", "-")
LAYOUT_ROLES = {"presentation", "none", "menubar", "navigation"}
LAYOUT_TAGS = {"nav", "header", "footer"}
LAYOUT_CLASSES = {"navbar", "menu", "nav", "sidebar-nav"}
CARD_CLASSES = {"card", "glass-card", "panel", "widget", "table-container"}
CARD_TITLE_CLASSES = {"card-title", "panel-title"}
GRID_CLASS = re.compile("table|Table|grid|Grid|data-view|DataCard")
GRID_TESTID = re.compile("table|grid")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
RX_JSON_SCRIPT = r"(?is)<script[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"
RX_LD_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
RX_PRE = r"(?is)<pre[^>]*>(.*?)</pre>"
RX_LISTED_COLUMN = r"(?:^|\n|\r)\s*\d+[.)]\s*([A-Za-z0-9_]+)\s*[:\-]"
RX_RECORDS = r"(?i)([0-9,]+)\s*(?:synthetic\s*)?records"
KIND_ORDER = {"csv_text": 0, "html_table": 1, "aria_grid": 2, "div_grid": 3, "json_array": 4}
# -------------------------------------------------------------------------------------------------

OUTPUT_ROWS = 20_000
CELL_SCHEMA = (
    "page_id bigint, kind string, table_idx int, title string, row_idx int, col_idx int, header string, "
    "value string, row_has_data boolean"
)


class Group(NamedTuple):
    """Rows that belong together: their kind, the element that holds them, the cells that name the columns, if any are marked."""

    kind: str
    box: Node
    rows: list[Node]
    names: list[Node]
    place: int = 0


def _headings(root: Node) -> dict[Node, str]:
    """For each element that has one: the first heading of the nearest earlier sibling that holds a heading with text."""
    first: dict[Node, str] = {}
    for node in reversed(list(root.walk())):  # children come before their parents
        own = node.text() if node.tag in HEADING_TAGS else ""
        inner = next((first[k] for k in node.children if k in first), "")
        if own or inner:
            first[node] = own or inner
    before: dict[Node, str] = {}
    for node in (root, *root.walk()):
        last = ""
        for kid in node.children:
            if last:
                before[kid] = last
            last = first.get(kid, last)
    return before


def _titles(group: Group, before: dict[Node, str]) -> Iterator[str]:
    """Possible titles, the best first; empty ones are passed over by the caller."""
    box = group.box
    yield from (c.text() for c in box.tagged("caption"))
    yield from (box.attrs.get(name, "").strip() for name in ("aria-label", "title"))
    own = box.attrs.get("id", "")
    if not own.startswith("table_"):
        yield re.sub(r"\b\w", lambda m: m.group().upper(), re.sub("[-_]", " ", own))
    line = [box, *box.ancestors()]
    card = next((n for n in line if n.tag == "section" or not CARD_CLASSES.isdisjoint(n.classes)), None)
    if card is not None:
        heads = (n for n in card.walk() if n.tag in (*HEADING_TAGS, "strong") or not CARD_TITLE_CLASSES.isdisjoint(n.classes))
        yield next((n.text() for n in heads), "")[:40]
    for node in line:
        if node.tag == "body":
            break
        if node in before:
            yield f"{before[node]} (Table #{group.place + 1})"
    yield f"Dataset Table #{group.place + 1}"


def _table_group(table: Node, place: int) -> Group:
    """Rows of a table without its header row: the first row of a head section, or the first row of all."""
    section = {}
    for part in table.tagged("thead", "tbody"):
        section |= {row: part.tag for row in part.tagged("tr")}
    rows = table.tagged("tr")
    header = next((r for r in rows if section.get(r) == "thead"), rows[0])
    body = [r for r in rows if section.get(r) == "tbody"] or rows
    return Group("html_table", table, [r for r in body if r is not header], header.tagged("th", "td"), place)


def _alike(box: Node) -> list[Node]:
    """Children of a box, or of its only child, that look like rows: two or more cells, about as many as most."""
    kids = box.children
    if len(kids) == 1 and len(kids[0].children) >= 2:
        kids = kids[0].children
    widths = Counter({k: len(k.children) for k in kids if k.tag not in ("script", "style") and len(k.children) >= 2})
    if not widths:
        return []
    usual = Counter(widths.values()).most_common(1)[0][0]
    return [k for k in kids if k in widths and abs(widths[k] - usual) <= 1]


def _groups(root: Node) -> list[Group]:
    """One walk over the page; what holds for all elements below another is handed down with them."""
    tables, grids, rows_of_box = [], [], {}
    places = count()
    open_ = [(root, False, None)]
    while open_:
        node, layout, box = open_.pop()
        role = node.attrs.get("role", "")
        layout = layout or node.tag in LAYOUT_TAGS or not LAYOUT_CLASSES.isdisjoint(node.classes) or node.attrs.get("id") == "sidebar"
        usable = not layout and role not in LAYOUT_ROLES
        if node.tag == "table":
            place = next(places)
            if usable and node.tagged("tr"):
                tables.append(_table_group(node, place))
        elif usable and (GRID_CLASS.search(node.attrs.get("class", "")) or GRID_TESTID.search(node.attrs.get("data-testid", ""))):
            grids.append(Group("div_grid", node, _alike(node), node.all(_names_column)))
        if role == "row":
            rows_of_box.setdefault(box or node.parent, []).append(node)
        below = node if role in ("grid", "table", "rowgroup") else box
        open_ += [(kid, layout, below) for kid in reversed(node.children)]
    aria = [Group("aria_grid", box, rows, box.all(_names_column)) for box, rows in rows_of_box.items()]
    return tables + [g for g in aria + grids if len(g.rows) >= 2]


def _names_column(n: Node) -> bool:
    return n.tag == "th" or n.attrs.get("role") == "columnheader"


def _cells_of(kind: str, row: Node) -> list[Node]:
    if kind == "html_table":
        return row.tagged("td", "th")
    marked = row.all(lambda n: n.tag in ("td", "th") or n.attrs.get("role") in ("columnheader", "gridcell", "cell"))
    return marked if len(marked) >= 2 else [k for k in row.children if k.tag not in ("script", "style", "noscript")]


def _read(group: Group):
    """(names, rows of values) of a group. Grids name their columns by marked cells, of which rows are no data, or by their first row;
    only the first line of a grid's cell counts. Missing tokens and missing cells are null."""
    table = group.kind == "html_table"
    show = (lambda n: n.text()) if table else (lambda n: n.text().split("\n")[0].strip())
    rows = [cells for cells in (_cells_of(group.kind, r) for r in group.rows) if cells]
    names = group.names
    if not table and len(names) >= 2:
        rows = [cells for cells in rows if not all(map(_names_column, cells))]
    elif not table and rows:
        names, *rows = rows
    blank = "Column_" if table else "Col_"
    labels = [show(n) or f"{blank}{i}" for i, n in enumerate(names, start=1)]
    shown = [[show(c) for c in cells[:len(labels)]] for cells in rows]
    values = [[None if v.lower() in CELL_NULLS else v for v in line] + [None] * (len(labels) - len(line)) for line in shown]
    return labels, values if len(labels) >= (1 if table else 2) else []


def _page_tables(html: str):
    """(kind, title, cells, rows with data, columns) of every table that has data; div grids equal in title and size count once."""
    root = parse(html)
    before = _headings(root)
    out, seen = [], set()
    for group in _groups(root):
        names, rows = _read(group)
        full = [any(v is not None for v in line) for line in rows]
        if not any(full):
            continue
        title = next(filter(None, _titles(group, before)))
        if group.kind == "div_grid" and ((title, sum(full)) in seen or seen.add((title, sum(full)))):
            continue
        cells = [(i, j, n, v, full[i]) for i, line in enumerate(rows) for j, (n, v) in enumerate(zip(names, line))]
        out.append((group.kind, title, cells, sum(full), len(names)))
    return out


def _numbered_tables(html: str):
    """The tables of a page with their number among those of their kind."""
    places: dict[str, count] = {}
    return [(kind, next(places.setdefault(kind, count())), *rest) for kind, *rest in _page_tables(html)]


def element_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, kind, table_idx, title, rows, cols`` of HTML tables, ARIA grids and div grids, one row for each."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, kind, i, title, n, width) for page, html in zip(batch["page_id"], batch["html"])
                for kind, i, title, _, n, width in _numbered_tables(html)]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "table_idx", "title", "rows", "cols"])

    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), text(html_col).alias("html"))
    return source.mapInPandas(scan, "page_id bigint, kind string, table_idx int, title string, rows bigint, cols bigint")


def element_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cells of HTML tables, ARIA grids and div grids, including rows without data."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in CELL_SCHEMA.split(", ")]
        rows: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                for kind, i, title, cells, _, _ in _numbered_tables(html):
                    rows += [(page, kind, i, title, *cell) for cell in cells]
                if len(rows) > OUTPUT_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), text(html_col).alias("html"))
    return source.mapInPandas(scan, CELL_SCHEMA)


def extract_cells(pages: DataFrame, kind: str, **names) -> DataFrame:
    """Kept cells of one element-based kind."""
    return element_cells(pages, **names).filter((F.col("kind") == kind) & F.col("row_has_data")).drop("row_has_data")


def table_summary(cells: DataFrame) -> DataFrame:
    """``rows, cols, missing, duplicates`` per table; missing cells of dropped rows count too."""
    keys = ["page_id", "kind", "table_idx", "title"]
    per_row = cells.groupBy(*keys, "row_idx").agg(
        F.first("row_has_data").alias("kept"), F.count(F.lit(1)).alias("cols"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("sig"),  # one row of one table
    )
    per_sig = per_row.groupBy(*keys, "kept", "sig").agg(
        F.count(F.lit(1)).alias("n"), F.max("cols").alias("cols"), F.sum("missing").alias("missing"))
    return per_sig.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("rows"),
        F.max("cols").alias("cols"),
        F.sum("missing").alias("missing"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def json_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Embedded JSON arrays of two or more objects with two or more keys: one row per cell."""
    scripts = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.posexplode(F.regexp_extract_all(html_col, F.lit(RX_JSON_SCRIPT), F.lit(1))).alias("table_idx", "body"))
    arrays = scripts.filter(F.trim("body").startswith("[")).select(
        "page_id", "table_idx", F.from_json("body", "array<map<string,string>>").alias("rows"))
    usable = arrays.filter((F.size("rows") >= 2) & (F.size(F.col("rows")[0]) >= 2))
    each = usable.select("page_id", "table_idx", F.posexplode("rows").alias("row_idx", "row"))
    return each.select("page_id", "table_idx", "row_idx", F.explode("row").alias("header", "value"))


def _html_text(c) -> Column:
    """Entities and tags of a text block resolved."""
    plain = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def split_fields(line: Column, delimiter: Column) -> Column:
    """Fields of one delimited line with quotes and doubled quotes resolved."""
    def fields(d):
        escaped = "\\|" if d == "|" else d
        pattern = escaped + '\\s*("[^"]*(?:""[^"]*)*"|[^' + escaped + "]*)"
        return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(pattern), F.lit(1))

    chosen = None
    for d in DELIMITERS:
        chosen = F.when(delimiter == d, fields(d)) if chosen is None else chosen.when(delimiter == d, fields(d))
    quoted = r'^\s*"|"\s*$'
    return F.transform(chosen, lambda f: F.trim(F.when(
        f.rlike(r'^\s*"'), F.replace(F.regexp_replace(f, quoted, ""), F.lit('""'), F.lit('"'))).otherwise(f)))


def _steady_delimiter(head: Column) -> Column:
    """Delimiter with the steadiest field count over the first lines: 100 for equal widths plus the mean."""
    def judged(d):
        widths = F.transform(head, lambda line: F.length(line) - F.length(F.replace(line, d, F.lit(""))) + 1)

        def score(w):
            steady = F.when(F.array_min(w) == F.array_max(w), 100.0).otherwise(0.0)
            mean = F.aggregate(w, F.lit(0), lambda acc, x: acc + x) / F.size(w)
            return F.when(F.get(w, F.lit(0)) > 1, steady + mean).otherwise(-1.0)

        # The one-element array evaluates the widths once for the several uses.
        return F.transform(F.array(widths), score)[0]

    options = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    ranked = F.transform(options, lambda o: F.struct(judged(o["d"]).alias("score"), o["place"].alias("place"), o["d"].alias("d")))
    return F.transform(F.array(F.array_max(ranked)), lambda best: F.when(best["score"] > 1, best["d"]))[0]


def pre_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_chars: int = 20) -> DataFrame:
    """Delimited text of ``<pre>`` blocks: one row per cell, null tokens read as missing.

    Each step feeds the next through a column used once, and blocks that hold no table vanish in the
    explode: a filter would be pushed down and repeat the whole chain of expressions.
    """
    blocks = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.posexplode(F.regexp_extract_all(html_col, F.lit(RX_PRE), F.lit(1))).alias("table_idx", "raw"))
    bodies = blocks.select("page_id", "table_idx", _html_text(F.col("raw")).alias("body"))
    broken = F.filter(F.split("body", r"\r?\n"), lambda x: F.trim(x) != "")
    lines = bodies.select("page_id", "table_idx", F.when(F.length("body") > min_chars, broken).alias("lines"))
    judged = lines.select("page_id", "table_idx", "lines", _steady_delimiter(F.slice("lines", 1, 5)).alias("delimiter"))
    ready = judged.select(
        "page_id", "table_idx", "delimiter", split_fields(F.try_element_at("lines", F.lit(1)), F.col("delimiter")).alias("headers"),
        F.when(F.col("delimiter").isNotNull(), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("data"))
    rows = ready.select("page_id", "table_idx", "delimiter", "headers", F.posexplode("data").alias("row_idx", "line"))
    parts = rows.select("page_id", "table_idx", "row_idx", "headers", split_fields(F.col("line"), F.col("delimiter")).alias("parts"))
    cells = parts.select("page_id", "table_idx", "row_idx", "parts", F.posexplode("headers").alias("col_idx", "header"))
    found = F.get("parts", F.col("col_idx"))
    value = F.when(~found.isin("", "null", "NULL", "N/A", "n/a"), found)
    name = F.when(F.col("header") == "", F.concat(F.lit("Col_"), (F.col("col_idx") + 1).cast("string"))).otherwise(F.col("header"))
    return cells.select("page_id", "table_idx", "row_idx", "col_idx", name.alias("header"), value.alias("value"))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Every table of every page with its size; a grid of the same shape as an earlier find is dropped."""
    elements = element_tables(pages)

    def shaped(cells, kind, name):
        filled = cells.groupBy("page_id", "table_idx", "row_idx").agg(
            F.count(F.lit(1)).alias("cols"), F.count("value").alias("filled")).filter("filled > 0")
        sizes = filled.groupBy("page_id", "table_idx").agg(F.count(F.lit(1)).alias("rows"), F.max("cols").alias("cols"))
        label = F.concat(F.lit(name), (F.col("table_idx") + 1).cast("string"))
        return sizes.select("page_id", F.lit(kind).alias("kind"), "table_idx", label.alias("title"), "rows", "cols")

    every = elements.unionByName(shaped(json_rows(pages), "json_array", "Embedded JSON Dataset #")).unionByName(
        shaped(pre_rows(pages), "csv_text", "Raw Delimited File #"))
    order = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[F.col("kind")]
    ranked = every.withColumn("priority", order)
    same_shape = Window.partitionBy("page_id", "rows", "cols").orderBy("priority", "table_idx")  # within one page
    first = F.row_number().over(same_shape) == 1
    kept = ranked.withColumn("first", first).filter(F.col("first") | ~F.col("kind").isin("aria_grid", "div_grid"))
    return kept.select("page_id", "kind", "table_idx", "title", "rows", "cols").orderBy(
        F.desc("rows"), "page_id", "kind", "table_idx")


def dataset_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Column names listed in page text and the Dataset metadata of JSON-LD blocks."""
    body = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    plain = _html_text(F.regexp_replace(body, r"(?i)<(br|/p|/div|/li|/tr)[^>]*>", "\n"))
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(RX_LD_SCRIPT), F.lit(1))
    data = F.get(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "Dataset"), F.lit(0))
    listed = F.array_distinct(F.regexp_extract_all(plain, F.lit(RX_LISTED_COLUMN), F.lit(1)))
    out = pages.select(F.col(id_col).cast("bigint").alias("page_id"), listed.alias("listed"), data.alias("ld"))
    records = F.regexp_extract(F.get_json_object("ld", "$.description"), RX_RECORDS, 1)
    return out.select(
        "page_id",
        F.when(F.size("listed") >= 2, F.col("listed")).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.get_json_object("ld", "$.name").alias("name"),
        F.get_json_object("ld", "$.distribution[0].contentUrl").alias("download_url"),
        F.regexp_replace(F.when(records != "", records), ",", "").try_cast("bigint").alias("records"),
    )
