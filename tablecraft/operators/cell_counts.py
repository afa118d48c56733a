"""Counts of the distinct cells of many columns, with cells known by a 128-bit digest: no cell's text is shuffled.

What a rule wants to know of a cell (its type, its number, whether it has outer blanks) is worked out where the cell is read
and travels beside the digest. The few texts of a result, such as the most frequent cells, are looked up by digest at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions import cells
from tablecraft.session import materialize

# Bytes of a cell that are compared at once when cells of equal count are put in order.
HEAD = 16


def digest(text: Column | str) -> Column:
    """128 bits of a text; null stays null."""
    return F.unhex(F.md5(text))


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``place, value``: every cell as text under the place of its column.

    ``inline`` rather than ``unpivot``: an Expand fused with long expressions over its output is
    refused by Spark's code generator and would run interpreted.
    """
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), cells.text(c).alias("value")) for i, c in enumerate(names)])))


def _named(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col("place") + 1).alias("column")


def distinct_cells(df: DataFrame, columns: Sequence[str] | None = None, **facts: Column) -> DataFrame:
    """``column, cell, n`` and the facts: each column's distinct cells by digest (null for a null cell) with their number of rows.

    Facts are expressions over ``value``, the cell as text, and must be narrow. A fact named ``cell`` takes the place of the
    digest of the whole text, for rules that do not tell all texts apart.
    """
    names = list(columns if columns is not None else df.columns)
    known = {"cell": digest("value")} | facts
    long = _cells(df, names).select("place", *[c.alias(name) for name, c in known.items()])
    counted = long.groupBy("place", *known).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_named(names), *known, "n")


def _by_place(rows: Sequence) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["place"], []).append(r)
    return out


def top_cells(df: DataFrame, columns: Sequence[str], k: int = 1, shape: Callable[[Column], Column] = lambda value: value) -> DataFrame:
    """``column, rank, value, n, total``: the k most frequent cells of each column, ties by the smaller text; exact.

    ``shape`` gives the text that counts for a cell, null to leave it out; ``total`` is the number of cells counted.
    Counts come from digests. Cells of the count at which the list is cut are put in order by their first bytes, 16 at a time:
    while the cut falls inside a group of equal beginnings, that group alone is read again for its next bytes. The driver
    holds k and a few digests of each column, and the texts of the result.
    """
    names = list(columns)
    spark = df.sparkSession
    schema = "column string, rank int, value string, n bigint, total bigint"
    if not names:
        return spark.createDataFrame([], schema)
    long = _cells(df, names).select("place", shape(F.col("value")).alias("value")).where("value IS NOT NULL")
    bytes_ = F.col("value").cast("binary")

    def heads(offset: int) -> Column:
        return F.substring(bytes_, offset + 1, HEAD).alias("head")

    counts = materialize(long.groupBy("place", digest("value").alias("cell"), heads(0)).agg(F.count(F.lit(1)).alias("n")), once=True)
    totals = {r["place"]: r["n"] for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    by_count = Window.partitionBy("place").orderBy(F.desc("n"))
    first = _by_place(counts.select("place", "cell", "n", F.row_number().over(by_count).alias("at")).where(F.col("at") <= k).collect())
    cut = {p: min(r["n"] for r in rows) for p, rows in first.items()}
    chosen = {p: [(bytes(r["cell"]), r["n"]) for r in rows if r["n"] > cut[p]] for p, rows in first.items()}
    wanted = {p: len(rows) - len(chosen[p]) for p, rows in first.items()}
    prefix, offset, groups = dict.fromkeys(wanted, b""), 0, counts
    while wanted:
        at_cut = F.create_map(*[F.lit(x) for p in wanted for x in (p, cut[p])])
        order = Window.partitionBy("place").orderBy("head", "cell")
        most = max(wanted.values())
        tied = groups.where(F.col("n") == at_cut[F.col("place")]).select("place", "cell", "head", F.row_number().over(order).alias("at"))
        open_: dict[int, int] = {}
        for p, rows in _by_place(tied.where(F.col("at") <= most + 1).collect()).items():
            need, rows = wanted[p], sorted(rows, key=lambda r: r["at"])
            if len(rows) > need and rows[need]["head"] == rows[need - 1]["head"]:  # the cut lies between cells of equal beginnings
                head = bytes(rows[need - 1]["head"])
                rows = [r for r in rows[:need] if bytes(r["head"]) != head]
                open_[p], prefix[p] = need - len(rows), prefix[p] + head
            chosen[p] += [(bytes(r["cell"]), cut[p]) for r in rows[:need]]
        wanted, offset = open_, offset + HEAD
        if wanted:
            begins = F.create_map(*[x for p in wanted for x in (F.lit(p), F.lit(bytearray(prefix[p])))])
            inside = F.substring(bytes_, 1, offset) == begins[F.col("place")]
            groups = long.where(inside).groupBy("place", digest("value").alias("cell"), heads(offset)).agg(F.count(F.lit(1)).alias("n"))
    found = [(p, bytearray(cell)) for p, cells_ in chosen.items() for cell, _ in cells_]
    if not found:
        return spark.createDataFrame([], schema)
    asked = spark.createDataFrame(found, "place int, cell binary")
    texts = long.withColumn("cell", digest("value")).join(F.broadcast(asked), ["place", "cell"], "left_semi")
    numbers = {(p, cell): n for p, cells_ in chosen.items() for cell, n in cells_}
    ranked: dict[int, list] = {}
    for r in texts.groupBy("place", "cell").agg(F.min("value").alias("value")).collect():
        ranked.setdefault(r["place"], []).append((-numbers[r["place"], bytes(r["cell"])], r["value"].encode()))
    rows = [(names[p], i, text.decode(), -n, totals[p]) for p, cells_ in ranked.items() for i, (n, text) in enumerate(sorted(cells_), 1)]
    return spark.createDataFrame(rows, schema)
