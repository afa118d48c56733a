"""Records of delimited files whose quoted cells hold line breaks, read by many tasks.

A file is split anywhere. Whether a split begins inside a quoted cell follows from the number of quotes in all splits before it,
so one pass counts quotes by split, a running sum gives each split its state, and a second pass cuts every split into records
by itself. Only records that lie over a border of splits are put together afterwards, at most one for each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Kinds of pieces: a whole record, the end of one from an earlier split, the begin of one that goes on, the inside of one.
WHOLE, END, BEGIN, INSIDE = range(4)
PIECES = "file string, block long, seq long, kind int, value string"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, block, quotes``: every line with its split and whether its number of quotes is odd."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (quotes % 2 == 1).alias("odd"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of records of the splits of one task; lines of a split come in order and may lie in several batches."""
    split = None  # (file, block)
    inside, seq, held = False, 0, []  # held: lines of the open record; inside: whether its last line ends within a cell
    begun = True  # whether the open record began in this split

    def piece(last: bool):
        nonlocal seq
        kind = (BEGIN if inside and last else WHOLE) if begun else (INSIDE if inside and last else END)
        seq += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]]), pa.array([split[1]]), pa.array([seq - 1]), pa.array([kind], pa.int32()), pa.array(["\n".join(held)])],
            ["file", "block", "seq", "kind", "value"])

    for batch in batches:
        values, files, blocks, odds, starts = (batch.column(i) for i in range(5))
        n = batch.num_rows
        names, places = files.dictionary_encode(), np.asarray(blocks)
        number = names.indices.to_numpy()
        new = np.ones(n, bool)
        new[1:] = (number[1:] != number[:-1]) | (places[1:] != places[:-1])
        edges = [*np.flatnonzero(new).tolist(), n] if n else []
        for a, b in zip(edges, edges[1:]):
            here = (names.dictionary[int(number[a])].as_py(), int(places[a]))
            if here != split:
                if held:
                    yield piece(True)
                split, seq, held, inside = here, 0, [], starts[a].as_py()
                begun = not inside
            odd = np.asarray(odds.slice(a, b - a)).astype(np.int64)
            before = (int(inside) + np.cumsum(odd) - odd) % 2
            first = np.flatnonzero(before == 0)  # lines at which a record begins
            after = bool((before[-1] + odd[-1]) % 2)
            part = values.slice(a, b - a)
            if not len(first):
                held, inside = held + part.to_pylist(), after
                continue
            held += part.slice(0, int(first[0])).to_pylist()
            if held:
                inside = False
                yield piece(False)
            begun = True
            cuts = pa.array(first.astype(np.int32))  # the last record stays open until the next line is known
            if len(first) > 1:
                records = pc.binary_join(pa.ListArray.from_arrays(cuts, part), "\n")
                m = len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split[0]] * m), pa.array(np.full(m, split[1])), pa.array(np.arange(seq, seq + m)), pa.array(np.full(m, WHOLE, np.int32)), records],
                    ["file", "block", "seq", "kind", "value"])
                seq += m
            held, inside = part.slice(int(first[-1])).to_pylist(), after
    if held:
        yield piece(True)


def records(spark: SparkSession, path: str | list[str], latin: bool = False) -> DataFrame:
    """``file, block, seq, value``: every record of the files, line breaks inside quoted cells as ``\\n``; (block, seq) is its order.

    Cells are quoted by ``"`` and quotes inside are doubled. A cell that is not closed by the file's end gives one record
    of all lines from its begin. ``latin`` reads the bytes as ISO-8859-1, else as UTF-8. Empty files have no records.
    """
    lines = lines_of(spark, path)
    if latin:
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), F.lit("ISO-8859-1")))
    splits = lines.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("parity"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = splits.select("file", "block", (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    # One row for each split of the files, 128 MB apart on a cluster; the order of lines within a split is kept.
    known = lines.join(F.broadcast(state), ["file", "block"], "left").select("value", "file", "block", "odd", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = known.mapInArrow(_pieces, PIECES)
    order = Window.partitionBy("file").orderBy("block", "seq")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("group", F.count_if(F.col("kind") == BEGIN).over(order))
    joined = parts.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.col("p.value"), "\n").alias("value"))
    return pieces.where(F.col("kind") == WHOLE).select("file", "block", "seq", "value").unionByName(joined)
