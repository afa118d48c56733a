"""Ranked lexical search over K2-treaps: quadtrees of a term-document grid whose cells hold the greatest impact inside them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.bytehash import LOWER, text_steps
from tablecraft.llm.registry import query, stored, table

# A term is a run of digits, letters and bytes of letters beyond ASCII.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
# A shard of the grid has about so much text and so many documents at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCUMENTS = 8 << 20, 1 << 16
# Cells that are opened together, and values (cells x terms) that an opened front may hold.
FRONT, FRONT_VALUES = 96, 1 << 22
# Text of the items that are searched together; their terms go to all tasks.
ITEM_BYTES = 4 << 20
BEST = 50
LAST = np.iinfo(np.int64).max
SHARDS = "ids binary, known binary, terms binary, ends binary, held binary, levels binary, bits binary, less binary"
FOUND = "item int, doc_id long, score long"
_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def _packed(values: np.ndarray, kind) -> bytes:
    """Numbers as bytes, their length in front and compressed, so that the rows of the index stay small outside of Python too."""
    raw = np.ascontiguousarray(values.astype(kind)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd"), kind)


def _terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of a text column in order, A-Z lower-cased, and the number of terms of each text."""
    chunks, counts = [pa.array([], pa.large_string()).dictionary_encode()], [np.zeros(0, np.int64)]
    for _, _, data, bounds in text_steps(texts):
        solid = IN_TERM[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        start = np.flatnonzero(begins)
        before = np.concatenate([[0], np.cumsum(solid)])  # terms close up when the bytes between them go
        offsets = np.append(before[start], before[-1])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[solid]])]
        chunks.append(pa.Array.from_buffers(pa.large_string(), len(start), buffers).dictionary_encode())
        counts.append(np.diff(np.searchsorted(start, bounds)))
    joined = pa.chunked_array(chunks).unify_dictionaries().combine_chunks()
    return (joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined), np.concatenate(counts)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for _, _, data, bounds in text_steps(batch.column(0)):
            solid = IN_TERM[data]
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[bounds] = True
            solid[1:] &= ~solid[:-1] | edge[1:-1]
            n = np.diff(np.searchsorted(np.flatnonzero(solid), bounds))
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


def _build(ids: pa.Array, texts: pa.Array, documents: int, words: int) -> list:
    """One shard as a row of SHARDS. Documents stand in order of their id (none last); columns of the grid are their places.

    Rows are the terms in order. A cell of level j has 2^j rows and 2^j columns. Cells of a level are in quadtree order, so
    the children of a cell stand together; ``bits`` tells which of its quarters have a child, ``less`` by how much the
    greatest impact of a cell is below that of the cell above. Levels above the documents' width have one column of cells,
    which would bound all documents alike, so the highest kept level is the one where the whole width is one cell.
    """
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found, n = _terms(texts)
    names = found.dictionary
    by_name = pc.sort_indices(names).to_numpy()
    row_of = np.empty(len(by_name), np.int64)
    row_of[by_name] = np.arange(len(by_name))
    width = max(1, len(order))
    cells, tf = np.unique(row_of[found.indices.to_numpy()] * width + np.repeat(place, n), return_counts=True)
    row, column = cells // width, cells % width
    length = np.zeros(width, np.int64)
    length[place] = n
    m = 50 + 50 * length * documents // max(words, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[column])
    top = int(width - 1).bit_length()
    code = row >> top
    for level in range(top - 1, -1, -1):
        code = code << 2 | (row >> level & 1) << 1 | column >> level & 1
    by_code = np.argsort(code)
    code, value = code[by_code], impact[by_code]
    bits, values = [], [value]
    for _ in range(top):
        quarter = np.left_shift(1, code & 3).astype(np.uint8)
        code = code >> 2
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        code = code[edge]
        bits.append(np.add.reduceat(quarter, edge) if len(edge) else quarter)
        values.append(np.maximum.reduceat(values[-1], edge) if len(edge) else values[-1])
    bits, values = bits[::-1], values[::-1]
    less = [values[0], *(np.repeat(above, _ONES[b]) - below for above, b, below in zip(values, bits, values[1:]))]
    names = names.take(pa.array(by_name))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string())), "")[0].as_py() if len(names) else ""
    known = np.asarray(ids.is_valid())[order]
    ends = np.cumsum(np.asarray(pc.binary_length(names)).astype(np.int64))
    return [_packed(np.asarray(pc.fill_null(ids, LAST))[order], np.int64), _packed(known, np.uint8),
            _packed(np.frombuffer(joined.encode(), np.uint8), np.uint8), _packed(ends, np.int32),
            _packed(np.bincount(row, minlength=len(names)), np.int32), _packed(np.array([len(v) for v in values]), np.int64),
            _packed(np.concatenate([np.zeros(0, np.uint8), *bits]), np.uint8), _packed(np.concatenate(less), np.int32)]


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def build_index(documents: DataFrame) -> DataFrame:
    """The stored index of ``documents(doc_id, text)``: one row for each shard, every document in one of them.

    The number of documents with a term and the number of all terms are counted first, over the whole table, as impacts
    depend on them. Shards are made from the rows of one task each, so texts are not shuffled; their sizes are bounded.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    sizes = documents.select("text").mapInArrow(_sizes, "documents long, terms long")
    size = sizes.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    n, words = size["documents"], size["terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, length = [], 0, 0

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            made = _build(whole.column(0), whole.column(1), n, words)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], _names(SHARDS))

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            first = 0
            while first < batch.num_rows:
                fits = int(np.searchsorted(np.cumsum(sizes[first:]), SHARD_BYTES - length, side="right"))
                fits = min(fits, SHARD_DOCUMENTS - count, batch.num_rows - first)
                if fits == 0 and held:
                    yield shard()
                    held, count, length = [], 0, 0
                    continue
                fits = max(fits, 1)
                held.append(batch.slice(first, fits))
                count, length, first = count + fits, length + int(sizes[first:first + fits].sum()), first + fits
        if held:
            yield shard()

    index = stored(documents.mapInArrow(run, SHARDS), "none")
    return index.withColumns({"documents": F.lit(n).cast("long"), "words": F.lit(words).cast("long")})


class Shard:
    """One K2-treap, read for searching."""

    def __init__(self, row: dict):
        self.ids, self.known = _unpacked(row["ids"], np.int64), _unpacked(row["known"], np.uint8)
        self.terms = term_array(row["terms"], row["ends"])
        sizes = _unpacked(row["levels"], np.int64)
        self.top = len(sizes) - 1
        self.bits, self.less = _unpacked(row["bits"], np.uint8), _unpacked(row["less"], np.int32)
        # A cell's children stand behind those of all cells before it, and the levels stand one after another.
        ones = _ONES[self.bits].astype(np.int32)
        self.first = np.cumsum(ones, dtype=np.int32) - ones + np.int32(sizes[0])

    def rows(self, terms: pa.Array) -> np.ndarray:
        """Row of each term, -1 for those that no document of the shard has."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _open(self, level: np.ndarray, column: np.ndarray, cells: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple:
        """Both halves of each document range: on each term's path its child cell there (-1 if empty) and that cell's maximum."""
        below = level - 1
        row_bit = rows[None, :] >> below[:, None] & 1
        held = np.where(cells >= 0, self.bits[cells], 0)
        first = self.first[cells]
        opened = []
        for half in (0, 1):
            quarter = row_bit * 2 + half
            there = held >> quarter & 1 == 1
            child = np.where(there, first + _ONES[held & ((1 << quarter) - 1)], -1)
            opened.append((below, column * 2 + half, child, np.where(there, values - self.less[child], 0)))
        return tuple(np.concatenate(x) for x in zip(*opened))

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the documents of greatest score into ``best``; the number of opened ranges.

        The paths of all rows go down together. A front of document ranges, each with one cell for every row, is bounded by
        the weighted sum of its cells' maxima; the front of greatest bound is opened next, ranges that cannot enter the best
        are left out, and the search ends when no front is left. A range of one document has its score as its bound.
        """
        root = rows >> self.top
        values = self.less[root].astype(np.int64)[None, :]
        if self.top == 0:
            best.add((values @ weights), np.zeros(1, np.int64), self)
            return 1
        size = max(1, min(FRONT, FRONT_VALUES // len(rows) // 4))
        fronts = [(-int((values @ weights)[0]), 0, (np.array([self.top]), np.zeros(1, np.int64), root[None, :], values))]
        made = opened = 0
        while fronts:
            bound, _, (level, column, cells, values) = heapq.heappop(fronts)
            keep = best.may_enter(values @ weights, column << level, self)
            if not keep.any():
                continue
            opened += int(keep.sum())
            level, column, cells, values = self._open(level[keep], column[keep], cells[keep], values[keep], rows)
            bounds = values @ weights
            leaf = level == 0
            if leaf.any():
                best.add(bounds[leaf], column[leaf], self)
            keep = np.flatnonzero(~leaf & best.may_enter(bounds, column << level, self))
            keep = keep[np.argsort(-bounds[keep], kind="stable")]
            for i in range(0, len(keep), size):
                part = keep[i:i + size]
                made += 1
                heapq.heappush(fronts, (-int(bounds[part[0]]), made, (level[part], column[part], cells[part], values[part])))
        return opened


def term_array(terms: bytes, ends: bytes) -> pa.Array:
    offsets = np.concatenate([[0], _unpacked(ends, np.int32)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_unpacked(terms, np.uint8))])


class Best:
    """The documents of greatest score of one item so far: ties go to the smaller id, those without id last. ``floor`` is a score
    that so many documents are known to reach somewhere; less cannot enter."""

    def __init__(self, limit: int, floor: int):
        self.limit, self.floor = limit, max(floor, 1)
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _full(self) -> bool:
        return len(self.scores) >= self.limit and int(self.scores[-1]) >= self.floor

    def may_enter(self, bounds: np.ndarray, first: np.ndarray, shard: Shard) -> np.ndarray:
        """Whether ranges that begin at the places ``first`` and have such bounds can hold one of the best."""
        if not self._full():
            return bounds >= self.floor
        least, last = int(self.scores[-1]), int(self.ids[-1])
        inside = first < len(shard.ids)
        return (bounds > least) | ((bounds == least) & (shard.ids[np.where(inside, first, 0)] < last) & inside)

    def add(self, scores: np.ndarray, places: np.ndarray, shard: Shard) -> None:
        keep = self.may_enter(scores, places, shard)
        scores = np.concatenate([self.scores, scores[keep]])
        ids, known = np.concatenate([self.ids, shard.ids[places[keep]]]), np.concatenate([self.known, shard.known[places[keep]]])
        order = np.lexsort([ids, -scores])[:self.limit]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Distinct rows (item_id, text) of the query set, some megabytes of text at a time; the driver holds one block."""
    block, size = [], 0
    for row in items.toLocalIterator():
        length = len(row["text"].encode())
        if block and size + length > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += length
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, limit: int = BEST) -> DataFrame:
    """For each distinct row of ``items(item_id, text)`` its ``limit`` documents of greatest score above 0, fewer if there are fewer:
    item_id, rank from 1, doc_id, score.

    The score sums weight x impact over the item's terms, once each; weight is floor(1000 ln((2N + 2) / (2 df + 1))). Equal
    scores go by ascending doc_id, none last. Items without text or terms have no rows; rows of one id with other texts are
    items of their own; repeated documents are ranked each. Items are taken in blocks of bounded size; in each shard the
    paths of an item's rows go down the grid together, and every task hands on its best only.
    """
    spark = index.sparkSession
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    id_type, out = items.schema["item_id"].dataType.simpleString(), None
    for block in _item_blocks(items.orderBy("item_id", "text")):
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {id_type}")
        found = _search_block(spark, index, block, limit).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long") if out is None else out


def _search_block(spark: SparkSession, index: DataFrame, block: list, limit: int) -> DataFrame:
    """Ranked documents of the items of one block: item (place in the block), rank, doc_id, score."""
    found, n = _terms(pa.array([text for _, text in block], pa.large_string()))
    terms = found.dictionary.cast(pa.string())
    cuts = np.concatenate([[0], np.cumsum(n)])
    wanted = [np.unique(found.indices.to_numpy()[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    asked = spark.sparkContext.broadcast(terms)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = pc.index_in(asked.value, value_set=term_array(row["terms"], row["ends"]))
                there = np.asarray(at.is_valid())
                total[there] += _unpacked(row["held"], np.int32)[at.drop_null().to_numpy(zero_copy_only=False)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    df = np.zeros(len(terms), np.int64)
    for row in index.select("terms", "ends", "held").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[row["term"]] = row["n"]
    size = index.select("documents").first()
    documents = size["documents"] if size else 0
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    shared = spark.sparkContext.broadcast((terms, wanted, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, wanted, weight = shared.value
        best = [Best(limit, 0) for _ in wanted]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                row_of = shard.rows(terms)
                for mine, own in zip(best, wanted):
                    own = own[(row_of[own] >= 0) & (weight[own] > 0)]
                    if len(own):
                        shard.search(row_of[own], weight[own], mine)
        for item, mine in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(mine.scores), item, np.int32)), pa.array(mine.ids, mask=mine.known == 0), pa.array(mine.scores)], _names(FOUND))

    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return index.drop("documents", "words").mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)


SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM split),
held AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM split) AS t GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, sizes GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), sizes GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) AS r
WHERE rank <= 50
"""


@query("op12_k2_treap", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return search(build_index(table(spark, sf_dir, "documents")), items)
