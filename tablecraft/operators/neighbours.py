"""Exact k-nearest neighbours, and pairs within a distance by locality-sensitive hashing.

Training rows counted to be few (``SHIPPED_VALUES`` numbers in all, 32 MB) are sent to every task once and each row is
scored where it is, without a shuffle. More training rows are cut into blocks of ``BLOCK_VALUES`` numbers: a task holds one block and
the rows to score stream by, so that each row's k nearest of a block are all that leaves it. That is exact but quadratic, so for
large training sets fit on a sample, or take ``approximate_neighbours``.

Distances are told roughly by a product of matrices first; only what may be near by the bound of its rounding is measured.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 4000
BLOCK_VALUES = 2_000_000
SHIPPED_VALUES = 4_000_000
EPSILON = 1e-5
# Rows and points of one product of matrices, and pairs that are measured or sent at once.
TILE_ROWS, TILE_POINTS = 128, 2048
PAIRS = 100_000


def _closest(points: np.ndarray, ids: np.ndarray, vec: np.ndarray, k: int, own) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest points, ties by id, without the row's own id if given."""
    d = np.sqrt(((points - vec) ** 2).sum(axis=1))
    if own is not None:
        d = np.where(ids == own, np.inf, d)
    # Everything as near as the k-th, so that ties are settled by key.
    cut = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
    near = np.flatnonzero((d <= cut) & np.isfinite(d))
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return near, d[near]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows; all of one length, none null. Null numbers are NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not len(vectors):
        return np.zeros((0, 1))
    sizes = pc.list_value_length(vectors)
    if sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("all vectors must have the same length, and none may be null")
    return flat.reshape(len(vectors), -1)


class Block:
    """Points with their keys and what a product of matrices needs to tell distances from them.

    A point with a number that is not finite is near nothing and left out. ``order`` is the place of a key among all, equal for equal keys.
    """

    def __init__(self, keys: pa.Array, vectors: pa.Array, *others: pa.Array):
        points = _matrix(vectors)
        whole = np.flatnonzero(np.isfinite(points).all(axis=1))
        self.points = points[whole]
        self.keys, *self.others = [x.take(pa.array(whole)) for x in (keys, *others)]
        self.order = np.asarray(pc.rank(self.keys, tiebreaker="dense")).astype(np.int64)
        self.distinct = self.keys.unique()
        # The order number of each distinct key; nulls equal each other only where the key is no number.
        self.number = np.zeros(len(self.distinct), np.int64)
        self.number[np.asarray(pc.index_in(self.keys, value_set=self.distinct))] = self.order
        with np.errstate(over="ignore"):
            squares = np.einsum("ij,ij->i", self.points, self.points)
        self.most = squares.max(initial=0.0)
        # A row (x, 1) times this is x * p - |p|^2 / 2, which falls as the distance grows.
        self.product = np.vstack([self.points.T, -squares / 2])

    def __len__(self) -> int:
        return len(self.points)

    def own(self, keys: pa.Array) -> np.ndarray:
        """The order numbers of other rows' keys, -1 for keys that the block does not have."""
        at = pc.index_in(keys.cast(self.keys.type), value_set=self.distinct, skip_nulls=pa.types.is_primitive(self.keys.type))
        if not len(self.number):
            return np.full(len(keys), -1)
        at = np.asarray(at.fill_null(-1))
        return np.where(at < 0, -1, self.number[at])

    def rows(self, vecs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of rows: place of the first, the rows with a 1 behind, their squares, a bound of the products' rounding, and whether it is finite."""
        for first in range(0, len(vecs), TILE_ROWS):
            some = vecs[first:first + TILE_ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                squares = np.einsum("ij,ij->i", some, some)
                slack = 8 * (some.shape[1] + 8) * np.finfo(float).eps * (squares + self.most)
            yield first, np.hstack([some, np.ones((len(some), 1))]), squares, slack, np.isfinite(slack)

    def tiles(self, rows: np.ndarray, at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        for start in range(at, len(self), TILE_POINTS):
            yield start, rows @ self.product[:, start:start + TILE_POINTS]

    def nearest(self, vecs: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, rank, place, distance)`` of the k nearest points of every row, as ``_closest`` gives them."""
        out = [(np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, int), np.zeros(0))]

        def told(row: int, near: np.ndarray, d: np.ndarray) -> None:
            out.append((np.full(len(near), row), np.arange(1, len(near) + 1, dtype=np.int32), near, d))

        order = np.argsort(self.order[:TILE_POINTS], kind="stable")
        sorted_own = self.order[:TILE_POINTS][order]
        for first, rows, _, slack, sure in self.rows(vecs) if len(self) else ():
            mine = None if own is None else own[first:first + len(rows)]
            for i in np.flatnonzero(~sure & np.isfinite(rows).all(axis=1)):  # squares beyond the greatest number
                told(first + i, *_closest(self.points, self.order, rows[i, :-1], k, None if mine is None else mine[i]))
            if not sure.any():
                continue
            back = np.flatnonzero(sure)
            rows, slack, mine = rows[sure], slack[sure], None if mine is None else mine[sure]
            _, start = next(self.tiles(rows))
            open_ = start
            if mine is not None:
                low, high = np.searchsorted(sorted_own, mine, "left"), np.searchsorted(sorted_own, mine, "right")
                who = np.repeat(np.arange(len(rows)), high - low)
                place = np.arange(len(who)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                open_ = start.copy()
                open_[who, order[place]] = -np.inf
            least = np.full(len(rows), -np.inf)
            if open_.shape[1] >= k:  # the k-th nearest of some points is no nearer than that of all
                least = np.partition(open_, -k, axis=1)[:, -k] - slack
            hits = []
            for at, rough in ((0, start), *self.tiles(rows, TILE_POINTS)):
                hit = np.flatnonzero(rough >= least[:, None])
                hits.append((hit // rough.shape[1], hit % rough.shape[1] + at))
            row, place = (np.concatenate(x) for x in zip(*hits))
            if mine is not None:
                other = self.order[place] != mine[row]
                row, place = row[other], place[other]
            if len(row) > PAIRS:  # many points as near as each other: row by row
                by = np.argsort(row, kind="stable")
                for i, some in zip(range(len(rows)), np.split(place[by], np.searchsorted(row[by], np.arange(1, len(rows))))):
                    if len(some):
                        near, d = _closest(self.points[some], self.order[some], rows[i, :-1], k, None)
                        told(first + back[i], some[near], d)
                continue
            d = np.sqrt(((self.points[place] - rows[row, :-1]) ** 2).sum(axis=1))
            by = np.lexsort((self.order[place], d, row))
            by = by[np.isfinite(d[by])]
            row, place, d = row[by], place[by], d[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            few = rank < k
            out.append((first + back[row[few]], (rank[few] + 1).astype(np.int32), place[few], d[few]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def within(self, vecs: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
        """Rows and places of pairs that may be nearer than the threshold, and a function that measures chosen ones of them."""
        whole = np.isfinite(vecs).all(axis=1)
        for first, rows, squares, slack, sure in self.rows(vecs):
            ready = sure.all()
            with np.errstate(over="ignore", invalid="ignore"):
                for at in range(0, len(self), TILE_POINTS):
                    if ready:
                        rough = rows @ self.product[:, at:at + TILE_POINTS]
                        hit = np.flatnonzero(rough > ((squares - threshold ** 2) / 2 - slack)[:, None])
                        flat = rough.ravel()
                    else:
                        tile = self.points[at:at + TILE_POINTS]
                        hit = np.flatnonzero(np.repeat(whole[first:first + len(rows)], len(tile)))
                    width = min(TILE_POINTS, len(self) - at)
                    row, place = hit // width, hit % width + at

                    def measured(chosen: np.ndarray) -> np.ndarray:
                        r, p = row[chosen], place[chosen]
                        d = squares[r] - 2 * flat[hit[chosen]] if ready else np.full(len(r), -1.0)
                        # Where rounding counts, as near the threshold and between near points, from the differences, added up in their order.
                        some = np.flatnonzero(~((np.abs(d - threshold ** 2) > 4 * slack[r]) & (d > 0.01 * (squares[r] + self.most))))
                        for i in range(0, len(some), PAIRS):
                            j = some[i:i + PAIRS]
                            d[j] = np.cumsum((rows[r[j], :-1] - self.points[p[j]]) ** 2, axis=1)[:, -1]
                        return np.sqrt(d)

                    yield first + row, place, measured


def _vectors(df: DataFrame, vector: str) -> Column:
    """The vectors as they are if they are floats, which numbers of half the size carry whole, as doubles otherwise."""
    return F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")


def _meet(train: DataFrame, score: DataFrame, groups: int, told: Callable, schema: str) -> DataFrame:
    """Training rows and rows to score of equal ``at`` (from 0 to ``groups``), one group a task; rows to score stream by and are not held.

    ``told(block, rows)`` yields record batches; ``block`` has what ``told.block`` makes of all training rows of the group.
    """
    kinds = dict([*train.dtypes, *score.dtypes])
    fill = lambda df: df.select("at", "side", *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in sorted(kinds) if c not in ("at", "side")])
    both = fill(train.withColumn("side", F.lit(0))).unionByName(fill(score.withColumn("side", F.lit(1))))
    make, tell = told

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, block = None, [], None
        for batch in batches:
            at, side = (batch.column(c).to_numpy() for c in ("at", "side"))
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if at[a] != group:
                    group, parts, block = at[a], [], None
                if side[a] == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    if block is None:
                        held = pa.Table.from_batches(parts)
                        block, parts = make({c: held.column(c).combine_chunks() for c in held.column_names}), parts[:1]
                    yield from tell(block, batch.slice(a, b - a))

    return both.repartitionById(groups, F.col("at").cast("int")).sortWithinPartitions("at", "side").mapInArrow(scan, schema)


def _nearest_shipped(train: DataFrame, score: DataFrame, key: str, vector: str, label: str, k: int, exclude_self: bool) -> DataFrame:
    held = train.select(F.col(key).alias("tk"), F.col(label).cast("string").alias("label"), _vectors(train, vector).alias("vec")).toArrow()
    shared = score.sparkSession.sparkContext.broadcast(held)
    kind, own_kind = dict(score.dtypes)[key], dict(train.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(*[shared.value.column(c).combine_chunks() for c in ("tk", "vec", "label")])
            yield _told(block, batch, k, exclude_self)

    rows = score.select(F.col(key).alias("sk"), _vectors(score, vector).alias("vec"))
    found = rows.mapInArrow(scan, f"sk {kind}, rank int, tk {own_kind}, label string, dist double")
    return found.select(F.col("sk").alias(key), "rank", F.col("tk").alias("neighbour"), "label", "dist")


def _told(block: Block, batch: pa.RecordBatch, k: int, exclude_self: bool) -> pa.RecordBatch:
    vecs = _matrix(batch.column("vec"))
    row, rank, place, d = block.nearest(vecs, block.own(batch.column("sk")) if exclude_self else None, k)
    columns = [batch.column("sk").take(pa.array(row)), pa.array(rank), block.keys.take(pa.array(place)), block.others[0].take(pa.array(place)), pa.array(d)]
    return pa.RecordBatch.from_arrays(columns, ["sk", "rank", "tk", "label", "dist"])


def _blocks(rows: int, width: float, block_rows: int) -> int:
    """Blocks of ``block_rows``, of ``BLOCK_VALUES`` numbers where that is not given."""
    size = max(1, int(BLOCK_VALUES / max(width, 1))) if block_rows == BLOCK_ROWS else block_rows
    return max(1, math.ceil(rows / size))


def nearest(train: DataFrame, score: DataFrame, key: str, vector: str, label: str, k: int = 5,
            exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, neighbour, label, dist``: the k nearest training rows of each row; ties by neighbour key."""
    held = train.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("values"), F.count(F.lit(1)).alias("rows")).first()
    if block_rows == BLOCK_ROWS and held["values"] <= SHIPPED_VALUES:
        return _nearest_shipped(train, score, key, vector, label, k, exclude_self)
    width = held["values"] / max(held["rows"], 1)
    tb = _blocks(held["rows"], width, block_rows)
    # Rows to score need no bound; they are cut as finely as training rows, and finer where there would be too few tasks.
    tasks = 3 * train.sparkSession.sparkContext.defaultParallelism
    sb = max(_blocks(score.count(), width, block_rows), math.ceil(tasks / tb))

    def block(n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    kind = dict(score.dtypes)[key]
    a = train.select(F.col(key).cast(kind).alias("tk"), F.col(label).cast("string").alias("label"), _vectors(train, vector).alias("vec"), block(tb).alias("tb"), every(sb).alias("sb"))
    b = score.select(F.col(key).alias("sk"), _vectors(score, vector).alias("vec"), block(sb).alias("sb"), every(tb).alias("tb"))
    at = (F.col("tb") * sb + F.col("sb")).alias("at")

    def make(held: dict[str, pa.Array]) -> Block:
        return Block(held["tk"], held["vec"], held["label"])

    def tell(held: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _told(held, batch, k, exclude_self)

    found = _meet(a.select(at, "tk", "label", "vec"), b.select(at, "sk", "vec"), tb * sb, (make, tell),
                  f"sk {kind}, rank int, tk {kind}, label string, dist double").drop("rank")
    order = Window.partitionBy("sk").orderBy("dist", "tk")  # at most k per training block
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(F.col("sk").alias(key), "rank", F.col("tk").alias("neighbour"), "label", "dist")


def vote(neighbours: DataFrame, key: str) -> DataFrame:
    """Class with the largest inverse-distance weight and its share of all weights."""
    weight: Column = 1 / (F.col("dist") + EPSILON)
    per_class = neighbours.groupBy(key, "label").agg(F.sum(weight).alias("w"))
    best = per_class.groupBy(key).agg(
        F.min(F.struct((-F.round("w", 9)).alias("w"), "label")).alias("b"), F.sum("w").alias("total"), F.max("w").alias("top"))
    return best.select(key, F.col("b.label").alias("predicted"), (F.col("top") / F.col("total")).alias("confidence"))


def knn_classify(train: DataFrame, score: DataFrame, key: str, vector: str, label: str, k: int = 5,
                 exclude_self: bool = False) -> DataFrame:
    return vote(nearest(train, score, key, vector, label, k, exclude_self), key)


def approximate_neighbours(train: DataFrame, score: DataFrame, vector: str, key: str, threshold: float,
                           bucket: float = 2.0, tables: int = 3, exclude_self: bool = False, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs within ``threshold`` found by locality-sensitive hashing: faster, may miss some.

    The pairs of ``approxSimilarityJoin``, told in the first table where the two share a bucket, so that no pair passes a shuffle. Buckets of
    up to ``cell_rows`` rows meet in cells of about so many; a greater one has cells of its own, blocks of training rows by pieces of the others.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = train.sparkSession
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=42)
    vectors = lambda df: df.withColumn("_v", array_to_vector(F.col("vec").cast("array<double>")))
    chosen = lambda df: df.select(F.col(key).alias("key"), _vectors(df, vector).alias("vec"))
    model = lsh.fit(vectors(chosen(train)))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        rows = chosen(df).where("key is not null") if exclude_self else chosen(df)
        tags = F.array(*[vector_to_array(F.col("_h")[i])[0] for i in range(tables)])
        told = model.transform(vectors(rows.distinct())).select(F.col("key").alias(name), "vec", tags.alias("tags"))
        return told.select("*", F.posexplode("tags").alias("table", "bucket"))

    a, b = hashed(train, "tk"), hashed(score, "sk")
    sizes = a.select("table", "bucket", F.lit(1).alias("t"), F.lit(0).alias("s")).unionByName(
        b.select("table", "bucket", F.lit(0).alias("t"), F.lit(1).alias("s"))).groupBy("table", "bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    great = F.greatest("t", "s") > cell_rows
    total = sizes.agg(F.sum(F.when(~great, F.col("t") + F.col("s"))).alias("small"), F.count_if(great).alias("great")).first()
    width = train.agg(F.avg(F.size(vector)).alias("width")).first()["width"] or 1
    block = max(1, int(BLOCK_VALUES / max(width, 1)))
    cells = math.ceil((total["small"] or 0) / (2 * cell_rows))
    pieces = math.ceil(3 * spark.sparkContext.defaultParallelism / max(1, cells + total["great"]))
    groups, hot = cells * pieces, []
    for r in sizes.where(great & (F.col("t") > 0) & (F.col("s") > 0)).collect():  # one for each ``cell_rows`` rows at most
        blocks, parts = math.ceil(r["t"] / block), max(pieces, math.ceil(r["s"] / block))
        hot.append((r["table"], r["bucket"], groups, blocks, parts))
        groups += blocks * parts
    own = F.broadcast(spark.createDataFrame(hot, "table int, bucket double, first int, blocks int, parts int"))
    cell = F.pmod(F.xxhash64("table", "bucket"), F.lit(max(cells, 1))).cast("int") * pieces

    def dealt(rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        placed = rows.join(own, ["table", "bucket"], "left").select(
            name, "vec", "tags", "table", F.coalesce("first", cell).alias("first"), F.coalesce("blocks", F.lit(1)).alias("blocks"),
            F.coalesce("parts", F.lit(pieces)).alias("parts"))
        part = F.pmod(F.xxhash64(name, "vec"), F.col(mine)).cast("int").alias(f"{mine}_at")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        return placed.select("*", part, every).withColumn("at", F.col("first") + F.col("blocks_at") * F.col("parts") + F.col("parts_at"))

    def make(held: dict[str, pa.Array]) -> tuple[Block, np.ndarray, np.ndarray]:
        found = Block(held["tk"], held["vec"], held["table"], held["tags"])
        return found, np.asarray(found.others[0]), _matrix(found.others[1])

    def tell(held, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        points, table, tags = held
        vecs, my_table, my_tags = _matrix(batch.column("vec")), np.asarray(batch.column("table")), _matrix(batch.column("tags"))
        mine = points.own(batch.column("sk")) if exclude_self else None
        waiting, n = [], 0

        def sent() -> pa.RecordBatch:
            row, place, d = (np.concatenate(x) for x in zip(*waiting))
            return pa.RecordBatch.from_arrays([batch.column("sk").take(pa.array(row)), points.keys.take(pa.array(place)), pa.array(d)], ["sk", "tk", "dist"])

        for row, place, measured in points.within(vecs, threshold):
            at = my_table[row]
            ok = (at == table[place]) & (my_tags[row, at] == tags[place, at])
            for i in range(tables - 1):  # pairs that met in an earlier table
                ok &= (at <= i) | (my_tags[row, i] != tags[place, i])
            if mine is not None:
                ok &= points.order[place] != mine[row]
            ok = np.flatnonzero(ok)
            d = measured(ok)
            near = d < threshold
            waiting.append((row[ok][near], place[ok][near], d[near]))
            n += int(near.sum())
            if n >= PAIRS:
                yield sent()
                waiting, n = [], 0
        if n:
            yield sent()

    kinds = dict(score.dtypes)[key], dict(train.dtypes)[key]
    found = _meet(dealt(a, "tk", "blocks", "parts").select("at", "tk", "vec", "tags", "table"),
                  dealt(b, "sk", "parts", "blocks").select("at", "sk", "vec", "tags", "table"), max(groups, 1), (make, tell),
                  f"sk {kinds[0]}, tk {kinds[1]}, dist double")
    return found.select(F.col("sk").alias(key), F.col("tk").alias("neighbour"), "dist")
