"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import U64, mix, salts, signed
from tablecraft.llm.components import components
from tablecraft.llm.registry import query, table
from tablecraft.session import materialize

TABLES, PROBES = 4, 8
# With this scale, unit vectors of cosine 0.93 lie about 0.6 apart in a projection; cells have radius 0.7 to 1.
SCALE = 0.5625
TILE_ROWS, GROUP_ROWS = 1000, 4000


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight of a half with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


_SHORTEST = _shortest()
_PLACE = salts(8, 707)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: the worst rounded one goes the other way where the sum is odd."""
    whole = np.rint(x)
    off = x - whole
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
    way = np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    whole[odd, worst[odd]] += way
    return whole


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row: of the even points and of those moved by a half."""
    a = _nearest_even(x)
    b = _nearest_even(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def projection(dimensions: int, tables: int = TABLES) -> list[np.ndarray]:
    """A reproducible random map to eight dimensions for each table."""
    out = []
    for t in range(tables):
        draws = np.random.Generator(np.random.Philox(key=[dimensions, t])).standard_normal((dimensions, 8))
        out.append(draws * SCALE)
    return out


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Keys of each row's own cell and of the neighbouring cells nearest to it, (rows, tables, 1 + probes).

    A row at a decision border may get another nearest cell on another machine, which costs at most that meeting.
    """
    out = np.empty((len(unit), tables, 1 + probes), U64)
    for t, matrix in enumerate(projection(unit.shape[1], tables)):
        x = unit @ matrix
        home = decode_e8(x)
        away = x - home
        distance = 2.0 - 2.0 * (away @ _SHORTEST.T)  # beyond the distance to the own cell
        near = np.argsort(distance, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + _SHORTEST[near]], axis=1)
        doubled = np.rint(points * 2).astype(np.int64).view(U64)
        out[:, t] = mix(mix(doubled * _PLACE).sum(axis=2) + U64(t + 1))
    return out


def _valid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by length, of the vectors that are finite and not zero."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(pa.compute.fill_null(flat.cast(pa.float64()), float("nan")))
    first = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        vectors = values[first[rows][:, None] + np.arange(n)]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield rows[good], vectors[good]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of huge or tiny entries stay in range
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and cell that it visits."""
    for batch in batches:
        for row in range(0, batch.num_rows, 1000):
            part = batch.slice(row, 1000)
            ids, labels = part.column(0), part.column(1)
            for rows, vectors in _valid(part.column(2)):
                keys = cells(_unit(vectors))
                each = keys.shape[1] * keys.shape[2]
                again = np.repeat(rows, each)
                binary = np.array([v.tobytes() for v in vectors], dtype=object)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(again)), labels.take(pa.array(again)), pa.array(np.full(len(again), vectors.shape[1], np.int32)),
                     pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), keys.shape[2]), len(rows))),
                     pa.array(signed(keys.ravel())), pa.array(np.repeat(binary, each), pa.binary())], ["id", "lab", "size", "t", "cell", "vector"])


def _earlier(keys: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, cell: int) -> np.ndarray:
    """Which pairs also meet in an earlier table, or in a lower cell of this one, and are counted there."""
    out = np.zeros(len(a), bool)
    for earlier in range(t + 1):
        x, y = keys[a, earlier], keys[b, earlier]
        same = x[:, :, None] == y[:, None, :]
        if earlier == t:
            same &= (x < U64(cell))[:, :, None]
        out |= same.any(axis=(1, 2))
    return out


def _links(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of some tiles: each row's links that no earlier cell counts, and the least row it is linked to in its tile."""
        ids, own, t, cell, i, j, label = (frame[c].to_numpy() for c in ("id", "own", "t", "cell", "i", "j", "lab"))
        order = np.lexsort((ids, j, i, label, t, cell))
        ids, own, t, cell, i, j, label = (x[order] for x in (ids, own, t, cell, i, j, label))
        unit = _unit(np.frombuffer(b"".join(frame["vector"]), np.float64).reshape(-1, int(frame["size"].iloc[0]))[order])
        fresh = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (cell, t, label, i, j)], axis=0), [True]])
        edges = np.flatnonzero(fresh)
        count, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for first, last in zip(edges, edges[1:]):
            part = unit[first:last]
            close = part @ part.T >= threshold
            if close.sum() <= len(part):
                continue
            here = ids[first:last]
            close &= here[:, None] != here[None, :]
            if i[first] != j[first]:
                close &= own[first:last, None] != own[None, first:last]
            a, b = np.nonzero(np.triu(close))
            if not len(a):
                continue
            keys = cells(part)
            for k in range(0, len(a), 20_000):
                x, y = a[k:k + 20_000], b[k:k + 20_000]
                new = ~_earlier(keys, x, y, int(t[first]), int(cell[first]) % (1 << 64))
                count[first:last] += np.bincount(x[new], minlength=len(part)) + np.bincount(y[new], minlength=len(part))
            rank = np.arange(len(part))
            while True:
                lower = np.minimum(rank, np.where(close, rank[None, :], len(part)).min(axis=1))
                lower = lower[lower]
                if (lower == rank).all():
                    break
                rank = lower
            low[first:last] = first + rank
        linked = np.zeros(len(ids), bool)
        linked[low[low != np.arange(len(ids))]] = True
        linked |= (low != np.arange(len(ids))) | (count > 0)
        return pd.DataFrame({"id": ids[linked], "n": count[linked], "low": ids[low[linked]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Two vectors of one length and one label are linked if their cosine in double precision is at least ``threshold``
    and they visit a common cell in one of the tables; no other pair is linked. Null, empty and zero vectors, those
    with null or non-finite components, and rows without label or id link with nothing. ``component_id`` is the least
    vec_id reachable over links, itself included (null without id), ``kept`` marks its row; a row without id is kept.
    Equal rows are one vector; rows that share an id but not the vector are linked each. Other columns are not read.

    The rows of a cell are compared as blocks of at most 1,000 against each other, each pair of blocks in a task of its
    own; pairs are counted where they meet first and never leave the task, only a count and one link for each row do.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    named = vectors.where("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").distinct()
    visits = named.select("id", F.xxhash64("label").alias("lab"), "embedding").mapInArrow(
        _meet, "id long, lab long, size int, t int, cell long, vector binary")
    place = ["lab", "size", "t", "cell"]
    sizes = visits.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = visits.join(sizes, place).withColumn("blocks", F.ceil(F.col("n") / TILE_ROWS).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *place, "id", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # Tiles are small and many: some thousand rows of them are handled together.
    groups = max(1, named.count() * TABLES * (1 + PROBES) // GROUP_ROWS)
    tiles = tiles.withColumn("group", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(groups)))
    links = materialize(tiles.groupBy("size", "group").applyInPandas(_links(threshold), "id long, n long, low long"))
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    found = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    out = vectors.select("id").join(counts, "id", "left").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


@query("op10_lattice_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
