"""Near-duplicate components by a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import U64, mix, salts, shingle_hashes, signed, text_steps
from tablecraft.llm.components import components
from tablecraft.llm.registry import query, table
from tablecraft.session import materialize

# A signature has 48 symbols of 16 bits. Two sets of likeness 0.85 differ in 7.2 symbols on average, in more than
# DISTANCE with probability 7.6e-6. Ten chunks of 4 or 5 symbols: 19 differing symbols leave one chunk with at most
# one error, because ten chunks with two errors each would make 20. Other thresholds have their own distance and chunks.
SYMBOLS, DISTANCE, CHUNKS, PLANES = 48, 19, 10, 4
MISSED = 8e-6
TILE_ROWS, TILE_SHINGLES = 512, 2_000_000
COLUMNS = 4096
_MULTIPLY, _ADD = salts(SYMBOLS, 101), salts(SYMBOLS, 202)
_KEY_SALT = salts(SYMBOLS, 303)


def plan(part: int, whole: int) -> tuple[int, int]:
    """Distance and number of chunks for a threshold: sets of that likeness differ in more symbols with probability MISSED at most."""
    differ, left, distance = 1 - part / whole, 1.0, -1
    while left > MISSED:
        distance += 1
        left = sum(math.comb(SYMBOLS, k) * differ ** k * (1 - differ) ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))
    chunks = distance // 2 + 1
    if SYMBOLS < 3 * chunks:
        raise ValueError(f"likeness {part}/{whole} is too low for signatures of {SYMBOLS} symbols")
    return distance, chunks


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of symbols for each text that has shingles; (texts, SYMBOLS)."""
    out = np.empty((len(at) - 1, SYMBOLS), U64)
    for j in range(SYMBOLS):
        hashed = shingles * _MULTIPLY[j] + _ADD[j]
        hashed ^= hashed >> U64(32)
        hashed *= _MULTIPLY[j]
        out[:, j] = np.minimum.reduceat(hashed, at[:-1])
    return mix(out) & U64(0xFFFF)


def probe_keys(symbols: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For each chunk and each of its symbols: a key of the chunk's other symbols, so one error in a chunk is allowed."""
    terms = mix(symbols + (np.arange(SYMBOLS, dtype=U64) << U64(16)) + U64(1 << 40))
    keys = np.empty_like(terms)
    edges = np.linspace(0, SYMBOLS, chunks + 1).astype(int)
    for a, b in zip(edges, edges[1:]):
        keys[:, a:b] = terms[:, a:b].sum(axis=1, keepdims=True) - terms[:, a:b]
    return mix(keys + _KEY_SALT)


def bit_planes(symbols: np.ndarray) -> np.ndarray:
    """The lowest bits of all symbols, one 64-bit value for each bit; these differ in at most as many places as symbols do."""
    place = U64(1) << np.arange(SYMBOLS, dtype=U64)
    return np.stack([(((symbols >> U64(p)) & U64(1)) * place).sum(axis=1) for p in range(PLANES)], axis=1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and each text's place among them."""
    hashed, at = shingle_hashes(data, bounds)
    sets = [np.unique(hashed[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else hashed, np.concatenate([[0], np.cumsum(sizes)])


def _sign(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_steps(batch.column(1)):
                shingles, at = shingle_sets(data, bounds)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                digest = np.zeros((len(sizes), 2), U64)
                planes = np.zeros((len(sizes), PLANES), U64)
                keys = [None] * len(sizes)
                if len(full):
                    starts = at[:-1][full]
                    for k, salt in enumerate(salts(2, 404)):
                        digest[full, k] = np.add.reduceat(mix(shingles * salt), starts)
                    symbols = signatures(shingles, np.append(starts, len(shingles)))
                    planes[full] = bit_planes(symbols)
                    for row, line in zip(full, signed(probe_keys(symbols, chunks))):
                        keys[row] = line
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes), *(pa.array(signed(np.ascontiguousarray(x))) for x in digest.T),
                     *(pa.array(signed(np.ascontiguousarray(x))) for x in planes.T), pa.array(keys, pa.list_(pa.int64()))], SIGNED)

    return run


SIGNED = ["doc_id", "n_shingles", "h1", "h2", *(f"p{i}" for i in range(PLANES)), "keys"]
SIGNED_DDL = ", ".join(f"{c} long" for c in SIGNED[:-1]) + ", keys array<long>"


def _close(threshold: tuple[int, int], distance: int):
    """Rows a and b of one bucket may be linked: few symbols differ and the sizes allow the likeness."""
    differ = F.lit(0).cast("long")
    for i in range(PLANES):
        differ = differ.bitwiseOR(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}")))
    part, whole = threshold
    small, large = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    return (F.bit_count(differ) <= distance) & (small * whole >= large * part)


def _forest(linked: np.ndarray) -> np.ndarray:
    """The lowest row reachable from each row of a link matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _confirm(threshold: tuple[int, int]):
    part, whole = threshold

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of one tile: sizes of all intersections by products of 0/1 blocks, one link for each row to its lowest."""
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy()
        sets = []
        for _, _, data, bounds in text_steps(pa.array(frame["text"], pa.large_string())):
            shingles, at = shingle_sets(data, bounds)
            sets += [shingles[a:b] for a, b in zip(at[:-1], at[1:])]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(shared > 1)
        renumbered = np.full(len(values), -1)
        renumbered[twice] = np.arange(len(twice))
        column = renumbered[column]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        for first in range(0, len(twice), COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            block = np.zeros((len(sets), min(COLUMNS, len(twice) - first)), np.float32)
            block[owner[a:b], column[a:b] - first] = 1
            common += block @ block.T
        union = sizes[:, None] + sizes[None, :] - common
        low = _forest(common * whole >= union * part)
        other = low != np.arange(len(ids))
        return pd.DataFrame({"a": ids[other], "b": ids[low[other]]})

    return run


def near_duplicates(documents: DataFrame, part: int = 85, whole: int = 100) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when ``whole * |intersection| >= part * |union|`` of their sets of distinct five-word shingles
    (A-Z lower-cased; a shorter text is one shingle; a text without words, or null, has none and no links).
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks the row of that id. A row without
    doc_id links with nothing, has no component and is kept. Rows that repeat a doc_id count as one document whose
    links are those of all its rows. Other columns are not read.

    Equal sets become one representative; its signature's chunks are looked up by keys that allow one error each, so
    every pair within the threshold's ``plan`` (85/100: 19 differing symbols) meets in a bucket. Rows that have a bucket mate within that distance go
    on; their groups are cut into tiles of bounded size, each of which confirms its links on full sets and reports a
    spanning forest, not pairs. Buckets are joined by key, which the engine splits where a key is hot.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    distance, chunks = plan(part, whole)
    signed_ = materialize(documents.mapInArrow(_sign(chunks), SIGNED_DDL))
    named = signed_.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Stored, so that the join that follows is dealt anew and the rows of a very common set can be split.
    lowest = materialize(named.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id")))
    copies = named.join(lowest, ["h1", "h2", "n_shingles"]).select("doc_id", "id")
    copies = materialize(copies)
    planes = [f"p{i}" for i in range(PLANES)]
    alone = (
        named.join(lowest.withColumnRenamed("id", "doc_id"), ["h1", "h2", "n_shingles", "doc_id"], "left_semi")
        .dropDuplicates(["h1", "h2", "n_shingles", "doc_id"])  # by all that the join is dealt by
    )
    entries = alone.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    bucket = entries.join(shared, "key").join(alone.select(F.col("doc_id").alias("id"), "n_shingles", *planes), "id")
    bucket = materialize(bucket)
    mates = bucket.alias("a").join(
        bucket.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & _close((part, whole), distance), "left_semi")
    mates = materialize(mates.select("id", "key", "n_shingles"))
    star = mates.groupBy("key").agg(F.min("id").alias("b"))
    groups = components(mates.select("key", F.col("id").alias("a")).join(star, "key").select("a", "b"))
    members = groups.join(mates.groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    blocks = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = members.join(documents.withColumnRenamed("doc_id", "id"), "id")
    tiles = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "text")
    links = tiles.groupBy("component", "i", "j").applyInPandas(_confirm((part, whole)), "a long, b long")
    links = links.unionByName(copies.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    found = components(links).withColumnRenamed("id", "doc_id")
    component = F.coalesce("component", "doc_id")
    return signed_.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
links AS (
  SELECT i.a, i.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) i
  JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * i.c >= 85 * (na.n + nb.n - i.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.lo AS component_id, n.doc_id = c.lo AS kept
FROM n JOIN (SELECT a, min(b) AS lo FROM reach GROUP BY a) c ON c.a = n.doc_id
"""


@query("op4_multi_index_hamming", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
