"""Substring de-duplication by content-defined chunks: a gear rolling hash cuts, digests of chunks are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import SPACE, RangeHash, salts, signed, text_steps
from tablecraft.llm.registry import map_batches, query, quoted, table, unused, widened

# The hash has 16 bits, so a cut depends on the 16 bytes before it and no others. Behind one white-space byte in
# CUT a chunk ends: about 50 bytes with usual words. Bounds of a chunk's length, in bytes. In words of over
# UNBROKEN bytes, as scripts without spaces have, a chunk also ends where the hash is the least within NEAR bytes, about 50 bytes too.
GEAR_BITS, CUT, LEAST, MOST, UNBROKEN, NEAR = 16, 5, 16, 256, 64, 24
# A passage goes if its repeated chunks, without a gap, hold as many bytes: under 50 words of usual length.
PASSAGE = 120
_GEAR = (salts(256, 606) >> np.uint64(40)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: twice the hash before plus the byte's random value, in 16 bits.

    Twice as many bytes are summed up in every step, so the rolling sum needs four array steps.
    """
    h = _GEAR[data]
    width = 1
    while width < GEAR_BITS:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def inside_words(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of code points in words over UNBROKEN bytes whose gear hash, of the word's bytes alone, is below all others within NEAR bytes."""
    stops = np.union1d(np.flatnonzero(SPACE[data]), bounds)
    long_ = np.flatnonzero(np.diff(stops) > UNBROKEN)
    if not len(long_):
        return np.zeros(0, np.int64)
    inside = np.concatenate([np.arange(stops[i] + 1 + GEAR_BITS, stops[i + 1]) for i in long_])
    inside = inside[(data[inside] & 0xC0) != 0x80]
    h = gear(data)
    value = np.full(len(data) + 2 * NEAR, 1 << GEAR_BITS, np.int32)
    value[inside + NEAR] = h[inside - 1]
    for d in range(1, NEAR + 1):
        at = inside + NEAR
        inside = inside[(value[at] < value[at - d]) & (value[at] < value[at + d])]
    return inside


def cuts(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Ends of all chunks of a buffer of texts, ascending; the end of each text that has bytes is among them.

    A chunk ends behind a white-space byte whose gear hash is in the lowest CUT-th, or at one of the places ``inside`` words
    if given, unless another such place lies less than LEAST bytes before; stretches over MOST bytes without one, such as one letter over and over, are cut at that length, never inside a
    code point. The rules look at near bytes only, so an insertion moves the cuts around it and no others, with and without
    spaces. A text's last cut may leave a shorter chunk.
    """
    edge = np.unique(bounds[1:][np.diff(bounds) > 0])
    if not len(edge):
        return edge
    hit = np.flatnonzero(SPACE[data] & (gear(data) < (1 << GEAR_BITS) // CUT)) + 1
    if inside is not None and len(inside):
        hit = np.union1d(hit, inside)
    text = bounds[np.searchsorted(bounds, hit, side="left") - 1]
    hit, text = hit[hit - text >= GEAR_BITS], text[hit - text >= GEAR_BITS]
    before = np.concatenate([[-LEAST], hit[:-1]])[:len(hit)]
    hit = hit[(before <= text) | (hit - before >= LEAST)]
    ends = np.union1d(hit, edge)
    begins = np.concatenate([[0], ends[:-1]])
    long_ = np.flatnonzero(ends - begins > MOST)
    if len(long_):
        inner = np.concatenate([np.arange(begins[i] + MOST, ends[i], MOST) for i in long_])
        for _ in range(3):  # a code point has at most three bytes behind its first
            inner = inner - ((data[inner] & 0xC0) == 0x80)
        ends = np.union1d(ends, inner)
    return ends


def _chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and digest of every chunk."""
    end = cuts(data, bounds, inside_words(data, bounds))
    start = np.concatenate([[0], end[:-1]])[:len(end)].astype(np.int64)
    return np.searchsorted(bounds, start, side="right") - 1, start, end, RangeHash(data)(start, end)


def _again(owner: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether an earlier chunk of the same text is equal."""
    order = np.lexsort((digest, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    out = np.zeros(len(owner), bool)
    out[order[1:][same]] = True  # equal keys keep their order
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct chunk of a text: digest, id, the text's long hash, and its short hash with the chunk's start."""
    for batch in batches:
        ids, name, tie = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
        for first, last, data, bounds in text_steps(batch.column(3)):
            owner, start, _, digest = _chunks(data, bounds)
            new = ~_again(owner, digest)
            owner, start, digest = owner[new], start[new], digest[new]
            place = (tie[first:last][owner] << 32) | (start - bounds[owner])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(digest)), pa.array(ids[first:last][owner]), pa.array(name[first:last][owner]), pa.array(place)],
                ["digest", "id", "name", "place"])


def _removed(owner, start, end, repeated) -> np.ndarray:
    """The repeated chunks that lie in a gapless run of PASSAGE bytes or more."""
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1])
    run = np.cumsum(fresh) - 1
    return repeated & (np.bincount(run, weights=end - start)[run] >= PASSAGE) if len(run) else repeated


ADDED = ["n_bytes", "n_removed", "n_chunks", "n_repeated", "n_spans", "repeats_of"]
ADDED_DDL = "n_bytes long, n_removed long, n_chunks long, n_repeated long, n_spans long, repeats_of array<long>"


def remove_passages(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input's rows with ``text`` replaced by what stays, and n_bytes, n_removed (bytes), n_chunks, n_repeated
    (chunks), n_spans (removed runs) and repeats_of, the ids of the other documents that keep what goes.

    A chunk is repeated if a document of a lower id has an equal one, or the same text an earlier one; repeated chunks
    go where a gapless run of them holds 120 bytes or more, so chance repeats of a few words stay. The first document
    keeps the passage. Documents without id come after all others in the order of a hash of their text. Rows of the
    same id and text are one document, all of them keep or lose the same. Null texts stay null with zeros, empty texts
    stay empty. Input columns of the names that are added give way.

    Digests are grouped before the shuffle; only shared ones are joined back, and the engine splits hot ones. 64 bits
    are enough because a passage is several chunks: chance collisions do not line up. A row is known by its id and 96 bits
    of two hashes of its text; without id by 61 bits of a third, which stand for the id.
    """
    kept = documents.drop(*ADDED)
    names = kept.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(1), whole), 3))
    id_, name, tie, places = unused(kept, "__id", "__name", "__tie", "__met")
    keyed = kept.withColumns({id_: order, name: F.xxhash64(whole), tie: F.hash(whole)})
    rows = keyed.select(id_, name, tie, text).mapInArrow(_digests, "digest long, id long, name long, place long")
    shared = rows.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low")
    met = rows.join(shared, "digest").where("id <> low")
    place = F.struct(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("start"), "low")
    met = met.groupBy(F.col("id").alias(id_), F.col("name").alias(name), F.shiftright("place", 32).cast("int").alias(tie)).agg(F.collect_set(place).alias(places))
    joined = keyed.join(met, [id_, name, tie], "left").select(*quoted(names), places)
    at, last = names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end_, data, bounds in text_steps(batch.column(at)):
                part = batch.slice(first, end_ - first)
                owner, start, end, digest = _chunks(data, bounds)
                lists = part.column(last)
                counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                flat = lists.flatten()
                text_of = np.repeat(np.arange(part.num_rows), counts)
                starts, lows = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                spot = np.searchsorted(start, bounds[text_of] + starts)
                source = np.zeros(len(start), np.int64)
                repeated = _again(owner, digest)
                # A chunk that repeats one of its own text is told by the first of these.
                own_only = repeated.copy()
                repeated[spot], source[spot] = True, lows
                own_only[spot] = False
                if own_only.any():
                    told = {(o, d): s for o, d, s in zip(owner[spot], digest[spot], lows)}
                    source[own_only] = [told.get((o, d), -1) for o, d in zip(owner[own_only], digest[own_only])]
                gone = _removed(owner, start, end, repeated)
                stays = np.ones(len(data), bool)
                for s, e in zip(start[gone], end[gone]):
                    stays[s:e] = False
                texts, sources, spans, removed = [], [], [], []
                old = part.column(at)
                chunk = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    a, b, c, d = bounds[i], bounds[i + 1], chunk[i], chunk[i + 1]
                    lost = gone[c:d]
                    if not lost.any():
                        texts.append(old[i].as_py())
                        sources.append([])
                        spans.append(0)
                        removed.append(0)
                        continue
                    here = data[a:b][stays[a:b]]
                    texts.append(here.tobytes().decode("utf-8", "replace"))
                    sources.append([int(x) for x in np.unique(source[c:d][lost]) if 0 <= x < 1 << 61])
                    spans.append(int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()))
                    removed.append(int(b - a) - len(here))
                numbers = [np.diff(bounds), np.array(removed, np.int64), np.diff(chunk),
                           np.bincount(owner, weights=repeated, minlength=part.num_rows).astype(np.int64), np.array(spans, np.int64)]
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(n.astype(np.int64)) for n in numbers), pa.array(sources, pa.list_(pa.int64()))], [*names, *ADDED])

    return map_batches(joined, run, widened(kept.schema, ADDED_DDL))


@query("op2_gear_chunks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
