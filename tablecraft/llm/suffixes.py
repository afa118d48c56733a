"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix array entry is needed only at some positions: in every window of WINDOW positions the one whose next GRAM
bytes have the least hash. Equal windows choose equal positions, so every repeat of LENGTH bytes shares a position at
most WINDOW - 1 bytes behind its start, and the PREFIX bytes from there lie inside the repeat. Entries are ordered by
a digest of these bytes: suffixes that match over PREFIX bytes are neighbours, others are of no interest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import U64, RangeHash, mix, salts, signed, text_steps
from tablecraft.llm.registry import query, stored, table

LENGTH, WINDOW, GRAM = 400, 300, 32
PREFIX = LENGTH - WINDOW + 1
# Contexts of one task in the exact comparison; a class of more than HOT contexts is compared window by window in joins.
GROUP_ROWS, HOT, STEP = 4096, 100_000, 25
# A class of more than a SHARE-th of all contexts is dealt by places, STEP at a time.
SHARE = 32
BATCHES = 3


def sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    """Least value of every run of ``window`` values, from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, U64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n - window + 1], behind[window - 1:n])


def anchors(hashes: RangeHash, bounds: np.ndarray) -> np.ndarray:
    """Chosen positions of all texts of a buffer, ascending."""
    n = int(bounds[-1])
    long_ = np.flatnonzero(np.diff(bounds) >= LENGTH)
    if not len(long_):
        return np.zeros(0, np.int64)
    position = np.arange(n - GRAM + 1)
    bits = U64(max(20, n.bit_length()))
    ranked = (hashes(position, position + GRAM) >> bits << bits) | position.astype(U64)
    least = sliding_least(ranked, WINDOW) & ((U64(1) << bits) - U64(1))
    # A window starts where LENGTH bytes follow inside the text.
    starts = np.zeros(n + 1, np.int8)
    starts[bounds[long_]] += 1
    starts[bounds[long_ + 1] - LENGTH + 1] -= 1
    valid = np.flatnonzero(np.cumsum(starts[:len(least)]))
    return np.unique(least[valid]).astype(np.int64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key: digest of the PREFIX bytes; context: digest of all bytes that windows over the position can hold; room before and behind."""
    for batch in batches:
        d1, d2 = (np.asarray(batch.column(i)) for i in (0, 1))
        for first, last, data, bounds in text_steps(batch.column(2)):
            if bounds[-1] < LENGTH:
                continue
            hashes = RangeHash(data)
            at = anchors(hashes, bounds)
            owner = np.searchsorted(bounds, at, side="right") - 1
            left = np.minimum(at - bounds[owner], WINDOW - 1)
            right = np.minimum(bounds[owner + 1] - at, LENGTH)
            context = mix(hashes(at - left, at + right) + left.astype(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashes(at, at + PREFIX))), pa.array(signed(context)), pa.array(d1[first:last][owner]), pa.array(d2[first:last][owner]),
                 pa.array(at - bounds[owner]), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ENTRY)


ENTRY = ["key", "context", "d1", "d2", "pos", "left", "right"]
ENTRY_DDL = "key long, context long, d1 long, d2 long, pos long, left int, right int"


class SuffixIndex:
    """Sparse suffix arrays in levels: (key, context, n) tables in key order, each about twice the next one.

    ``add`` builds the array of a batch, scans it against all levels for keys that meet, and makes it a new level.
    Before that, levels of like size are merged, so an entry is rewritten a logarithmic number of times.
    """

    def __init__(self):
        self.levels: list[tuple[DataFrame, int]] = []
        self.matches: list[DataFrame] = []

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            (a, n), (b, m) = self.levels[-2:]
            merged = a.unionByName(b).groupBy("key", "context").agg(F.sum("n").alias("n"))
            self.levels[-2:] = [(stored(merged.sortWithinPartitions("key")), n + m)]

    def add(self, entries: DataFrame) -> None:
        self._merge()
        counted = entries.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"))
        array = stored(counted.sortWithinPartitions("key"))
        own = array.groupBy("key").agg(F.sum("n").alias("n"))
        if self.levels:
            older = self.all().groupBy("key").agg(F.sum("n").alias("m"))
            own = own.join(older.hint("merge"), "key", "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))
        self.matches.append(stored(own.where("n > 1").select("key")))
        self.levels.append((array, array.count()))

    def all(self) -> DataFrame:
        out = self.levels[0][0]
        for level, _ in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def repeated(self) -> DataFrame:
        """(key, context, n, kinds) of every key met more than once; kinds is the number of its contexts."""
        keys = self.matches[0]
        for more in self.matches[1:]:
            keys = keys.unionByName(more)
        found = self.all().join(keys.distinct(), "key", "left_semi").groupBy("key", "context").agg(F.sum("n").alias("n"))
        found = stored(found)
        return found.join(found.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), "key")


def _covered(left, right, pos):
    """The bytes of all windows over a position: from the earliest window's start to the latest window's end."""
    start = pos - left
    end = pos + F.least(right, F.lit(LENGTH))
    return F.when(left + right >= LENGTH, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def _runs(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _digest(text: str | None, spans: list) -> tuple[int, int, int, str]:
    data = (text or "").encode()
    runs = _runs(spans)
    kept, at = hashlib.sha256(), 0
    for start, end in runs:
        kept.update(data[at:start])
        at = end
    kept.update(data[at:])
    return len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OPENS = pa.list_(pa.struct([("key", pa.int64()), ("context", pa.int64()), ("pos", pa.int64())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the texts whose spans are all known; the others keep text, spans and open positions."""
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            doc_id, d1, d2, text, spans, opens = batch.slice(row, 512).columns
            spans, opens = spans.to_pylist(), opens.to_pylist()
            rows = [(0, 0, 0, "") if o else _digest(t.as_py(), s or []) for t, s, o in zip(text, spans, opens)]
            numbers = [pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [doc_id, *numbers, d1, d2, pa.array([t.as_py() if o else None for t, o in zip(text, opens)], pa.string()),
                 pa.array([s or [] if o else None for s, o in zip(spans, opens)], SPANS), pa.array([o or None for o in opens], OPENS)],
                [*RESULT, "d1", "d2", "text", "spans", "opens"])


JUDGED_DDL = (
    RESULT_DDL + ", d1 long, d2 long, text string, spans array<struct<start: long, end: long>>, "
    "opens array<struct<key: long, context: long, pos: long>>")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            doc_id, text, spans, more = batch.slice(row, 512).columns
            rows = [_digest(t.as_py(), s + (m or [])) for t, s, m in zip(text, spans.to_pylist(), more.to_pylist())]
            numbers = [pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([doc_id, *numbers], RESULT)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each open position."""
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            d1, d2, text, opens = batch.slice(row, 256).columns
            out = []
            for a, b, t, places in zip(d1.to_pylist(), d2.to_pylist(), text, opens.to_pylist()):
                data = t.as_py().encode()
                for o in places:
                    left = min(o["pos"], WINDOW - 1)
                    out.append((o["key"], a, b, o["pos"], left, data[o["pos"] - left:o["pos"] + LENGTH]))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 4 else pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], CONTEXT)


CONTEXT = ["key", "d1", "d2", "pos", "left", "bytes"]
CONTEXT_DDL = "key long, d1 long, d2 long, pos long, left int, bytes binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A context once for every STEP places (from ``first``), with the bytes of their windows alone."""
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            out = []
            for *at, left, data in zip(*[c.to_pylist() for c in batch.slice(row, 256).columns]):
                for first in range(0, left + 1, STEP):
                    begin, end = max(0, left - first - STEP + 1), min(len(data), left - first + LENGTH)
                    if end - begin >= LENGTH:
                        out.append((*at, left - begin, data[begin:end], first))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i in (4, 6) else pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], [*CONTEXT, "first"])


def _dealt(contexts: DataFrame, rows: int, wide: DataFrame | None = None, wide_rows: int = 0) -> DataFrame:
    """Contexts with the group that compares them, by key. Keys of ``wide`` are dealt by places: windows at different places
    never meet, and those of STEP places have LENGTH - STEP + 1 bytes in common, by which they are dealt on."""
    whole = F.xxhash64("key")
    if wide is None:
        return contexts.withColumn("group", F.pmod(whole, F.lit(max(1, rows // GROUP_ROWS))))
    rows += wide_rows * (-(-WINDOW // STEP) - 1)
    groups = F.lit(max(1, rows // GROUP_ROWS))
    common = F.expr(f"substring(bytes, left - first + 1, {LENGTH - STEP + 1})")
    sliced = contexts.join(wide, "key", "left_semi").select(*CONTEXT).mapInArrow(_slices, f"{CONTEXT_DDL}, first int")
    sliced = sliced.withColumn("group", F.pmod(F.xxhash64("key", "first", common), groups)).drop("first")
    return contexts.join(wide, "key", "left_anti").select(*CONTEXT).withColumn("group", F.pmod(whole, groups)).unionByName(sliced)


def _windows(hashes: RangeHash, key: np.ndarray, left: np.ndarray, contexts: list[bytes], low: int = 0,
             high: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bytes before the position (from ``low``, below ``high``), and digest of every window of LENGTH bytes over the
    position of each context; ``hashes`` are of all contexts joined."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    latest = np.minimum(left, high - 1)
    first = np.maximum(low, left + LENGTH - size)
    count = np.maximum(0, latest - first + 1)
    row = np.repeat(np.arange(len(size)), count)
    ahead = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    start = begin[row] + left[row] - ahead
    place = salts(WINDOW, 505)
    return row, ahead, mix(hashes(start, start + LENGTH) + key.astype(np.int64).view(U64)[row] * place[ahead])


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of the contexts of some classes: those windows that another context of the class has at the same place."""
    key, left, contexts = frame["key"].to_numpy(), frame["left"].to_numpy().astype(np.int64), frame["bytes"].tolist()
    most, least = np.full(len(frame), -1), np.full(len(frame), WINDOW)
    hashes = RangeHash(np.frombuffer(b"".join(contexts), np.uint8))
    for first in range(0, WINDOW, STEP):  # windows at different places never meet, so memory holds some places at a time
        row, ahead, digest = _windows(hashes, key, left, contexts, first, first + STEP)
        ordered = np.sort(digest)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, digest), len(twice) - 1)] == digest
            np.maximum.at(most, row[hit], ahead[hit])
            np.minimum.at(least, row[hit], ahead[hit])
    met = np.flatnonzero(most >= 0)
    chosen = frame.iloc[met]
    pos = chosen["pos"].to_numpy()
    return pd.DataFrame({"d1": chosen["d1"], "d2": chosen["d2"], "start": pos - most[met], "end": pos - least[met] + LENGTH})


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            contexts = part.column(5).to_pylist()
            hashes = RangeHash(np.frombuffer(b"".join(contexts), np.uint8))
            row, ahead, digest = _windows(hashes, np.asarray(part.column(0)), np.asarray(part.column(4)).astype(np.int64), contexts)
            taken = [part.column(i).take(pa.array(row)) for i in (0, 1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(ahead), pa.array(signed(digest))], ["key", "d1", "d2", "pos", "ahead", "digest"])


SPAN_DDL = "d1 long, d2 long, start long, end long"


def remove_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of 400 bytes over it also starts anywhere else, in the same text or in another; texts are
    judged as given, as UTF-8. Null texts count as empty, texts under 400 bytes stay whole. Texts are known by two
    hashes of theirs, so ids may repeat or be null, and repeated rows remove each other. Other columns are not read.

    Batches of texts enter the index one after the other. Entries of a repeated key with the same context settle each
    other. Where a key has several contexts, one occurrence of each sends its bytes to a comparison of all windows,
    grouped by key into tasks of bounded size; a key with a large share of all contexts is dealt by places as well, and
    one with very many contexts is compared by joins on single windows.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64("text", F.lit(7))})
    long_ = texts.where(F.octet_length("text") >= LENGTH).select("d1", "d2", "text")
    index = SuffixIndex()
    for b in range(batches):
        index.add(long_.where(F.pmod("d1", F.lit(batches)) == b).mapInArrow(_entries, ENTRY_DDL))
    repeated = stored(index.repeated())
    several = repeated.where("kinds > 1")
    compared, hot = several.agg(F.count(F.lit(1)), F.max("kinds")).first()

    members = long_.mapInArrow(_entries, ENTRY_DDL).join(repeated, ["key", "context"])
    # Copies of a text give equal rows; what else a position has follows from it.
    place = ["d1", "d2", "pos"]
    members = stored(members.groupBy(*place).agg(*[F.first(c).alias(c) for c in (*ENTRY, "n", "kinds") if c not in place]))
    sure = members.where("n > 1").select("d1", "d2", _covered(F.col("left"), F.col("right"), F.col("pos")).alias("s")).where("s IS NOT NULL")
    sure = sure.distinct().groupBy("d1", "d2").agg(F.collect_list("s").alias("spans"))
    opens = members.where("kinds > 1").groupBy("key", "context").agg(F.min(F.struct("d1", "d2", "pos")).alias("at")).select(
        "key", "context", "at.*")
    opens = opens.groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "context", "pos")).alias("opens"))
    # Of equal texts, the one of the least id speaks for all.
    first = texts.groupBy("d1", "d2").agg(F.min("doc_id").alias("speaker"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    known = sure.join(opens, ["d1", "d2"], "full").join(first, ["d1", "d2"], "left")
    joined = texts.join(known, ["d1", "d2"], "left")
    speaks = F.col("rows").isNull() | F.col("doc_id").eqNullSafe(F.col("speaker"))
    joined = joined.select("doc_id", "d1", "d2", "text", "spans", F.when(speaks, F.col("opens")).alias("opens"))
    judged = stored(joined.mapInArrow(_judge, JUDGED_DDL))

    waiting = judged.where("opens IS NOT NULL")
    contexts = waiting.select("d1", "d2", "text", "opens").mapInArrow(_contexts, CONTEXT_DDL)
    compared, hot = compared or 0, hot or 0
    share = max(GROUP_ROWS, compared // SHARE)
    if hot > min(share, HOT):
        contexts = stored(contexts)
    if hot > HOT:
        crowded = several.where(F.col("kinds") > HOT).select("key").distinct()
        spelled = contexts.join(crowded, "key", "left_semi").mapInArrow(_spelled, "key long, d1 long, d2 long, pos long, ahead long, digest long")
        twice = spelled.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowd = spelled.join(twice, ["key", "digest"], "left_semi").groupBy("d1", "d2", "pos").agg(
            F.max("ahead").alias("most"), F.min("ahead").alias("least")).select(
            "d1", "d2", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("end"))
        contexts = contexts.join(crowded, "key", "left_anti")
    wide, wide_rows = None, 0
    if hot > share:
        wide = several.where(F.col("kinds").between(share + 1, HOT))
        wide_rows, wide = wide.count(), wide.select("key").distinct()
    more = _dealt(contexts, compared, wide, wide_rows).groupBy("group").applyInPandas(_compare, SPAN_DDL)
    if hot > HOT:
        more = more.unionByName(crowd)
    more = more.distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    finished = waiting.join(more, ["d1", "d2"], "left").select("doc_id", "text", "spans", "more").mapInArrow(_finish, RESULT_DDL)
    return judged.where("opens IS NULL").select(*RESULT).unionByName(finished)


@query("op7_suffix_levels")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
