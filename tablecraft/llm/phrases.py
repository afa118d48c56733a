"""Collocations from sorted count streams: one record for each word's place, runs of equal beginnings, lockstep over ancestors."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.bytehash import LOWER, text_steps
from tablecraft.llm.registry import query, stored, table

WORDS = 4
LEAST_COUNT, LEAST_SHARE, BEST = 30, (80, 100), 2000
SCALE = 2_000_000
UNKNOWN = "und"
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
# Keys are the language and the words, joined by tabs. The tab must sort before everything inside a part, so lower letters (and
# the letter that marks them, which words cannot hold) are written as two.
TAB, MARK, LIFT = "\t", "\x0b", 0x20
_LOW = {c: MARK + chr(c + LIFT) for c in range(0x0E)}
# Text that is turned into windows at once, text that one range of windows should have, and the most ranges of any stream.
STEP_BYTES, RANGE_BYTES, MOST_RANGES = 8 << 20, 16 << 20, 20_000
# Ranges are cut by windows of a sample of so much text, and by so many rows for each range of the shorter streams.
SAMPLE_BYTES, SAMPLE_WINDOWS, RANGE_ROWS, SAMPLE_ROWS = 4 << 20, 500_000, 100_000, 100
WINDOWS = "part int, key string, n long"
COUNTS = "key string, n long"


def _lifted(part: str) -> str:
    return part.translate(_LOW)


def _plain(part: str) -> str:
    return re.sub(f"{MARK}(.)", lambda m: chr(ord(m[1]) - LIFT), part, flags=re.S) if MARK in part else part


def _windows(data: np.ndarray, bounds: np.ndarray, lang: str) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct windows of some texts of one language, as keys, and how often each occurs.

    A window is a word with up to three words behind it in its piece: the counts of all shorter phrases follow from it.
    """
    data = LOWER[data]
    solid = ~(BLANK[data] | STOP[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    stops = np.cumsum(STOP[data])
    piece = stops[start] + np.searchsorted(bounds, start, side="right")  # rises with every stop and every text
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    names = words.dictionary
    if (data[solid] < 0x0E).any():
        names = pa.array([_lifted(w) for w in names.to_pylist()], pa.string())
    order = pc.sort_indices(names)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    names, ids = names.take(order), rank[words.indices.to_numpy()]
    word = [ids]
    for far in range(1, WORDS):  # -1 where the piece has no further word
        later = np.full(len(ids), -1)
        later[:-far or None] = np.where(piece[far:] == piece[:len(ids) - far], ids[far:], -1) if far < len(ids) else -1
        word.append(later)
    high, low = word[0] << 32 | (word[1] + 1), (word[2] + 1) << 32 | (word[3] + 1)
    by_key = np.lexsort([low, high])
    high, low = high[by_key], low[by_key]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    columns = [w[by_key[first]] for w in word]
    parts = [names.take(pa.array(c, mask=c < 0)) for c in columns]
    keys = pc.binary_join_element_wise(pa.scalar(_lifted(lang)), *parts, TAB, null_handling="skip")
    return keys, np.diff(np.append(first, len(high)))


def _window_rows(bounds: list[str]):
    """Rows of WINDOWS for batches of (lang, text); ``part`` is the range of keys that a window lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column(0), UNKNOWN).dictionary_encode()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, number))
                for _, _, data, edges in text_steps(texts, STEP_BYTES):
                    keys, n = _windows(data, edges, lang)
                    places = range(len(keys))
                    cuts = [bisect_left(places, b, key=lambda i: keys[i].as_py()) for b in bounds]
                    part = np.searchsorted(np.array(cuts, np.int64), np.arange(len(keys)), side="right").astype(np.int32)
                    for i in range(0, len(keys), 1 << 16):
                        j = i + (1 << 16)
                        yield pa.RecordBatch.from_arrays([pa.array(part[i:j]), keys.slice(i, 1 << 16), pa.array(n[i:j])], ["part", "key", "n"])

    return run


def _quantiles(keys: list[str], parts: int) -> list[str]:
    """Bounds that cut the distinct keys into ranges of equal numbers, fewer than ``parts`` if keys are few."""
    keys = sorted(set(keys))
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by their range and sorted by key: one ordered stream over all partitions."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("key")


class _Runs:
    """Counts of the phrases that begin the windows of one range, from the windows in order.

    Only the open phrase of each length is held. Phrases below ``least`` are left out, but those of the first and the last
    window are always given, as their other windows may be in the ranges beside; so are totals (the key without words).
    """

    def __init__(self, least: int):
        self.least, self.last = least, None
        self.open, self.at_border = [0] * (WORDS + 1), [True] * (WORDS + 1)

    def add(self, keys: pa.Array, n: np.ndarray) -> tuple[list[bytes], list[int]]:
        if self.last is not None:  # the window before, counted already, tells which phrases go on
            keys, n = pa.concat_arrays([pa.array([self.last], pa.string()), keys]), np.concatenate([[0], n])
        rows = len(keys)
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + rows + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        start, length = offsets[:-1] - offsets[0], np.diff(offsets)
        tabs = np.flatnonzero(data == 9)
        of_row = np.searchsorted(start, tabs, side="right") - 1
        count = np.bincount(of_row, minlength=rows)
        ends = np.full((rows, WORDS + 1), -1)
        ends[of_row, np.arange(len(tabs)) - np.repeat(np.cumsum(count) - count, count)] = tabs - start[of_row]
        ends[np.arange(rows), count] = length
        both = np.minimum(length[1:], length[:-1])
        at = np.cumsum(both) - both
        within = np.arange(both.sum()) - np.repeat(at, both)
        differ = data[np.repeat(start[1:], both) + within] != data[np.repeat(start[:-1], both) + within]
        equal = np.minimum(np.minimum.reduceat(np.where(differ, within, 1 << 40), at), both) if rows > 1 else both
        keys_out, counts = [], []

        def tell(order: int, at: np.ndarray, sums: np.ndarray) -> None:
            keys_out.extend(data[start[i]:start[i] + ends[i, order]].tobytes() for i in at)
            counts.extend(sums.tolist())

        for order in range(WORDS + 1):
            end = ends[:, order]
            has = end >= 0
            same = np.zeros(rows, dtype=bool)
            same[1:] = has[1:] & (end[1:] == end[:-1]) & (equal >= end[1:])
            first = np.flatnonzero(has & ~same)
            if not len(first):
                continue
            sums = np.add.reduceat(np.where(has, n, 0), first)
            if first[0] == 0 and self.last is not None:
                sums[0] += self.open[order]
            keep = (sums >= self.least) | (order == 0)
            if self.at_border[order] and (first[0] == 0):
                keep[0] = True
            # What begins at the range's first window stays at its border while it is open.
            still_open = bool(has[-1])
            if still_open:
                self.open[order] = int(sums[-1])
                self.at_border[order] = self.at_border[order] and first[0] == 0 and len(first) == 1
                first, sums, keep = first[:-1], sums[:-1], keep[:-1]
            else:
                self.at_border[order] = False
            tell(order, first[keep], sums[keep])
        for order in range(WORDS + 1):
            if ends[-1, order] < 0:
                self.at_border[order] = False
        self.last = keys[rows - 1].as_py()
        return keys_out, counts

    def close(self) -> tuple[list[bytes], list[int]]:
        if self.last is None:
            return [], []
        parts = self.last.split(TAB)
        return [TAB.join(parts[:i + 1]).encode() for i in range(len(parts))], self.open[:len(parts)]


def phrase_counts(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Stored rows (key, n) of ``documents(lang, text)``: every phrase of 1 to 4 words that occurs ``least`` times in its language,
    and each language's number of words under the key without words. A phrase whose windows lie in two ranges has a row for each
    of them, and such a phrase may have fewer occurrences than ``least``; n must be summed by key.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("lang").cast("string"), "text")
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES + 1))
    some = documents.sample(min(1.0, SAMPLE_BYTES / max(size, 1)), seed=11).mapInArrow(_window_rows([]), WINDOWS).limit(SAMPLE_WINDOWS)
    bounds = _quantiles(some.select("key").toArrow()["key"].to_pylist(), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(least)
        for batch in batches:
            if batch.num_rows:
                yield _counts(*runs.add(batch.column(0), batch.column(1).to_numpy()))
        yield _counts(*runs.close())

    windows = _sorted(documents.mapInArrow(_window_rows(bounds), WINDOWS), len(bounds) + 1)
    return stored(windows.select("key", "n").mapInArrow(run, COUNTS))


def _counts(keys: list[bytes], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array(n, pa.int64())], ["key", "n"])


class _Ranges:
    """Bounds of a stream's ranges, and the counts of the phrases that begin a bound: they lie in ranges before it.

    A phrase that begins some key of a range, but lies before the range, begins the range's bound too.
    """

    def __init__(self, rows: DataFrame):
        count = rows.count()
        parts = min(MOST_RANGES, count // RANGE_ROWS + 1)
        share = min(1.0, SAMPLE_ROWS * parts / max(count, 1))
        self.bounds = _quantiles(rows.sample(share, seed=12).select("key").toArrow()["key"].to_pylist(), parts) if parts > 1 else []
        above = sorted({TAB.join(b.split(TAB)[:i]) for b in self.bounds for i in range(1, b.count(TAB) + 1)})
        self.counts = {}
        if above:
            wanted = rows.sparkSession.createDataFrame([(a,) for a in above], "key string")
            found = rows.join(F.broadcast(wanted), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
            self.counts = {r["key"]: r["n"] for r in found.collect()}

    def before(self, key: str) -> list[tuple[str, int]]:
        """Phrases that begin the key and lie before its range, shortest first, with their counts."""
        part = bisect_right(self.bounds, key)
        bound = self.bounds[part - 1] if part else ""
        above = [TAB.join(bound.split(TAB)[:i]) for i in range(1, bound.count(TAB) + 1)]
        return [(a, self.counts[a]) for a in above if key.startswith(a + TAB) and a in self.counts]

    def deal(self, rows: DataFrame) -> DataFrame:
        bounds = self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = pa.array([bisect_right(bounds, k) for k in batch.column("key").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([part, *batch.columns], ["part", *batch.schema.names])

        schema = rows.schema.simpleString()[len("struct<"):-1].replace(":", " ")
        return _sorted(rows.mapInArrow(run, f"part int, {schema}"), len(bounds) + 1).drop("part")


def _lockstep(rows: Iterator[tuple], ranges: _Ranges, least: int) -> Iterator[tuple[str, int, list, list[int], int]]:
    """(key, n, other values, counts of the phrases that begin the key, greatest count of its extensions by one word).

    ``rows`` are (key, n, other values) in order of the key; rows of one key become one, n summed, other values the greatest
    (lists the longest). Ancestors of a row stand before it, so a stack of them goes along with the stream. Rows of less
    than ``least``, which have no frequent extension, are left out. An ancestor that lies in a range before gives n = 0 here.
    """
    stack: list[list] = []

    def done():
        key, n, other, above, most, inside = stack.pop()
        return key, n if inside else 0, other, above, most

    def put(key, n, other, inside=True):
        while stack and not key.startswith(stack[-1][0] + TAB):
            yield done()
        if stack and n > stack[-1][4]:
            stack[-1][4] = n
        stack.append([key, n, other, [*stack[-1][3], stack[-1][1]] if stack else [], 0, inside])

    held = None
    for key, n, other in rows:
        if held is None:
            for above, count in ranges.before(key):
                yield from put(above, count, None, False)
        elif held[0] == key:
            held = key, held[1] + n, [max(a, b) for a, b in zip(held[2], other)]
            continue
        elif held[1] >= least or TAB not in held[0]:
            yield from put(*held)
        held = key, n, other
    if held is not None and (held[1] >= least or TAB not in held[0]):
        yield from put(*held)
    while stack:
        yield done()


def _turned(key: str) -> str:
    lang, *words = key.split(TAB)
    return TAB.join([lang, *words[::-1]])


FORWARD = "key string, n long, fronts array<long>, after long"
PHRASES = "lang string, phrase string, words int, n long, a long, fronts array<long>, backs array<long>, longer long"


def _streamed(columns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        yield from ((key, n, list(other)) for key, n, *other in zip(*lists))


def _in_batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], [f.name for f in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], [f.name for f in fields])


def phrase_statistics(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Per language and phrase of 2 to 4 words with ``least`` occurrences in ``documents(lang, text)``: lang, phrase, words, n (words
    of the language), a (occurrences), fronts and backs (occurrences of its first and of its last 1, 2, 3 words), longer (greatest
    occurrences of a phrase one word longer that holds it, 0 if none is frequent).

    Texts are read whole: A-Z lower-cased, cut into pieces at ``.,;:!?`` and line breaks, words between blanks and tabs. A null
    text is empty, a null lang is ``und``, repeated rows count each; an empty table has no phrases.

    Each word's place gives one window of four words. Windows are sorted into one stream in which all windows of a phrase
    stand together, so its count is a run's length. Frequent phrases then pass in that order, where each one's first words
    stand before it, and in the order of the turned words, where its last words do; the stack of phrases that a phrase
    extends goes along. No counts are looked up by hash. Every stream is cut into ranges by bounds, of which a frequent
    first word may have many; a range knows the counts of the phrases that its bound extends.
    """
    counts = phrase_counts(documents, least)
    forward = _Ranges(counts)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lockstep(_streamed(2, batches), forward, least)
        yield from _in_batches(((_turned(key), n, above, most) for key, n, _, above, most in found), FORWARD)

    turned = stored(forward.deal(counts).mapInArrow(ahead, FORWARD))
    backward = _Ranges(turned)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, n, other, above, most in _lockstep(_streamed(4, batches), backward, least):
                lang, *words = _turned(key).split(TAB)
                if len(words) > 1:
                    fronts, after = other or ([], 0)
                    phrase = " ".join(map(_plain, words))
                    yield _plain(lang), phrase, len(words), fronts[0] if fronts else 0, n, fronts[1:], above[1:], max(after, most)

        yield from _in_batches(rows(), PHRASES)

    found = stored(backward.deal(turned).mapInArrow(back, PHRASES))
    beyond = found.where("a = 0").groupBy("lang", "phrase").agg(F.max("longer").alias("beyond"))  # at most three for each bound
    both = found.where("a > 0").join(F.broadcast(beyond), ["lang", "phrase"], "left")
    return both.withColumn("longer", F.greatest("longer", F.coalesce("beyond", F.lit(0)))).drop("beyond")


def collocations(documents: DataFrame, best: int = BEST, least: int = LEAST_COUNT) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score; see ``phrase_statistics`` for how texts are read.

    The score of a cut into a first part (l occurrences) and the rest (r) is floor(2000000 a / (l + r)), in decimals, so it is
    exact at any size; the cut of the lowest score counts, of equal ones the first. A phrase inside a longer frequent one with
    80 % of its occurrences is left out; it is enough to look one word further, as all phrases between occur as often. Order:
    score, a, both falling, then phrase by its bytes.
    """
    share, of = LEAST_SHARE
    score = f"CAST(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(fronts[k - 1] AS DECIMAL(19,0)) + CAST(backs[words - k - 1] AS DECIMAL(19,0))) AS BIGINT)"
    cut = f"array_min(transform(sequence(1, words - 1), k -> named_struct('score', {score}, 'k', k, 'l', fronts[k - 1], 'r', backs[words - k - 1])))"
    kept = phrase_statistics(documents, least).where(
        f"CAST({of} AS DECIMAL(9,0)) * CAST(longer AS DECIMAL(19,0)) < CAST({share} AS DECIMAL(9,0)) * CAST(a AS DECIMAL(19,0))")
    scored = kept.select("lang", "phrase", "a", "n", F.expr(cut).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents) AS parts),
words AS (SELECT piece, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
places AS (
  SELECT lang, w1, lead(w1, 1) OVER near AS w2, lead(w1, 2) OVER near AS w3, lead(w1, 3) OVER near AS w4
  FROM words WINDOW near AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, 1 AS o, w1 AS phrase, [w1] AS p, count(*) AS f FROM places GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, [w1, w2], count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, [w1, w2, w3], count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, [w1, w2, w3, w4], count(*) FROM places WHERE w4 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE o = 1 GROUP BY lang),
candidates AS (SELECT lang, o, phrase, p, f AS a FROM f WHERE o > 1 AND f >= 30),
keyed AS (SELECT lang || chr(9) || phrase AS key, f FROM f),
cuts AS (
  SELECT lang, phrase, o, a, k, lang || chr(9) || array_to_string(p[1:k], ' ') AS head, lang || chr(9) || array_to_string(p[k + 1:o], ' ') AS tail
  FROM candidates, (VALUES (1), (2), (3)) AS ks(k) WHERE k < o),
scored AS (
  SELECT c.lang, c.phrase, c.o, a, k, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts AS c JOIN keyed AS h ON h.key = c.head JOIN keyed AS t ON t.key = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest AS s WHERE NOT EXISTS (
    SELECT 1 FROM candidates AS c
    WHERE c.lang = s.lang AND c.o > s.o AND 100 * c.a >= 80 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_count_streams", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
