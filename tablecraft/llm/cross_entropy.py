"""Cross-entropy difference of texts under matched target and background bigram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import U64, mix, signed, text_steps, word_hashes
from tablecraft.llm.registry import query, stored, table
from tablecraft.session import materialize

# Sizes of the bounded model of ``fit``, which cross_entropy does not use: the most frequent words, at most so many, all others
# being one unknown word, and pairs folded into a table of fixed size.
VOCABULARY, PAIRS = 1 << 17, 1 << 20
PAIR_WEIGHT, SMOOTH = 0.6, 0.1
# Ids of labelled documents that are sent to all tasks, 8 MB; more are joined by shuffle.
MOST_SENT = 1_000_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, U64)]
        for _, _, data, bounds in text_steps(batch.column(0)):
            found.append(word_hashes(data, bounds)[0])
        words, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n.astype(np.int64))], ["word", "n"])


class Vocabulary:
    """Numbers of words: places in the sorted list of hashes, and one number behind them for every other word."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words.astype(np.int64))
        self.unknown = len(self.words)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        hashes = signed(hashes)
        if not self.unknown:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), self.unknown - 1)
        return np.where(self.words[at] == hashes, at, self.unknown)

    def read(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number, the number before it (a start mark at a text's begin), their pair's slot, and each text's first word."""
        hashes, first = word_hashes(data, bounds)
        word = self.number(hashes)
        before = np.concatenate([[0], word[:-1]])[:len(word)]
        before[first[:-1][np.diff(first) > 0]] = self.unknown + 1
        slot = mix(before.astype(U64) * U64(VOCABULARY + 2) + word.astype(U64)) & U64(PAIRS - 1)
        return word, before, slot.astype(np.int64), first


def _fold(total: np.ndarray, slots: np.ndarray) -> None:
    total += np.bincount(slots, minlength=len(total))


class Model:
    """Counts of words and of pairs; the probability of a word mixes that after its predecessor with that of the word alone."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.alone = np.log2((words[:-1] + SMOOTH) / (words[:-1].sum() + SMOOTH * (len(words) - 1))).astype(np.float32)
        self.context = np.maximum(words, 1).astype(np.float32)
        self.seen = (words > 0).astype(np.float32) * PAIR_WEIGHT
        self.pairs = pairs.astype(np.float32)

    def loss(self, word: np.ndarray, before: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Bits of every word."""
        after = np.minimum(self.pairs[slot] / self.context[before], 1.0)
        weight = self.seen[before]
        return -np.log2(weight * after + (1.0 - weight) * np.exp2(self.alone[word]))


def _least_count(words: DataFrame) -> int:
    """The least count for which at most VOCABULARY words occur so often; words of one count are in or out together.

    Found from how many words have each count, of which the driver gets the highest; sorting all words is not needed.
    """
    held, least = 0, 1 << 62
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(VOCABULARY + 1)
    for row in by_count.toArrow().to_pylist():
        held += row["words"]
        if held > VOCABULARY:
            break
        least = row["n"]
    return least


def fit(background: DataFrame, target: DataFrame, spark: SparkSession):
    """The vocabulary and the two models of ``background(text)`` and ``target(text)``, counted over all of their texts.

    Words are counted in tasks and summed by word; the driver gets the most frequent ones, VOCABULARY at most, and the
    sums of at most PAIRS + VOCABULARY slots. An empty table gives a model that knows nothing, equal smoothing for every word.
    """
    words = background.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words)
    top = words.where(F.col("n") >= _least_count(words)).select("word").toArrow()["word"].to_numpy()
    shared = spark.sparkContext.broadcast(Vocabulary(top))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        sums = np.zeros((2, vocabulary.unknown + 2 + PAIRS), np.int64)
        for batch in batches:
            for kind in (0, 1):
                texts = batch.column(0).filter(pa.compute.equal(batch.column(1), kind))
                for _, _, data, bounds in text_steps(texts):
                    word, _, slot, first = vocabulary.read(data, bounds)
                    starts = np.full(int((np.diff(first) > 0).sum()), vocabulary.unknown + 1)
                    _fold(sums[kind], np.concatenate([word, starts, slot + vocabulary.unknown + 2]))
        for kind in (0, 1):
            at = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[kind][at])], ["kind", "slot", "n"])

    both = background.select("text", F.lit(0).alias("kind")).unionByName(target.select("text", F.lit(1).alias("kind")))
    counted = both.mapInArrow(count, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kinds, slots, n = (counted[c].to_numpy() for c in ("kind", "slot", "n"))
    models = []
    for kind in (0, 1):
        sums = np.zeros(len(top) + 2 + PAIRS, np.int64)
        sums[slots[kinds == kind]] = n[kinds == kind]
        models.append(Model(sums[:len(top) + 2], sums[len(top) + 2:]))
    return Vocabulary(top), models[0], models[1]


# Texts are counted and scored in blocks of about so many bytes; a row has ROW_BYTES besides its text. Keys are summed in buckets of
# what BUCKET_BYTES of text have.
BLOCK_BYTES, ROW_BYTES, BUCKET_BYTES = 16 << 20, 64, 16 << 20
# Keys of what is counted have 63 bits: the last is 0 for words, 1 for pairs. START stands before each text's first word.
START = U64(2)
# In place of a block: the target's counts, and the numbers of words that a bucket tells besides its answers.
TARGET, NUMBERS = -1, -2
PARTS = "block long, part long, bytes long, packed binary"
REQUESTS = "block long, part long, bucket int, n int, keys binary, counts binary"
ANSWERS = "block long, part long, bucket int, n int, background binary, good binary, known long, total long, wanted long"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in compressed parts with the number of their block; rows of one task fill one block after another."""
    base, held, part = TaskContext.get().partitionId() << 32, 0, 0
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)).astype(np.int64) + ROW_BYTES
        block = (held + np.cumsum(sizes) - sizes) // BLOCK_BYTES
        held += int(sizes.sum())
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for a, b in zip(edges, edges[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + int(block[a])]), pa.array([part]), pa.array([int(sizes[a:b].sum())]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], _names(PARTS))
            part += 1


def _rows(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from zero in as many bytes as the largest needs; all lowest bytes come first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(-1, n).T
    return out.view("<i8").ravel()


def _keys(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of every word of a text column, of the word before it (START at a text's begin) and of the pair, and each text's first word."""
    words, places, seen = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for _, _, data, bounds in text_steps(column):
        hashes, first = word_hashes(data, bounds)
        words.append(hashes >> U64(2) << U64(1))
        places.append(first[1:] + seen)
        seen += len(hashes)
    word, first = np.concatenate(words), np.concatenate(places)
    before = np.concatenate([[START], word[:-1]])[:len(word)]
    before[first[:-1][np.diff(first) > 0]] = START
    return signed(word), signed(before), signed(mix(mix(before) + word) >> U64(1) | U64(1)), first


def _counted(word: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs; START once for each text with words."""
    starts = np.full(int((np.diff(first) > 0).sum()), START).astype(np.int64)
    return np.unique(np.concatenate([word, pair, starts]), return_counts=True)


def _requests(buckets: int):
    width = (1 << 63) // buckets + 1
    lows = np.array([i * width for i in range(buckets)], np.int64)

    def ask(block: int, part: int, texts) -> pa.RecordBatch:
        """Counts of words and pairs of some texts, one row for each bucket that has keys of them."""
        word, _, pair, first = _keys(texts)
        keys, counts = _counted(word, pair, first)
        bucket = keys // width
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        own = bucket[edges[:-1]]
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own), block)), pa.array(np.full(len(own), part)), pa.array(own.astype(np.int32)),
             pa.array(np.diff(edges).astype(np.int32)),
             pa.array([_pack(np.diff(keys[a:b], prepend=lows[i])) for i, (a, b) in zip(own, spans)], pa.binary()),
             pa.array([_pack(counts[a:b]) for a, b in spans], pa.binary())], _names(REQUESTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                yield ask(block, part, _rows(packed).column("text"))

    def run_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield ask(TARGET, TARGET, batch.column(0))

    def merge(asked: pa.Table) -> pa.Table:
        """Sums of one bucket's keys over all documents and over the target, for every asker in its order, and those of all words."""
        block, n = asked.column("block").to_numpy(), asked.column("n").to_numpy()
        bucket = asked.column("bucket")[0].as_py()
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, k, c in zip(n, asked.column("keys"), asked.column("counts")):
            keys.append(lows[bucket] + np.cumsum(_unpack(k.as_py(), size)))
            counts.append(_unpack(c.as_py(), size))
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts, own = np.concatenate(counts), np.repeat(block >= 0, n)
        every, good = (np.bincount(at, weights=counts * mine, minlength=len(distinct)).astype(np.int64) for mine in (own, ~own))
        words = ((distinct & 1) == 0) & (distinct != int(START))
        ends = np.cumsum(n)
        askers = np.flatnonzero(block >= 0)
        places = [at[ends[i] - n[i]:ends[i]] for i in askers]
        told = pa.Table.from_arrays(
            [*(asked.column(c).take(pa.array(askers)) for c in ("block", "part", "bucket", "n")),
             *(pa.array([_pack(sums[p]) for p in places], pa.binary()) for sums in (every, good)),
             *(pa.nulls(len(askers), pa.int64()) for _ in range(3))], _names(ANSWERS))
        numbers = int((words & (every > 0)).sum()), int(every[words].sum()), int(good[words].sum())
        row = [NUMBERS, NUMBERS, bucket, 0, None, None, *numbers]
        return pa.concat_tables([told, pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, told.schema.types)], schema=told.schema)])

    return run, run_target, merge


def _bits(known: float, words: float, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Bits of every word from the model's counts of it, of the word before it and of their pair."""
    alone = (word + SMOOTH) / (words + SMOOTH * (known + 1))
    weight = PAIR_WEIGHT * (before > 0)
    return -np.log2(weight * np.minimum(pair / np.maximum(before, 1), 1.0) + (1.0 - weight) * alone)


def cross_entropy(documents: DataFrame, target: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_words, loss_target, loss_background, score.

    Losses are bits for each word of the whole text under the model of ``target(text)`` and the model of all documents;
    ``score`` is their difference, low for texts like the target. A null text or one without words has 0 words and null
    losses. Words are runs without white space, A-Z lower-cased. Rows are scored one by one, so repeated rows repeat;
    the target's own texts are part of both models. Other columns are not read.

    Every word and every pair of words has a count of its own, keyed by 63 bits of its hash. Texts are dealt into blocks of
    compressed parts. A part tells the counts of its distinct words and pairs, packed by ranges of keys, where it has any;
    these are summed by range, and the sums go back to the block. A key is told once a part, however often it occurs, so a
    hot one is no larger than others. Both exchanges have tasks in proportion to the texts.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    blocks = stored(documents.mapInArrow(_blocks, PARTS))
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(size // BUCKET_BYTES, 4 * least)
    run, run_target, merge = _requests(buckets)
    asked = blocks.mapInArrow(run, REQUESTS).unionByName(target.select("text").mapInArrow(run_target, REQUESTS))
    answers = stored(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, ANSWERS), "zstd")
    numbers = answers.where(F.col("block") == NUMBERS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "total", "wanted")])
    known, total, wanted = numbers.first()

    def score(parts: pa.Table, sums: pa.Table) -> pa.Table:
        sums = sums.sort_by([("part", "ascending"), ("bucket", "ascending")])
        owner = sums.column("part").to_numpy()
        out = [pa.table({c: pa.array([], t) for c, t in zip(SCORED, (pa.int64(), pa.int64(), *[pa.float64()] * 3))})]
        for number, packed in zip(parts.column("part").to_pylist(), parts.column("packed")):
            start, end = (int(np.searchsorted(owner, number, side=side)) for side in ("left", "right"))
            told = sums.slice(start, end - start)
            rows = _rows(packed)
            word, before, pair, first = _keys(rows.column("text").combine_chunks())
            keys, _ = _counted(word, pair, first)
            every, good = (np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py(), k) for x, k in zip(told.column(c), told.column("n").to_numpy()))])
                           for c in ("background", "good"))
            word, before, pair = (np.searchsorted(keys, k) for k in (word, before, pair))
            n = np.diff(first)
            empty = n == 0
            means = []
            for model, words in ((good, wanted), (every, total)):
                bits = _bits(known, words, model[word], model[before], model[pair])
                means.append(np.zeros(len(n)))
                if len(bits):  # summed text by text, so that equal texts score the same in every block
                    means[-1][~empty] = np.add.reduceat(bits, first[:-1][~empty]) / n[~empty]
            out.append(pa.Table.from_arrays(
                [rows.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(m, mask=empty) for m in (*means, means[0] - means[1]))], SCORED))
        return pa.concat_tables(out)

    tasks = max(size // BLOCK_BYTES, least)
    told = answers.where("block >= 0").select("block", "part", "bucket", "n", "background", "good")
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(told.repartition(tasks, "block").groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, loss_target double, loss_background double, score double")


SCORED = ["doc_id", "n_words", "loss_target", "loss_background", "score"]


@query("op9_cross_entropy_difference")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against those that are labelled as good."""
    documents = table(spark, sf_dir, "documents")
    good = materialize(spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where("quality = 1").select("doc_id").distinct())
    good = F.broadcast(good) if good.count() <= MOST_SENT else good
    return cross_entropy(documents, documents.join(good, "doc_id").select("text"))
