"""Language mixture of a text: proportions by expectation-maximisation, the set of languages by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import LOWER, text_steps
from tablecraft.llm.registry import map_batches, query, table, widened
from tablecraft.session import materialize

UNDETERMINED = "und"
BUCKETS = 1 << 16
ROUNDS, STAY = 12, 1e-3
SLICES = 1024


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of every distinct byte trigram, ordered by text."""
    n = len(data)
    if n < 3:
        return (np.zeros(0, np.int64),) * 3
    x = LOWER[data].astype(np.uint32)
    code = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:-2] == owner[2:]
    key = np.sort((owner[:-2][inside].astype(np.uint64) << np.uint64(16)) | code[inside])
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), count


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """(lang, place, bound) of every label, the most frequent first: rows of a draw up to the bound are at most ``most`` distinct ones.

    ``rows(lang, draw)`` are distinct draws from 63 bits. A label of more than ``most`` rows is counted in SLICES slices of a range
    that is expected to hold half as many again; its bound is the end of the last slice within ``most``.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    ranges = [(r["lang"], place, (1 << 63) - 1 if r["count"] <= most else max(SLICES, int(1.5 * most / r["count"] * (1 << 63))) // SLICES, r["count"])
              for place, r in enumerate(sizes)]
    wide = spark.createDataFrame(ranges, "lang string, place int, width long, size long")
    slices = rows.join(F.broadcast(wide.where(F.col("size") > most)), "lang").withColumn("slice", F.expr("draw div width")).where(
        F.col("slice") < SLICES).groupBy("place", "slice").count().toArrow().sort_by([("place", "ascending"), ("slice", "ascending")])
    held, ends = {}, {}
    for r in slices.to_pylist():
        held[r["place"]] = held.get(r["place"], 0) + r["count"]
        if held[r["place"]] <= most:
            ends[r["place"]] = r["slice"] + 1
    bounds = [(lang, place, width if size <= most else ends.get(place, 1) * width - 1) for lang, place, width, size in ranges]
    return spark.createDataFrame(bounds, "lang string, place int, bound long")


def learn(labelled: DataFrame, documents_per_language: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages, the most frequent first, and for each trigram bucket its probability in each of them.

    Every label is learned. Fitted on a bounded sample of rows, as classifiers may be: at most ``documents_per_language``
    of each label, chosen by a hash of the text and, if there is one, its doc_id; rows that repeat both count once. Rows
    without text or label are passed over. Counting runs in tasks; the driver gets at most 65,536 sums for each language,
    and the model that it sends out has 256 kB for each.
    """
    found = [c for c in labelled.columns if c.lower() == "doc_id"]
    draw = F.shiftrightunsigned(F.xxhash64("text", *found), 1)
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", draw.alias("draw"))
    bounds = _drawn(materialize(labelled.select("lang", "draw").distinct()), documents_per_language)
    names = [r["lang"] for r in bounds.orderBy("place").collect()]
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    chosen = labelled.join(F.broadcast(bounds), "lang").where("draw <= bound").groupBy("place", "draw").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(0)).astype(np.int64)
            for first, last, data, bounds in text_steps(batch.column(1)):
                owner, bucket, n = _grams(data, bounds)
                key, at = np.unique(label[first:last][owner] * BUCKETS + bucket, return_inverse=True)
                sums = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // BUCKETS).astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(sums)], ["lang", "bucket", "n"])

    counted = chosen.select("place", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    seen = counted.toArrow()
    table_ = np.zeros((BUCKETS, len(names)), np.float32)
    table_[seen["bucket"].to_numpy(), seen["lang"].to_numpy()] = seen["n"].to_numpy()
    smooth = 0.1
    return names, ((table_ + np.float32(smooth)) / (table_.sum(0, dtype=np.float64) + smooth * BUCKETS).astype(np.float32))


class Mixture:
    """Proportions of all texts of one step at once, from their distinct trigrams."""

    def __init__(self, owner, bucket, count, texts: int, model: np.ndarray):
        self.texts, self.count = texts, count.astype(np.float32)
        self.like = model[bucket]
        self.start = np.searchsorted(owner, np.arange(texts))
        self.n = np.bincount(owner, weights=count, minlength=texts)
        self.owner = owner

    def _sum(self, x: np.ndarray) -> np.ndarray:
        """Sums by text; texts without trigrams get zero."""
        if not len(x):
            return np.zeros((self.texts, *x.shape[1:]))
        out = np.add.reduceat(x, np.minimum(self.start, len(x) - 1), axis=0).astype(np.float64)
        out[self.n == 0] = 0
        return out

    def fit(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the allowed languages and the log likelihood under them."""
        share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
        for _ in range(ROUNDS):
            mixed = self.like * share[self.owner].astype(np.float32)
            mixed *= (self.count / mixed.sum(1))[:, None]
            new = self._sum(mixed) / np.maximum(self.n, 1)[:, None]
            done = np.abs(new - share).max(initial=0) < STAY
            share = new
            if done:
                break
        total = (self.like * share[self.owner].astype(np.float32)).sum(1)
        return share, self._sum((self.count * np.log(np.maximum(total, 1e-30)))[:, None])[:, 0]

    def take(self, texts: np.ndarray) -> Mixture:
        out = object.__new__(Mixture)
        keep = np.zeros(self.texts, bool)
        keep[texts] = True
        rows = keep[self.owner]
        out.texts, out.count, out.like, out.n = len(texts), self.count[rows], self.like[rows], self.n[texts]
        out.owner = (np.cumsum(keep) - 1)[self.owner[rows]]
        out.start = np.searchsorted(out.owner, np.arange(out.texts))
        return out

    def select(self, penalty: float) -> np.ndarray:
        """Proportions over the chosen set of each text.

        A language costs ``penalty`` times half the log of the text's trigrams. Every letter is in three trigrams, so
        likelihoods count a third. The full set is the best any set can do: where the best single language is within
        the price of one more, it is chosen at once; from the other texts the least language is taken away as long as
        that costs less than its price.
        """
        languages = self.like.shape[1]
        share, full = self.fit(np.ones((self.texts, languages)))
        single = self._sum(self.count[:, None] * np.log(self.like))
        price = penalty * 0.5 * np.log(np.maximum(self.n, 2))
        best = single.argmax(1)
        out = np.zeros((self.texts, languages))
        alone = (full - single[np.arange(self.texts), best]) / 3 <= price
        out[alone, best[alone]] = 1
        rest = np.flatnonzero(~alone)
        out[rest] = share[rest]
        while len(rest) and languages > 1:
            part = self.take(rest)
            share, like = out[rest], full[rest]
            share = np.where(share > 0, share, np.inf)
            less = np.isfinite(share) & (np.arange(languages) != share.argmin(1)[:, None])
            shorter, less_like = part.fit(less.astype(float))
            better = ((like - less_like) / 3 <= price[rest]) & (less.sum(1) > 0)
            out[rest[better]], full[rest[better]] = shorter[better], less_like[better]
            rest = rest[better][less[better].sum(1) > 1]
        return out


ADDED = "lang_pred string, score double, languages array<string>, proportions array<double>"


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 8.0) -> DataFrame:
    """The input's columns (``lang_pred``, ``score``, ``languages`` and ``proportions`` among them give way) and

    lang_pred, the language of the largest share of the whole text; score, that share; languages and proportions,
    the chosen set by falling share. A null text, a text without a letter and an untrained model give ``und``, score 0
    and empty lists; a text of under three bytes is judged on no evidence and gets the most frequent language.
    Ties go to the more frequent language. Only ``text`` is read for a prediction.
    """
    names, table_ = model
    shared = df.sparkSession.sparkContext.broadcast((names, table_))
    added = ("lang_pred", "score", "languages", "proportions")
    kept = df.drop(*added)
    place = kept.columns.index(text)
    step = max(1 << 14, (1 << 22) // max(4, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_ = shared.value
        labels = np.array(names, dtype=object)
        for batch in batches:
            column = batch.column(place)
            for first, last, data, bounds in text_steps(column, step):
                lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in column.slice(first, last - first).to_pylist()], bool)
                if names:
                    shares = Mixture(*_grams(data, bounds), last - first, table_).select(penalty)
                    shares[shares.sum(1) == 0, 0] = 1
                else:
                    shares, lettered = np.zeros((last - first, 0)), lettered & False
                order = np.argsort(-shares, axis=1, kind="stable")
                pred, score, langs, parts = [], [], [], []
                for row, (line, rank, ok) in enumerate(zip(shares, order, lettered)):
                    rank = rank[line[rank] > 0] if ok else []
                    pred.append(labels[rank[0]] if ok else UNDETERMINED)
                    score.append(min(1.0, float(line[rank[0]])) if ok else 0.0)
                    langs.append(list(labels[rank]) if ok else [])
                    parts.append([float(x) for x in line[rank]] if ok else [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, last - first).columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], [*batch.schema.names, *added])

    return map_batches(kept, run, widened(kept.schema, ADDED))


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is divisible by five. A null id is in neither half."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(documents.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"))
    found = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return identify(found, model).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")
