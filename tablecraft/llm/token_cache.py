"""Token counts from a cache keyed by the digest of a text and by the digest of the tokenizer's version."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import text_steps
from tablecraft.llm.registry import query, quoted, stored, table, unused
from tablecraft.session import ensure_checkpoint_dir

CACHED = "content binary, n_tokens long"
# Digests of texts that are not in the cache, sent to all tasks while they are so few (32 bytes each); more meet the texts by a shuffle.
MOST_SENT = 200_000
# A text that has more than one row in so many is hot; there are fewer of them than this number, so they are sent to all tasks.
HOT_SHARE = 1000
# Parts of texts whose counts a worker remembers.
MEMORY = 300_000
LIMIT = 512


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places before which the byte-level format always ends a word: a blank, tab or line break behind a letter or mark.

    Behind white space of any kind, or a byte that may end a wider white-space character, there is no cut.
    """
    blank = np.isin(data, np.frombuffer(b"\t\n\r ", np.uint8))
    open_ = (data <= 0x20) | (data == 0x7F) | ((data >= 0x80) & (data <= 0xAF))
    return np.flatnonzero(blank[1:] & ~open_[:-1]) + 1


class Counter:
    """Counts tokens of texts as the vocabulary file's own library does: tokenizers for .json, sentencepiece for .model.

    No begin, end or added special tokens, no truncation or padding; special strings inside texts as by the library's default.
    Files of the byte-level kind are counted by parts cut at blanks, each distinct part once: no word of theirs reaches over
    such a cut. Other files are counted by whole texts.
    """

    def __init__(self, name: str, source: bytes):
        self.by_parts = False
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=source)
            self.library = f"sentencepiece {sentencepiece.__version__}"
            self._count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the parallelism
            import tokenizers

            model = tokenizers.Tokenizer.from_str(source.decode())
            model.no_truncation()
            model.no_padding()
            self.library = f"tokenizers {tokenizers.__version__}"
            self._count = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_parts = self._is_plain_byte_level(json.loads(source))
        self.known, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    @staticmethod
    def _is_plain_byte_level(model: dict) -> bool:
        """Whether words depend on nothing beyond a cut: byte-level words, no normaliser, added tokens that take no white space."""
        words = model.get("pre_tokenizer") or {}
        plain = words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and words.get("use_regex", True)
        added = model.get("added_tokens") or []
        free = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set("\t\n\r ") for t in added)
        return plain and free and model.get("normalizer") is None

    def _some(self, texts: list[str]) -> np.ndarray:
        found = [n for i in range(0, len(texts), 256) for n in self._count(texts[i:i + 256])]
        return np.array(found, dtype=np.int64)

    def _parts(self, parts: pa.Array) -> np.ndarray:
        """Counts of distinct parts: those remembered, and the others from the library. The memory starts anew when full."""
        at = pc.index_in(parts, value_set=self.known)
        new = np.asarray(at.is_null())
        out = np.zeros(len(parts), np.int64)
        out[~new] = self.counts[at.drop_null().to_numpy(zero_copy_only=False)]
        if new.any():
            missed = parts.filter(pa.array(new))
            out[new] = self._some(missed.to_pylist())
            if len(self.known) + len(missed) > MEMORY:
                self.known, self.counts = self.known[:0], self.counts[:0]
            short = np.asarray(pc.binary_length(missed)) <= 64
            self.known = pa.concat_arrays([self.known, missed.filter(pa.array(short))])
            self.counts = np.concatenate([self.counts, out[new][short]])
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        if not self.by_parts:
            return self._some([t or "" for t in texts.to_pylist()])
        out = [np.zeros(0, np.int64)]
        for _, _, data, bounds in text_steps(texts, 1 << 22):
            edges = np.unique(np.concatenate([bounds, _cuts(data)])).astype(np.int64)
            buffers = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
            parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, buffers).dictionary_encode()
            counts = self._parts(parts.dictionary)[parts.indices.to_numpy()]
            sums = np.concatenate([[0], np.cumsum(counts)])
            out.append(np.diff(sums[np.searchsorted(edges, bounds)]))
        return np.concatenate(out)


_LOADED: dict[str, Counter] = {}


def _loaded(version: str, name: str, source: bytes) -> Counter:
    """One counter for each version and Python worker, so that what it remembers serves many batches."""
    if version not in _LOADED:
        _LOADED[version] = Counter(name, source)
    return _LOADED[version]


def _cache(spark: SparkSession, folder: str, version: str) -> tuple[str, DataFrame]:
    """The cache's folder for a version, made where it is missing, and its counts, one row a text even if two jobs added it."""
    path = f"{folder.rstrip('/')}/tokenizer={version}"
    spark.createDataFrame([], CACHED).write.mode("append").parquet(path)
    return path, spark.read.schema(CACHED).parquet(path).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def as_is(text: Column) -> Column:
    """The content of a text for tokenizers that tell any two texts apart; a null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def token_counts(df: DataFrame, cache: str, text: str = "text", path: str | None = None, normal: Callable[[Column], Column] = as_is,
                 most_sent: int = MOST_SENT) -> DataFrame:
    """The columns of ``df`` except ``text``, then n_bytes (UTF-8 length of the content) and n_tokens, row for row.

    ``cache`` is a folder that all executors and the driver share; it is made if missing and holds, for each tokenizer version
    (digest of file and library release), the SHA-256 of every content counted so far with its number of tokens. Texts that are
    in it are not encoded; of the others each distinct content is encoded once and appended. A job that fails has appended
    all or nothing of its misses; one that runs twice at a time appends equal rows, which are read as one. ``normal`` gives the
    content of a text; use one that joins texts only if the tokenizer gives them equal counts. ``path`` names the vocabulary
    file on the driver (default byte_bpe_50k.json); its bytes, a few megabytes, are broadcast.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows repeat, an empty table gives no rows, and input columns
    named n_bytes or n_tokens give way. Rows of a text that has over a thousandth of all rows get its count by broadcast.
    """
    spark = df.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        source = f.read()
    name = os.path.basename(path)
    version = hashlib.sha256(Counter(name, source).library.encode() + b"\n" + source).hexdigest()
    shared = spark.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _loaded(version, name, shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1)))], ["content", "n_tokens"])

    df = df.drop("n_bytes", "n_tokens")
    others = [c for c in df.columns if c != text]
    digest, content = unused(df, "__digest", "__content")
    whole = normal(F.col(quoted([text])[0]))
    digests = F.unhex(F.sha2(whole, 256))
    keyed = stored(df.select(*quoted(others), digests.alias(digest), F.octet_length(whole).cast("long").alias("n_bytes")))
    folder, cached = _cache(spark, cache, version)
    groups = keyed.groupBy(F.col(digest).alias("content")).agg(F.count(F.lit(1)).alias("copies"))
    missed = stored(groups.join(cached, "content", "left_anti").select("content"))
    texts = df.select(digests.alias("content"), whole.alias("text"))
    few = missed.count() <= most_sent
    if few:
        texts = texts.join(F.broadcast(missed), "content", "left_semi")
    once = texts.groupBy("content").agg(F.first("text").alias("text"))  # copies meet in their map task before they are shuffled
    if not few:
        once = once.join(missed, "content", "left_semi")
    once.mapInArrow(run, CACHED).write.mode("append").parquet(folder)
    counts = _cache(spark, cache, version)[1].withColumnRenamed("content", digest)
    hot = groups.crossJoin(F.broadcast(keyed.agg(F.count(F.lit(1)).alias("rows")))).where(F.col("copies") * HOT_SHARE > F.col("rows"))
    hot = stored(counts.join(hot.select(F.col("content").alias(digest)), digest, "left_semi"))
    rows = keyed.join(F.broadcast(hot), digest).unionByName(keyed.join(F.broadcast(hot), digest, "left_anti").join(counts, digest))
    return rows.select(*quoted(others), "n_bytes", "n_tokens")


@query("op13_digest_cache")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the cache is the folder of spark.tablecraft.tokencache, a new one in the shared folder where that is unset."""
    cache = spark.conf.get("spark.tablecraft.tokencache", None) or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return token_counts(documents, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)
