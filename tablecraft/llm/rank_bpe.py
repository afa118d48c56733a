"""Byte-level BPE encoding and decoding with a contiguous array of part boundaries and adjacent ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import text_steps
from tablecraft.llm.registry import map_batches, query, table, widened
from tablecraft.llm.token_cache import _cuts as word_cuts

# Fixed values of the byte-level format: white space as the format's own patterns read it, and the word pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
# One word of the pattern in any library's reading: Latin letters with at most one blank before them.
PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
# The scan of the whole rank array for its minimum is for short words; longer ones keep a heap beside the array.
SHORT = 256
MEMORY = 100_000
# Bytes of texts whose distinct parts are encoded together.
STEP = 1 << 22
NO_RANK = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The format writes each byte as one letter: printable ones as they are, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Bpe:
    """Encoder and decoder of one vocabulary file (a JSON of the byte-level kind).

    ``memory`` words are remembered with their ids; the memory is emptied when full. Texts of added tokens stand for
    those tokens, as in the format's own library. Bytes that are no UTF-8 decode to U+FFFD.
    """

    def __init__(self, source: str, memory: int = MEMORY):
        model = json.loads(source)
        vocab, letters = model["model"]["vocab"], _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items() if t not in self.added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.start = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in model["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        pairs = np.array([a * len(vocab) + b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.width, self.pairs, self.pair_rank = len(vocab), pairs[order], order.astype(np.int64)
        self.starts, self.merges = np.array(self.start, np.int64), np.array(self.merged, np.int64)
        self.id_text = pa.array([str(i).encode() for i in range(max(self.bytes_of) + 1)], pa.binary())
        self.id_bytes = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.binary())
        self.word = regex.compile(WORD)
        self.piece = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[str, bytes]] = {}
        self.memory = memory

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of least rank, leftmost first, becomes one part until no pair has a rank."""
        parts = [self.start[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = self.rank
        ranks = [rank.get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, NO_RANK where it is none or a part is missing (-1)."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        known = (left >= 0) & (right >= 0) & (len(self.pairs) > 0)
        return np.where(known & (self.pairs[at] == pair), self.pair_rank[at], NO_RANK) if len(self.pairs) else np.full(pair.shape, NO_RANK)

    def merge_matrix(self, data: np.ndarray) -> np.ndarray:
        """As ``merge`` for many words of one length, given as rows of bytes: rows of ids, -1 behind the last.

        Parts and adjacent ranks are matrices. A round finds each row's least rank, joins the two parts, closes the gap in
        both matrices and looks up the two ranks beside the join; rows without a rank are done.
        """
        parts, length = self.starts[data], data.shape[1]
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        open_, place = np.arange(len(parts)), np.arange(length)[None, :]
        while len(open_) and length > 1:
            r = ranks[open_]
            at = r.argmin(axis=1)
            low = r[np.arange(len(r)), at]
            go = low < NO_RANK
            open_, at, low, r = open_[go], at[go], low[go], r[go]
            p, row = parts[open_], np.arange(len(open_))
            p[row, at] = self.merges[low]
            p[:, :-1] = np.take_along_axis(p, place[:, :-1] + (place[:, :-1] > at[:, None]), 1)
            p[:, -1] = -1
            if length > 2:
                r[:, :-1] = np.take_along_axis(r, place[:, :-2] + (place[:, :-2] >= at[:, None]), 1)
            r[:, -1] = NO_RANK
            inner, behind = at < length - 1, at > 0
            r[row[inner], at[inner]] = self._ranks(p[row[inner], at[inner]], p[row[inner], at[inner] + 1])
            r[row[behind], at[behind] - 1] = self._ranks(p[row[behind], at[behind] - 1], p[row[behind], at[behind]])
            parts[open_], ranks[open_] = p, r
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word in n log n: boundaries are a linked list, stale heap entries are passed over."""
        n, rank = len(parts), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def _learn(self, piece: str) -> tuple[str, bytes]:
        ids = [i for w in self.word.findall(piece) for i in self.merge(w.encode("utf-8", "replace"))]
        out = ",".join(map(str, ids)), self.decode_bytes(ids)
        if len(piece) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode_parts(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of each distinct part of texts (large strings): its ids joined by commas, their number, and their bytes.

        Parts that are one word of plain letters are merged together, length by length; the others are cut into words first.
        """
        plain = np.asarray(pc.match_substring_regex(parts, PLAIN)) & (np.asarray(pc.binary_length(parts)) <= 64)
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset:parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        length, order, flat, counts = np.diff(offsets), [], [], []
        for n in np.unique(length[plain]).tolist():
            rows = np.flatnonzero(plain & (length == n))
            for i in range(0, len(rows), 1 << 15):
                some = rows[i:i + (1 << 15)]
                ids = self.merge_matrix(data[offsets[some][:, None] + np.arange(n)])
                order.append(some)
                flat.append(ids[ids >= 0])
                counts.append((ids >= 0).sum(axis=1))
        other = np.flatnonzero(~plain)
        found = [list(self.pieces(p)) for p in parts.take(pa.array(other)).to_pylist()]
        numbers = [",".join([i for i, _ in f]).encode() for f in found]
        tokens = np.concatenate([*counts, np.array([n.count(b",") + 1 for n in numbers], np.int64)]).astype(np.int64)
        lists, ids = np.concatenate([[0], *counts]).cumsum().astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *flat]))
        joined = [pa.concat_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array(lists), of.take(ids)), sep), pa.array(rest, pa.binary())])
                  for of, sep, rest in ((self.id_text, b",", numbers), (self.id_bytes, b"", [b"".join([x for _, x in f]) for f in found]))]
        back = np.argsort(np.concatenate([*order, other]), kind="stable")
        return joined[0].take(pa.array(back)), tokens[back], joined[1].take(pa.array(back))

    def pieces(self, text: str) -> Iterator[tuple[str, bytes]]:
        """(ids joined by commas, their bytes) of each run of white space with the run of other letters behind it.

        No word of the pattern reaches over the end of such a piece, so pieces can be encoded one by one.
        """
        known, learn = self.known, self._learn
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield str(self.added[part]), part.encode()
            else:
                for piece in self.piece.findall(part):
                    yield known.get(piece) or learn(piece)

    def whole_texts(self, column: pa.Array) -> Iterator[tuple[int, int, list[bytes], np.ndarray, list[bytes]]]:
        """Steps of a text column: first row, row after the last, and for each text its ids joined by commas, their number, their bytes.

        Texts are cut behind letters and before blanks, where words end in any case; each distinct part of a step is encoded once.
        """
        for first, last, data, bounds in text_steps(column, STEP):
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[bounds] = edge[word_cuts(data)] = True
            edges = np.flatnonzero(edge)
            buffers = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
            parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, buffers).dictionary_encode()
            ids, tokens, backs = self.encode_parts(parts.dictionary)
            at = np.searchsorted(edges, bounds)
            texts = pa.array(at, pa.int32())
            joined = [pc.binary_join(pa.ListArray.from_arrays(texts, x.take(parts.indices)), sep).to_pylist() for x, sep in ((ids, b","), (backs, b""))]
            sums = np.concatenate([[0], np.cumsum(tokens[parts.indices.to_numpy()])])
            yield first, last, joined[0], np.diff(sums[at]), joined[1]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def _loaded(shared) -> Bpe:
    """The worker's encoder of a vocabulary, so that remembered words serve many batches; workers outlive queries, so they keep one only."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = Bpe(shared.value)
    return _LOADED[shared.id]


def _share(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class _Shared:
    """A broadcast text together with its digest, by which every worker knows it, whichever query sent it."""

    def __init__(self, cast):
        self.cast, self.id = cast, hashlib.sha256(cast.value.encode("utf-8", "surrogatepass")).hexdigest()

    @property
    def value(self):
        return self.cast.value

    def __reduce__(self):
        return _restore, (self.cast, self.id)


def _restore(cast, number):
    out = object.__new__(_Shared)
    out.cast, out.id = cast, number
    return out


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """The input's columns (one named as ``ids`` gives way) and ``ids``, the token ids of each whole text.

    Null and empty texts have an empty list. ``path`` names the vocabulary file on the driver; its text, a few
    megabytes, is broadcast. Words are remembered up to a fixed number, so memory does not grow with the input.
    """
    shared = _Shared(_share(df.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                lists = pa.array([bpe.encode(t or "") for t in part.column(place).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids])

    kept = df.drop(ids)
    place = kept.columns.index(text)
    return map_batches(kept, run, widened(kept.schema, f"`{ids}` array<int>"))


def encode_checked(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """As ``encode``, with ``n_tokens`` and ``round_trip``, whether the ids decode to the text (null read as empty).

    Decoding stays in the same pass, so a task needs one Python worker. Input columns of the added names give way.
    """
    added = ["ids", "n_tokens", "round_trip"]
    shared = _Shared(_share(df.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                texts = [t or "" for t in part.column(place).to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                columns = [
                    pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([bpe.decode(i) == t for i, t in zip(ids, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    kept = df.drop(*added)
    place = kept.columns.index(text)
    return map_batches(kept, run, widened(kept.schema, "ids array<int>, n_tokens long, round_trip boolean"))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "text") -> DataFrame:
    """The input's columns (one named as ``text`` gives way) and ``text``, the text of each list of ids.

    A null list gives null; an id outside the vocabulary fails the job.
    """
    shared = _Shared(_share(df.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text])

    kept = df.drop(text)
    place = kept.columns.index(ids)
    return map_batches(kept, run, widened(kept.schema, f"`{text}` string"))


def token_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``df(doc_id, text)``: n_tokens, ids_sha256 and decoded_sha256 of its whole text, encoded and decoded back.

    A null text counts as empty: no tokens, digests of the empty string. Row for row, so repeated rows repeat.
    """
    shared = _Shared(_share(df.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in batches:
            for first, last, ids, tokens, backs in bpe.whole_texts(batch.column(1)):
                digests = [hashlib.sha256(i).hexdigest() for i in ids]
                backs = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in backs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(tokens), pa.array(digests, pa.string()), pa.array(backs, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op8_rank_array_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
