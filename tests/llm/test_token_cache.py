import random
from functools import cache

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablecraft.llm import token_cache
from tablecraft.llm.queries import QUERIES
from tablecraft.llm.token_cache import Counter, token_counts
from tests.llm.conftest import SF_DIR, prose

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def source(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def counters():
    return {name: Counter(name, source(name)) for name in FILES}


@cache
def library(name):
    """The library's own encoder of whole texts."""
    if name.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: model.encode(text, add_special_tokens=False).ids


def library_counts(name, texts):
    return [len(library(name)(t or "")) for t in texts]


PIECES = st.sampled_from(
    ["the", " The", "'s", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", " ", "\x85", "\x1c", "\x1f", "\x0b", "é", "à ", "ß", "日本", "😀", "12", " 3", "_",
     "--", "<|endoftext|>", " <|endoftext|> ", "<|end", "​", "x" * 70, " ", "\x00", "\x7f"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=12).map("".join)), max_size=5))
def test_counts_are_those_of_the_library(counters, texts):
    for name in FILES:
        assert counters[name](pa.array(texts, pa.string())).tolist() == library_counts(name, texts)


def test_memory_that_is_full_starts_anew(monkeypatch):
    monkeypatch.setattr(token_cache, "MEMORY", 40)
    count = Counter(FILES[0], source(FILES[0]))
    texts = [prose(60, seed) for seed in range(20)]
    for _ in range(2):
        assert count(pa.array(texts)).tolist() == library_counts(FILES[0], texts)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most_sent", [0, 1000])
@pytest.mark.parametrize("name", FILES)
def test_odd_rows(odd_documents, no_documents, tmp_path, name, most_sent):
    path = public_tokenizers.path(name)
    given_rows = odd_documents.select("doc_id", "text").collect()
    expected = [(d, len((t or "").encode()), n) for (d, t), n in zip(given_rows, library_counts(name, [t for _, t in given_rows]))]
    found = token_counts(odd_documents.select("doc_id", "text"), str(tmp_path / "c"), path=path, most_sent=most_sent)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert rows(found) == sorted(expected, key=str)
    wide = token_counts(odd_documents.withColumn("n_tokens", F.lit("x")), str(tmp_path / "c"), path=path)
    assert wide.columns == [c for c in odd_documents.columns if c != "text"] + ["n_bytes", "n_tokens"]
    assert wide.count() == len(given_rows)
    assert token_counts(no_documents, str(tmp_path / "none"), path=path).count() == 0


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    """Stored counts are taken as they are; each new content is added once, whatever its copies."""
    folder = str(tmp_path / "cache")
    first = spark.createDataFrame([(i, prose(20, i % 4)) for i in range(40)], "doc_id long, text string")
    token_counts(first, folder).collect()
    version, = (str(p) for p in (tmp_path / "cache").iterdir())
    assert spark.read.parquet(version).count() == 4
    marked = spark.read.parquet(version).withColumn("n_tokens", F.lit(7_000_000).cast("long")).collect()
    spark.createDataFrame(marked, token_cache.CACHED).write.mode("overwrite").parquet(version)
    both = first.unionByName(spark.createDataFrame([(100 + i, prose(20, 50 + i % 3)) for i in range(30)], first.schema))
    found = {r.doc_id: r.n_tokens for r in token_counts(both, folder).collect()}
    assert all(found[i] == 7_000_000 for i in range(40))
    assert [found[100 + i] for i in range(30)] == library_counts(FILES[0], [prose(20, 50 + i % 3) for i in range(30)])
    assert spark.read.parquet(version).count() == 7


def test_versions_have_their_own_counts_and_equal_rows_of_two_jobs_are_one(spark, tmp_path):
    folder = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Hello there world"), (2, "Hello there world")], "doc_id long, text string")
    for name in FILES:
        assert {r.n_tokens for r in token_counts(docs, folder, path=public_tokenizers.path(name)).collect()} == set(
            library_counts(name, ["Hello there world"]))
    versions = [str(p) for p in (tmp_path / "cache").iterdir()]
    assert len(versions) == 3
    for version in versions:
        twice = spark.read.parquet(version).collect()
        spark.createDataFrame(twice, token_cache.CACHED).write.mode("append").parquet(version)
    assert rows(token_counts(docs, folder).select("doc_id")) == [(1,), (2,)]


def test_a_text_on_a_third_of_the_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = ["same words here" if i % 3 == 0 else prose(rng.randint(0, 30), i) for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, str(tmp_path / "c")).collect()}
    assert [found[i] for i in range(6000)] == library_counts(FILES[0], texts)


def test_the_query(spark):
    found = {r.doc_id: r for r in QUERIES["op13_digest_cache"](spark, SF_DIR).collect()}
    given_rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    counts = library_counts(FILES[0], [t for _, t in given_rows])
    assert len(found) == len(given_rows)
    for (doc_id, text), n in zip(given_rows, counts):
        assert (found[doc_id].n_bytes, found[doc_id].n_tokens, found[doc_id].over_limit) == (len(text.encode()), n, n > 512)
