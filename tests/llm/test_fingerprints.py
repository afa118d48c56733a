import hashlib

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import fingerprints
from tests.llm.conftest import SF_DIR, prose
from tests.llm.test_hamming import shingles


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(df, most=0.2):
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    found = {r["doc_id"]: r for r in fingerprints.fingerprint(df).collect()}
    assert len(found) == len(rows)
    off = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = found[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) in (0, 512) and (len(r["fingerprint"]) == 0) == (not shingles(text))
        off += [r["near_edited"] - likeness(text, edited), r["near_next"] - likeness(text, after)]
    assert max(map(abs, off)) < most and abs(sum(off) / len(off)) < 0.02


def test_documents(spark):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_small_ranges_and_short_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(i * i - 50, prose(i % 13 if i % 3 else 40 + i, i // 2)) for i in range(60)] + [(9_000_000_000, None), (-5_000_000_000, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 0.4)  # texts of two shingles give rough estimates


@pytest.mark.parametrize("words", [3, 8, 40, 400])
def test_estimates_at_all_sizes(spark, words):
    """The mean error over many pairs is small, however many bins are empty."""
    rows = []
    for i in range(80):
        base = prose(words, 1000 + i).split()
        base[-1 - i % (words // 2 + 1)] = "changed"
        rows.append((prose(words, 1000 + i), " ".join(base)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_symbols(fingerprints.with_symbols(df, "a", "x"), "b", "y")
    found = df.select("a", "b", fingerprints.likeness(F.col("x"), F.col("y")).alias("e")).collect()
    off = [r["e"] - likeness(r["a"], r["b"]) for r in found]
    assert abs(sum(off) / len(off)) < 0.05


def test_odd_rows(spark, odd_documents, no_documents):
    found = fingerprints.fingerprint(odd_documents).collect()
    assert len(found) == 20
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    by = {}
    for r in found:
        by.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(by[t]) == 1 for t in (prose(200, 1), "one"))
    assert fingerprints.fingerprint(no_documents).count() == 0
    lone = fingerprints.fingerprint(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0 and lone["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()
