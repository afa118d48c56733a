import collections
import math

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import cross_entropy as ce
from tests.llm.conftest import SF_DIR, prose
from tests.llm.test_bytehash import split


def brute(rows, target, vocabulary=None):
    """Losses by counting words and pairs of words in dictionaries."""
    counted = collections.Counter(w for _, t in rows for w in split(t))
    known = set(counted if vocabulary is None else [w for w, _ in counted.most_common(vocabulary)])
    read = lambda t: [w if w in known else None for w in split(t)]

    def model(texts):
        words, pairs = collections.Counter(), collections.Counter()
        for t in texts:
            ws = read(t)
            if ws:
                words.update(ws)
                words["^"] += 1
                pairs.update(zip(["^", *ws], ws))
        total = sum(words.values()) - words["^"]

        def loss(ws):
            out = 0.0
            for a, b in zip(["^", *ws], ws):
                alone = (words[b] + ce.SMOOTH) / (total + ce.SMOOTH * (len(known) + 1))
                weight = ce.PAIR_WEIGHT if words[a] else 0.0
                out -= math.log2(weight * min(1.0, pairs[a, b] / max(words[a], 1)) + (1 - weight) * alone)
            return out / len(ws)

        return loss

    good, all_ = model(target), model([t for _, t in rows])
    return {i: (len(read(t)), good(read(t)), all_(read(t))) if read(t) else (0, None, None) for i, t in rows}


def check(spark, rows, target):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ce.cross_entropy(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    expected = brute(rows, target)
    assert len(found) == len(rows)
    for r in found:
        n, good, all_ = expected[r["doc_id"]]
        assert r["n_words"] == n
        if n:
            assert r["loss_target"] == pytest.approx(good, abs=2e-3) and r["loss_background"] == pytest.approx(all_, abs=2e-3)
            assert r["score"] == pytest.approx(good - all_, abs=4e-3)
        else:
            assert r["loss_target"] is None and r["score"] is None


def test_losses_by_counting(spark):
    rows = [(i, prose(20 + i, i % 7)) for i in range(40)] + [(100, None), (101, ""), (102, " \n"), (103, "unseen Words here"), (104, "UNSEEN words")]
    check(spark, rows, [prose(20 + i, i % 7) for i in range(0, 40, 5)])


def test_a_vocabulary_that_is_too_small_for_all_words(spark, monkeypatch):
    """Words of one count are in or out together."""
    monkeypatch.setattr(ce, "VOCABULARY", 9)
    text = "a a a a b b b b c c c d d d e e f f g h i j k"
    words = spark.createDataFrame([(w,) for w in text.split()], "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    assert ce._least_count(words) == 2
    monkeypatch.setattr(ce, "VOCABULARY", 11)
    assert ce._least_count(words) == 1
    monkeypatch.setattr(ce, "VOCABULARY", 1)
    assert words.where(F.col("n") >= ce._least_count(words)).count() == 0
    vocabulary, background, _ = ce.fit(spark.createDataFrame([(text,)], "text string"), spark.createDataFrame([], "text string"), spark)
    assert vocabulary.unknown == 0 and len(background.alone) == 1


def test_every_word_and_pair_has_its_own_count(spark, monkeypatch):
    """No count depends on table sizes: more words than VOCABULARY, more pairs than PAIRS, many blocks."""
    monkeypatch.setattr(ce, "VOCABULARY", 8)
    monkeypatch.setattr(ce, "PAIRS", 16)
    monkeypatch.setattr(ce, "BLOCK_BYTES", 2000)
    rows = [(i, prose(60 + i, i % 31)) for i in range(120)] + [(500 + i, "one very common line") for i in range(40)] + [(600, None)]
    check(spark, rows, [prose(60 + i, i % 31) for i in range(0, 120, 7)] + ["words that stand in no document", "one very common line"])


def test_no_target_and_no_documents(spark, no_documents):
    check(spark, [(1, "a b c"), (2, "a b")], [])
    assert ce.cross_entropy(no_documents, no_documents.select("text")).count() == 0


def test_odd_rows(odd_documents):
    found = ce.cross_entropy(odd_documents, odd_documents.where("source = 'a'").select("text")).collect()
    assert len(found) == 20 and sum(r["score"] is None for r in found) == 4
    assert len({r["score"] for r in found if r["doc_id"] == 15}) == 1


def test_good_documents_score_lower_on_unseen_labels(spark):
    """The target is half of the good documents; the other half scores below the bad ones."""
    folder = SF_DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1 AND doc_id % 2 = 0").select("doc_id"), "doc_id").select("text")
    rows = ce.cross_entropy(docs, good).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas().dropna(subset=["score"])
    a, b = (rows[rows["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (a[:, None] < b[None, :]).mean() > 0.8
