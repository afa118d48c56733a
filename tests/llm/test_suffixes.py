import collections
import hashlib
import random

import numpy as np
import pytest

from tablecraft.llm import suffixes
from tests.llm.conftest import SF_DIR, prose


def brute(texts, n=suffixes.LENGTH):
    datas = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + n] for d in datas for i in range(len(d) - n + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, batches=3):
    rows = df.select("doc_id", "text").collect()
    expected = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=str)
    assert sorted(map(tuple, suffixes.remove_repeats(df, batches).collect()), key=str) == expected
    return expected


def planted():
    rng = random.Random(4)
    shared = [prose(140, 900 + i) for i in range(4)]
    rows = []
    for i in range(60):
        text = prose(60 + i, i)
        for _ in range(i % 4):
            k, cut = rng.randrange(4), rng.randrange(0, 500)
            text = text[:rng.randrange(len(text))] + shared[k][cut:cut + rng.choice((399, 400, 401, 480, 700))] + text[rng.randrange(len(text)):]
        rows.append((i, text))
    rows += [(100 + i, "é" * 150 + prose(70, 7)[:100 + i] + "ab" * 300) for i in range(12)]
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_planted_repeats_of_all_lengths(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    found = check(spark.createDataFrame(planted(), "doc_id long, text string"))
    assert 20 < sum(r[2] > 0 for r in found) < 72


def test_any_number_of_batches(spark):
    df = spark.createDataFrame(planted()[:30], "doc_id long, text string")
    for batches in (1, 6):
        check(df, batches)


def test_documents(spark):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents.where("doc_id IS NULL OR doc_id NOT IN (9, 10)"))
    # the very long texts are copies of each other
    long_ = [r for r in suffixes.remove_repeats(odd_documents).collect() if r["doc_id"] in (9, 10)]
    assert all(r["n_removed"] == r["n_bytes"] > 200_000 and r["n_spans"] == 1 for r in long_)
    assert suffixes.remove_repeats(no_documents).count() == 0


def test_levels_grow_geometrically(spark):
    index = suffixes.SuffixIndex()
    texts = spark.createDataFrame(planted(), "doc_id long, text string").selectExpr("xxhash64(text) AS d1", "xxhash64(text, 7) AS d2", "text")
    for b in range(4):
        index.add(texts.where(f"pmod(d1, 4) = {b}").mapInArrow(suffixes._entries, suffixes.ENTRY_DDL))
        assert len(index.levels) <= 3
    whole = texts.mapInArrow(suffixes._entries, suffixes.ENTRY_DDL).groupBy("key", "context").count()
    assert sorted(map(tuple, index.all().groupBy("key", "context").sum("n").collect())) == sorted(map(tuple, whole.collect()))


def test_large_classes_dealt_by_places(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 2)
    monkeypatch.setattr(suffixes, "SHARE", 1 << 40)
    found = check(spark.createDataFrame(planted(), "doc_id long, text string"))
    assert 20 < sum(r[2] > 0 for r in found) < 72


def test_no_group_holds_a_large_class(spark, monkeypatch):
    # Texts that hold the same 200 bytes and differ around them: one class, of which no two contexts have a window in common.
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 20)
    seen, dealt = [], suffixes._dealt
    monkeypatch.setattr(suffixes, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    common = prose(60, 1)[:200]
    rows = [(i, f"{prose(80, 10 + i)} {common} {prose(80, 300 + i)}") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in seen[0].groupBy("group").count().collect()]
    assert sum(sizes) >= 200 and max(sizes) < sum(sizes) / 8
