import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tablecraft.llm import treap
from tablecraft.llm.treap import Best, Shard, _build, _terms, build_index, search
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(documents, items, limit=50):
    """Every document scored for every distinct item, by the rule itself."""
    split = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    big_n = sum(1 for _, c in split if c)
    big_l = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item_id, text in set(items):
        if text is None:
            continue
        scored = []
        for doc_id, c in split:
            n = sum(c.values())
            m = 50 + (50 * n * big_n) // max(big_l, 1)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:limit], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


def found(spark, documents, items, limit=50):
    docs = spark.createDataFrame(documents, "doc_id long, text string") if isinstance(documents, list) else documents
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search(build_index(docs), asked, limit).collect()), key=str)


def test_odd_rows(spark, odd_documents, no_documents):
    items = [(1, prose(30, 1)), (1, prose(30, 1)), (2, None), (3, ""), (4, "--- !"), (5, "ONE one 日本語 é"), (5, "absent words"), (None, prose(9, 5)),
             (6, prose(4000, 99)), (7, "12 x34")]
    documents = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(spark, odd_documents, items) == by_hand(documents, items)
    assert found(spark, no_documents, items) == []
    assert found(spark, odd_documents, []) == []


@pytest.mark.parametrize("shard", [1, 7, 1 << 16])
def test_shards_blocks_and_ties(spark, monkeypatch, shard):
    """Ties beyond the limit, copies on a third of the rows, many small shards and blocks of items."""
    monkeypatch.setattr(treap, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(treap, "ITEM_BYTES", 300)
    rng = random.Random(shard)
    words = [f"w{i}" for i in range(60)]
    texts = ["w1 w2 W3" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 25))) for i in range(300)]
    documents = [(rng.choice([i, i, 7]), t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(50, "w2 w1"), (51, "nothing")]
    for limit in (1, 9, 50):
        assert found(spark, documents, items, limit) == by_hand(documents, items, limit)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65])
def test_grid_of_any_width(n):
    """Levels telescope to the impacts: a descent that leaves nothing out gives every document with its own score."""
    texts = [prose(i % 9, i) for i in range(n)]
    found_terms, sizes = _terms(pa.array(texts))
    made = _build(pa.array(range(n)), pa.array(texts), n, int(sizes.sum()))
    shard = Shard(dict(zip(treap._names(treap.SHARDS), made)))
    asked = found_terms.dictionary.cast(pa.string())
    best = Best(n, 0)
    if len(asked):
        shard.search(shard.rows(asked), shard.rows(asked) * 0 + 1, best)
    expected = {}
    for i, text in enumerate(texts):
        c, m = Counter(terms(text)), 50 + 50 * len(terms(text)) * n // max(int(sizes.sum()), 1)
        expected[i] = sum(1_000_000_000 * tf // (1000 * tf + 20 * m) for tf in c.values())
    assert dict(zip(best.ids.tolist(), best.scores.tolist())) == {i: s for i, s in expected.items() if s > 0}


def test_most_ranges_stay_closed():
    """Best-first search with bounds opens a small part of the ranges when few documents hold the item's rare words."""
    texts = [prose(80, i) + (" zulu yankee" if i % 400 == 0 else "") for i in range(4000)]
    _, sizes = _terms(pa.array(texts))
    shard = Shard(dict(zip(treap._names(treap.SHARDS), _build(pa.array(range(4000)), pa.array(texts), 4000, int(sizes.sum())))))
    rows = shard.rows(pa.array(["zulu", "yankee"]))
    best = Best(5, 0)
    assert shard.search(rows, rows * 0 + 6000, best) < 800
    assert best.ids.tolist() == [0, 400, 800, 1200, 1600]
