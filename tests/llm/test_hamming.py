import random

import numpy as np
import pyarrow as pa

from tablecraft.llm import hamming
from tablecraft.llm.bytehash import shingle_hashes, text_steps
from tests.llm.conftest import prose
from tests.llm.test_bytehash import split
from tests.llm.test_components import brute


def shingles(text):
    w = split(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    """Rows with doc_id: (doc_id, n_shingles, component, kept) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and a != b and 100 * len(x & y) >= 85 * len(x | y)]
    low = brute(links)
    return sorted((i, len(s), low.get(i, i), low.get(i, i) == i) for i, s in sets)


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 1 << 16, (200, hamming.SYMBOLS)).astype(np.uint64)
    other = one.copy()
    for row in other:
        row[rng.choice(hamming.SYMBOLS, hamming.DISTANCE, replace=False)] ^= np.uint64(1)
    meets = (hamming.probe_keys(one) == hamming.probe_keys(other)).any(axis=1)
    assert meets.all()
    a, b = hamming.bit_planes(one), hamming.bit_planes(other)
    assert max(bin(int(np.bitwise_or.reduce(x ^ y))).count("1") for x, y in zip(a, b)) == hamming.DISTANCE


def test_signatures_estimate_likeness():
    base = prose(900, 3).split()
    edited = base.copy()
    for i in range(0, 900, 30):
        edited[i] = "zz"
    for _, _, data, bounds in text_steps(pa.array([" ".join(base), " ".join(edited)])):
        signs = hamming.signatures(*shingle_hashes(data, bounds))
    x, y = shingles(" ".join(base)), shingles(" ".join(edited))
    assert abs((signs[0] == signs[1]).mean() - len(x & y) / len(x | y)) < 0.2


def test_edited_groups_by_comparing_all_pairs(spark, monkeypatch):
    """A large group of near copies around the threshold, chains, short texts; tiles forced to be small."""
    monkeypatch.setattr(hamming, "TILE_ROWS", 40)
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = prose(150, 1).split()
        for _ in range(rng.randrange(1, 12)):
            words[rng.randrange(150)] = f"new{rng.randrange(10 ** 6)}"
        rows.append((i * 3 % 451, " ".join(words)))
    chain = prose(120, 2).split()
    for i in range(25):
        chain[(i * 5) % 120] = f"step{i}"
        rows.append((1000 - i, " ".join(chain)))
    rows += [(2000 + i, prose(1 + i % 9, 50 + i % 5)) for i in range(40)]
    rows += [(3000 + i, prose(100, 500 + i)) for i in range(60)]
    found = hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == expected(rows)
    assert len({r[2] for r in expected(rows)}) < len(rows) - 40


def test_odd_rows(odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    found = sorted(map(tuple, hamming.near_duplicates(odd_documents).collect()), key=str)
    nameless = [r for r in found if r[0] is None]
    assert sorted(r for r in found if r[0] is not None) == expected(rows)
    assert sorted(nameless, key=str) == sorted([(None, 196, None, True), (None, 0, None, True)], key=str)
    assert hamming.near_duplicates(no_documents).count() == 0


def test_distance_and_chunks_follow_the_threshold():
    assert hamming.plan(85, 100) == (hamming.DISTANCE, hamming.CHUNKS)
    rng = np.random.default_rng(6)
    for part in (80, 90, 95):
        distance, chunks = hamming.plan(part, 100)
        draws = (rng.random((400_000, hamming.SYMBOLS)) >= part / 100).sum(axis=1)
        assert (draws > distance).sum() <= 20  # 3 expected at most; 200 with the distance of 85/100 at 80/100
        one = rng.integers(0, 1 << 16, (200, hamming.SYMBOLS)).astype(np.uint64)
        other = one.copy()
        for row in other:
            row[rng.choice(hamming.SYMBOLS, distance, replace=False)] ^= np.uint64(1)
        assert (hamming.probe_keys(one, chunks) == hamming.probe_keys(other, chunks)).any(axis=1).all()


def test_a_pair_of_more_differing_symbols_at_80(spark):
    """Of many pairs of likeness 0.80 to 0.82 one with more than 19 differing symbols is linked too."""
    base = prose(504, 8).split()
    rng = random.Random(3)
    for _ in range(20_000):
        words = base.copy()
        for i in rng.sample(range(10, 490, 12), 11):
            words[i] = f"new{rng.randrange(10 ** 6)}"
        pair = [" ".join(base), " ".join(words)]
        x, y = map(shingles, pair)
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        for _, _, data, bounds in text_steps(pa.array(pair)):
            signs = hamming.signatures(*hamming.shingle_sets(data, bounds))
        if (signs[0] != signs[1]).sum() in range(hamming.DISTANCE + 1, hamming.plan(80, 100)[0] + 1):
            break
    found = hamming.near_duplicates(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string"), 80, 100).collect()
    assert [r["component_id"] for r in found] == [0, 0]
