import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tablecraft.llm import phrases
from tablecraft.llm.phrases import _lifted, _lockstep, _plain, _quantiles, _Ranges, _Runs, _windows, collocations, phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(documents, least=30, best=2000):
    """Every phrase counted, every cut scored, every longer phrase looked at."""
    f = defaultdict(Counter)
    for lang, text in documents:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, c in candidates.items())
            if not inside:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, front, back) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, front, back, n, -score))
    return sorted(out)


def found(spark, documents, **options):
    df = spark.createDataFrame(documents, "lang string, text string") if isinstance(documents, list) else documents
    return sorted(map(tuple, collocations(df, **options).collect()))


def babble(n, seed, letters="abcde"):
    rng = random.Random(seed)
    ends = [" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "!", " \x0b "]
    return "".join(rng.choice(letters) * rng.choice([1, 1, 1, 2]) + rng.choice(ends) for _ in range(n))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.select("lang", "text").collect()]
    for least in (5, 30):
        assert found(spark, odd_documents, least=least) == by_hand(rows, least)
    assert found(spark, no_documents) == []


@pytest.fixture()
def narrow(monkeypatch):
    """Ranges of a few rows in every stream, so that most phrases have their beginnings in ranges before."""
    monkeypatch.setattr(phrases, "RANGE_ROWS", 20)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 900)
    monkeypatch.setattr(phrases, "STEP_BYTES", 700)


@pytest.mark.parametrize("letters", ["ab", "abcde", "aé日\x00\x01\x08\x1f\x7f"])
def test_narrow_ranges_give_the_same(spark, narrow, letters):
    rows = [(random.Random(i).choice(["en", "EN", None, "und", "a\tb", "x\x0b", ""]), babble(120, i, letters)) for i in range(40)]
    rows += [("en", "hot words here " * 300), ("en", None), (None, "")]
    assert found(spark, rows, least=3) == by_hand(rows, 3)
    assert found(spark, rows, least=3, best=4) == by_hand(rows, 3, 4)


def test_one_text_on_a_third_of_the_rows(spark, narrow):
    rows = [("en", "the same few words, the same few words again" if i % 3 == 0 else babble(9, i)) for i in range(900)]
    assert found(spark, rows) == by_hand(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "\x01", "é", " ", ".", "\t"]), max_size=30).map("".join), max_size=4), st.integers(1, 9))
def test_runs_over_batches_of_any_size(texts, size):
    """One range in order, cut into batches anywhere, gives each phrase's count once."""
    array = pa.array(texts, pa.string())
    data = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    assert len(array) == len(texts)
    keys, n = _windows(data, bounds, "x")
    assert keys.to_pylist() == sorted(set(keys.to_pylist()), key=str.encode)
    runs, total = _Runs(1), Counter()
    for i in range(0, len(keys), size):
        for k, c in zip(*runs.add(keys.slice(i, size), n[i:i + size])):
            total[k.decode()] += c
    for k, c in zip(*runs.close()):
        total[k.decode()] += c
    expected = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            expected["x"] += len(words)
            for far in range(1, 5):
                expected.update("\t".join(["x", *map(_lifted, words[i:i + far])]) for i in range(len(words) - far + 1))
    assert dict(total) == {k: c for k, c in expected.items() if c}


def test_letters_that_sort_before_the_tab():
    for part in ("", "a", "\x00\x0b\t\n\r", "a\x0b+", "日\x08"):
        assert _plain(_lifted(part)) == part
        assert not set(_lifted(part)) & {chr(c) for c in range(0x0E) if c != 0x0B}


def test_lockstep_merges_rows_of_one_key():
    none = object.__new__(_Ranges)
    none.bounds, none.counts = [], {}
    rows = [("x", 100, []), ("x\ta", 20, []), ("x\ta", 25, []), ("x\ta\tb", 31, []), ("x\tc", 7, []), ("x\td", 30, [])]
    told = sorted((key, n, above, most) for key, n, _, above, most in _lockstep(iter(rows), none, 30))
    assert told == [("x", 100, [], 45), ("x\ta", 45, [100], 31), ("x\ta\tb", 31, [100, 45], 0), ("x\td", 30, [100], 0)]


def test_bounds_and_counts(spark, narrow):
    assert _quantiles([], 5) == [] and _quantiles(["a", "a"], 5) == ["a"]
    rows = [("en", babble(200, i)) for i in range(5)]
    counted = Counter()
    for key, n in phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 3).collect():
        counted[key] += n
    for phrase, a in [(r[2], r[3]) for r in by_hand(rows, 3)]:
        assert counted["\t".join(["en", *phrase.split(" ")])] == a
