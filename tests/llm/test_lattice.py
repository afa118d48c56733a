import itertools

import numpy as np
import pytest

from tablecraft.llm import lattice
from tests.llm.conftest import SF_DIR
from tests.llm.test_components import brute


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.decode_e8(x)
    doubled = np.rint(point * 2).astype(int)
    assert (doubled % 2 == doubled[:, :1] % 2).all() and (point.sum(axis=1) % 2 == 0).all()
    assert len(lattice._SHORTEST) == 240 and np.allclose((lattice._SHORTEST ** 2).sum(axis=1), 2)
    own = ((x - point) ** 2).sum(axis=1)
    around = ((x[:, None, :] - point[:, None, :] - lattice._SHORTEST) ** 2).sum(axis=2)
    assert (own <= around.min(axis=1) + 1e-9).all() and (own <= 1 + 1e-9).all()


def pairs_at(cosine, n, size, seed):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, size))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(n, size))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return u, cosine * u + np.sqrt(1 - cosine ** 2) * w


@pytest.mark.parametrize("size", [16, 64, 384])
def test_recall_at_the_threshold(size):
    """Pairs of cosine 0.931 meet in a cell; unrelated vectors seldom do."""
    u, v = pairs_at(0.931, 2000, size, 8)
    a, b = lattice.cells(u), lattice.cells(v)
    meet = lambda x, y: (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert meet(a, b).mean() > 0.97
    assert meet(a, np.roll(b, 1, axis=0)).mean() < 0.35


def expected(rows, threshold=0.93):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(map(abs, v))
            good.append((i, v / np.linalg.norm(v), label))
    links = {(a, b) for (a, x, p), (b, y, q) in itertools.permutations(good, 2) if a != b and p == q and len(x) == len(y) and x @ y >= threshold}
    low = brute(links)
    counts = {}
    for a, _ in links:
        counts[a] = counts.get(a, 0) + 1
    return sorted(((i, counts.get(i, 0), low.get(i, i), low.get(i, i) == i if i is not None else True) for i, _, _ in rows), key=str)


def found(df):
    return sorted(map(tuple, lattice.near_vectors(df).collect()), key=str)


def test_clusters_by_comparing_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE_ROWS", 25)
    monkeypatch.setattr(lattice, "GROUP_ROWS", 300)
    rng = np.random.default_rng(6)
    rows, centres = [], rng.normal(size=(6, 32))
    for i in range(160):
        rows.append((i * 7, list(map(float, centres[i % 6 if i % 2 else 0] + rng.normal(size=32) * (0.1 if i % 3 else 0.03))), i % 2))
    rows += [(5000 + i, list(map(float, rng.normal(size=32))), i % 2) for i in range(60)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
            (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-300, 0.0], 1),
            (13, [1e300, 1e299], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, id string, cell int")
    want = expected(sorted(set((i, tuple(v) if v is not None else None, l) for i, v, l in rows), key=str))
    want = sorted([*want, *[w for w in want if w[0] == 2]], key=str)
    assert found(df) == want
    assert found(df.where("false")) == []
    assert found(df.withColumn("label", df["label"].cast("string")).where("vec_id < 4"))[1][1] == 1


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in df.collect()]
    assert found(df) == expected(rows)
