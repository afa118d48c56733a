"""Neighbours told by products of matrices, beside distances of all pairs and Spark's own hashed join."""

import numpy as np
import pyarrow as pa
import pytest

from tablecraft.operators import neighbours


def _rows(n, width=6, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width)).round(1)  # with equal distances
    points[n // 2:n // 2 + n // 4] = points[0]  # a large group of copies
    return points


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (1e160, 0.0)])
def test_block_equals_all_distances(monkeypatch, scale, offset):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE_POINTS", 32)
    monkeypatch.setattr(neighbours, "PAIRS", 200)
    points, keys = _rows(150) * scale + offset, np.arange(150) // 2  # every key twice
    block = neighbours.Block(pa.array(keys), pa.array(points.tolist()))
    row, rank, place, d = block.nearest(points, block.own(pa.array(keys)), 5)
    for i in range(len(points)):
        near, far = neighbours._closest(points, keys, points[i], 5, keys[i])
        mine = row == i
        assert keys[place[mine]].tolist() == keys[near].tolist() and d[mine].tolist() == far.tolist() and rank[mine].tolist() == list(range(1, len(near) + 1))


def test_points_without_distance_hide_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [float("nan"), 0.0]), (4, "d", [float("inf"), 0.0])], "id long, l string, v array<double>")
    for options in ({}, {"block_rows": 2}):
        found = neighbours.nearest(df, df, "id", "v", "l", 3, True, **options).select("id", "neighbour", "rank", "dist").collect()
        assert sorted(map(tuple, found)) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]


def test_default_blocks_hold_numbers_not_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHIPPED_VALUES", 0)
    dealt = []
    meet = neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda train, score, *rest: dealt.append((train.count(), score.count())) or meet(train, score, *rest))
    df = spark.createDataFrame([(i, str(i % 3), p.tolist()) for i, p in enumerate(_rows(9000, 2))], "id long, l string, v array<double>")
    assert neighbours.nearest(df, df.where("id < 1000"), "id", "v", "l", 2, True).count() == 2000
    # One block of training rows for all 9,000 of two numbers each: a row to score is sent once, not once for every 4,000.
    assert dealt[0][1] == 1000


@pytest.mark.parametrize("cell_rows", [neighbours.BLOCK_ROWS, 20])
@pytest.mark.parametrize("bucket", [0.4, 2.0])
def test_approximate_equals_the_hashed_join(spark, cell_rows, bucket):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    points = _rows(160).tolist()
    rows = [(i, p) for i, p in enumerate(points)] + [(3, points[3]), (4, points[9])]  # a copy of a row, and a key with two vectors
    df = spark.createDataFrame(rows, "id long, v array<float>")
    vectors = df.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=3, seed=42).fit(vectors)
    pairs = model.approxSimilarityJoin(vectors, vectors, 1.5, "dist").where("datasetA.id <> datasetB.id")
    wanted = sorted((r[0], r[1], round(r[2], 9)) for r in pairs.select("datasetA.id", "datasetB.id", "dist").collect())
    found = neighbours.approximate_neighbours(df, df, "v", "id", 1.5, bucket, 3, True, cell_rows=cell_rows)
    assert sorted((r["id"], r["neighbour"], round(r["dist"], 9)) for r in found.collect()) == wanted and wanted


def test_approximate_pairs_pass_no_shuffle(spark):
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(_rows(40))], "id long, v array<float>")
    plan = neighbours.approximate_neighbours(df, df, "v", "id", 1.5, exclude_self=True)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and not {"Exchange", "Aggregate"} & set(plan[:plan.index("MapInArrow")].replace("(", " ").split())
