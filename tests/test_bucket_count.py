"""Order ranges of a large table: as many as its rows need, each in a task of its own."""

from tablecraft.operators import ordering


def test_ranges_and_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_ROWS", 100)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 250, raising=False)
    df = spark.range(10_000).selectExpr("id", "if(id % 3 = 0, 'many', concat('k', id % 5)) AS k")
    work, whole = ordering.with_buckets(df, ["k"], ["id"])
    assert not whole and work.select("_bucket").distinct().count() == 40  # 8 shuffle partitions in tests
    assert ordering.dealt(work, 40).rdd.getNumPartitions() == 40
    found = ordering.row_index(df, ["id"], ["k"], "place").collect()
    seen = {}
    for r in sorted(found, key=lambda r: r["id"]):
        assert r["place"] == seen.get(r["k"], 0)
        seen[r["k"]] = seen.get(r["k"], 0) + 1
    assert len(found) == 10_000
