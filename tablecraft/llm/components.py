"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecraft.session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("lo"))


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id named in ``links(a, b)``; component is the smallest id reachable.

    Null ends and links of an id to itself are passed over. Each round points every larger neighbour of an id at
    its smallest neighbour, then every smaller one, until nothing moves; rounds grow with the logarithm of the
    longest chain. An id with very many links is summed before the shuffle, and its join is split by the engine.
    """
    links = (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    links = materialize(links)
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()
        low = _lowest(large)
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
            .unionByName(low.select("a", F.col("lo").alias("b"))).where("a <> b").distinct()
        )
        links = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    # Every id now points straight at its smallest; those smallest point nowhere.
    return links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
