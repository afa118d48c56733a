"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablecraft.session import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 0.005


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a join side: a plain count first, serialized bytes only of what is few enough."""
    if df.count() > max_rows:
        return False
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return size["b"] <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, sample_rows: int = 1_000_000) -> DataFrame:
    """Keys holding more than ``share`` of the rows: at most ``1 / share`` of them.

    Large tables are judged by a sample. Which keys count as hot only steers how rows are spread,
    never what a join returns.
    """
    only = df.select(*keys)
    total = only.count()
    if total > 2 * sample_rows:
        only, total = only.sample(sample_rows / total, seed=7), sample_rows
    counts = only.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > F.lit(max(1.0, total * share))).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", salts: int | None = None,
                null_safe: bool = True) -> DataFrame:
    """Equi-join on same-named keys; hot keys of ``left`` are spread over ``salts`` tasks.

    ``how`` is inner, left, left_semi or left_anti. Rows of ``right`` under a hot key are repeated
    once per salt, every other key is joined unsalted. The hot list is at most 1 / HOT_SHARE rows;
    when it is empty this is a plain join.
    """
    spark = left.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in left.columns if c not in keys]
    found = materialize(hot_keys(left, keys))
    if found.isEmpty():
        return equi_join(left, right, keys, how, null_safe)
    hot = F.broadcast(found.withColumn("_hot", F.lit(True)))

    def mark(df):
        marked = df.alias("d").join(
            hot.alias("h"), [F.col(f"d.{_q(k)}").eqNullSafe(F.col(f"h.{_q(k)}")) for k in keys], "left"
        )
        return marked.select("d.*", F.coalesce("h._hot", F.lit(False)).alias("_hot"))

    # Contents plus task number: repeatable when a task is retried, and identical copies still spread.
    spread = F.pmod(F.xxhash64(*[F.col(_q(c)) for c in rest], F.spark_partition_id()), F.lit(salts)).cast("int")
    a = mark(left).withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = mark(right).withColumn("_salt", F.explode(copies)).drop("_hot")
    return equi_join(a, b, keys, how, null_safe, extra="_salt").drop("_salt")


@dataclass(frozen=True)
class Heavy:
    """What one pass over the keys of two sides tells: their rows, and estimated rows (left, right) under the hash of a hot key."""

    left_rows: int = 0
    right_rows: int = 0
    keys: dict[int, tuple[int, int]] = field(default_factory=dict)

    def turned(self) -> "Heavy":
        return Heavy(self.right_rows, self.left_rows, {h: (r, l) for h, (l, r) in self.keys.items()})

    def grid(self, salts: int, share: float = HOT_SHARE) -> dict[int, tuple[int, int]]:
        """Pieces of each side by hot key: none holds more than ``share`` of its side while the cells of a key are at most 4 x salts."""
        out = {}
        for key, (l, r) in self.keys.items():
            a = min(salts, max(1, math.ceil(l / max(1.0, share * self.left_rows))))
            b = min(salts, max(1, math.ceil(r / max(1.0, share * self.right_rows))))
            shrink = min(1.0, math.sqrt(4 * salts / (a * b)))
            out[key] = (max(1, math.floor(a * shrink)), max(1, math.floor(b * shrink)))
        return {key: cells for key, cells in out.items() if cells != (1, 1)}


def _hash(keys: Sequence[str]):
    return F.xxhash64(*[F.col(_q(k)) for k in keys])


def heavy_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> Heavy:
    """Rows of both sides and the keys over ``share`` of either, by one mergeable sketch of frequent keys a side.

    One pass reads the key columns only; two rows come back. Which keys count as hot only steers how rows are spread.
    """
    most = math.ceil(1 / share)
    sides = left.select(F.lit(0).alias("side"), _hash(keys).alias("h")).unionAll(right.select(F.lit(1).alias("side"), _hash(keys).alias("h")))
    told = {x["side"]: x for x in sides.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {min(1_000_000, 64 * most)})").alias("top")).collect()}
    rows = [told[i]["n"] if i in told else 0 for i in (0, 1)]
    hot: dict[int, list[int]] = {}
    for i in (0, 1):
        for item in told[i]["top"] if i in told else []:
            if item["count"] > max(1.0, share * rows[i]):
                hot.setdefault(item["item"], [0, 0])[i] = item["count"]
    return Heavy(*rows, {key: tuple(n) for key, n in hot.items()})


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", heavy: Heavy | None = None,
              null_safe: bool = True) -> DataFrame:
    """Equi-join on same-named keys with keys that may be hot on either side or both; ``how`` is inner, left or left_anti.

    The rows of a hot key are cut into pieces on both sides and every left piece meets every right piece in a task of its own, so
    each pair meets once. Left rows of a hot key that the right side lacks are told by the few hot keys that it has.
    """
    if how == "left_anti":
        return salted_join(left, right.select(*keys).distinct(), keys, how, null_safe=null_safe)
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = (heavy or heavy_keys(left, right, keys)).grid(salts)
    if not grid:
        return equi_join(left, right, keys, how, null_safe)
    pieces = F.create_map(*[x for key, (a, b) in grid.items() for x in (
        F.lit(key).cast("bigint"), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    is_hot = _hash(keys).isin(*grid)

    def cut(df, own, other):
        rest = [c for c in df.columns if c not in keys]
        # Contents plus task number: repeatable when a task is retried, and identical copies still spread.
        mine = F.pmod(F.xxhash64(*[F.col(_q(c)) for c in rest], F.spark_partition_id()), F.col("_cells")[own]).cast("int")
        dealt = df.withColumn("_cells", pieces[_hash(keys)]).withColumn("_own", mine)
        met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells")[other] - 1)))
        place = {"a": ("_own", "_other"), "b": ("_other", "_own")}[own]
        return met.withColumn("_salt", F.struct(*[F.col(c).alias(n) for c, n in zip(place, "ab")])).drop("_cells", "_own", "_other")

    hot_left, hot_right = left.where(is_hot), right.where(is_hot)
    parts = [equi_join(left.where(~is_hot), right.where(~is_hot), keys, how, null_safe),
             equi_join(cut(hot_left, "a", "b"), cut(hot_right, "b", "a"), keys, "inner", null_safe, extra="_salt").drop("_salt")]
    if how == "left":
        there = F.broadcast(hot_right.select(*keys).distinct())  # as few as the hot keys
        parts.append(equi_join(hot_left, there, keys, "left_anti", null_safe))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def equi_join(a: DataFrame, b: DataFrame, keys, how: str, null_safe: bool = True, extra: str | None = None) -> DataFrame:
    """Join on same-named keys, keeping those of ``a``; null keys match each other unless told otherwise."""
    renamed = b.select(
        *[F.col(_q(k)).alias(f"_rhs_{k}") for k in keys],
        *([F.col(extra).alias("_rhs_salt")] if extra else []),
        *[F.col(_q(c)) for c in b.columns if c not in keys and c != extra],
    )
    match = [
        a[_q(k)].eqNullSafe(renamed[_q(f"_rhs_{k}")]) if null_safe else a[_q(k)] == renamed[_q(f"_rhs_{k}")] for k in keys
    ]
    if extra:
        match.append(a[extra] == renamed["_rhs_salt"])
    return a.join(renamed, match, how).drop(*[f"_rhs_{k}" for k in keys], "_rhs_salt")


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS, is_stored: bool = False) -> DataFrame:
    """Join a lookup with one row per key: broadcast when measured small, salted otherwise.

    The lookup is stored first, unless the caller says that it is cheap to read again.
    """
    stored = lookup if is_stored else materialize(lookup)
    if fits_broadcast(stored, max_rows):
        return equi_join(df, F.broadcast(stored), keys, how, null_safe=True)
    return salted_join(df, stored, keys, how)


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the figures of one-row frames to every row, as literals; of an empty frame, nulls."""
    figures = {}
    for f in one_row:
        row = f.first() or [None] * len(f.columns)
        figures.update({c: F.lit(v).cast(field.dataType) for c, v, field in zip(f.columns, row, f.schema)})
    return df.withColumns(figures)


def attach_figures(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` for grouped figures, ``beside`` when there is no key and so a single row of them."""
    return attach(df, lookup, keys, how) if keys else beside(df, lookup)
