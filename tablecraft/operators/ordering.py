"""Whole-table order without a single-task window.

Rows are cut into consecutive key ranges (buckets) whose bounds are literals, windows run inside a
bucket, and what must cross a bucket border travels through a summary of one row per bucket.
A partition key holding a third of the rows is simply spread over several buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SAMPLE_PER_BUCKET = 40
SMALL_ROWS = 100_000
# Rows of a bucket of a table that would have more with a bucket for each shuffle partition.
BUCKET_ROWS = 250_000


def _sort_form(df: DataFrame, name: str) -> Column:
    """A literal-friendly value with the same order as the column."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return c


def _with_bucket(df: DataFrame, key: Column, bounds: list[Column]) -> DataFrame:
    """Add ``_bucket``, the number of bounds at or below the key: a binary search over one array literal, a step a projection."""
    df = df.withColumns({"_key": key, "_bucket": F.lit(0)})
    ladder = F.array(*bounds)
    for level in range(len(bounds).bit_length() - 1, -1, -1):
        step = 1 << level
        probe = F.get(ladder, F.col("_bucket") + (step - 1))
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(probe <= F.col("_key"), step).otherwise(0))
    return df.drop("_key")


def bucket_count(df: DataFrame, names: Sequence[str]) -> int:
    """A bucket for each shuffle partition, more where these would be large; none for few rows."""
    rows = df.select(*names).count()
    if rows <= SMALL_ROWS:
        return 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS))


def with_buckets(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
                 buckets: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_part`` (partition struct) and ``_bucket`` (consecutive range number).

    The flag tells that the rows were counted to be few and share one bucket, so that no border exists.
    """
    names = [*partition_by, *order_by]
    part = F.struct(*[F.col(c) for c in partition_by]) if partition_by else F.struct(F.lit(0).alias("all"))
    if buckets is None:
        buckets = bucket_count(df, names)
    if not buckets:
        return df.withColumn("_part", part).withColumn("_bucket", F.lit(0)), True
    forms = [_sort_form(df, c).alias(f"k{i}") for i, c in enumerate(names)]
    keys = df.select(*forms)
    # The rows with the smallest key hashes are a uniform, repeatable sample of bounded size.
    sampled = (
        keys.orderBy(F.xxhash64(*keys.columns)).limit(buckets * SAMPLE_PER_BUCKET).orderBy(*keys.columns).collect()
    )
    wanted = min(buckets, max(1, len(sampled) // SAMPLE_PER_BUCKET))
    picks = sorted({len(sampled) * i // wanted for i in range(1, wanted)})
    kinds = [f.dataType for f in keys.schema]
    bounds = [
        F.struct(*[F.lit(v).cast(t).alias(f"k{j}") for j, (v, t) in enumerate(zip(sampled[i], kinds))]) for i in picks
    ]
    df = df.withColumn("_part", part)
    return (_with_bucket(df, F.struct(*forms), bounds) if bounds else df.withColumn("_bucket", F.lit(0))), False


def dealt(work: DataFrame, buckets: int) -> DataFrame:
    """Rows with buckets as a window inside them needs them: a task for each bucket where these are more than the shuffle partitions."""
    usual = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(buckets, "_bucket", "_part") if buckets > usual else work



def running_sum(df: DataFrame, order_by: Sequence[str], value: Column, name: str,
                partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in a unique order, per partition."""
    buckets = bucket_count(df, [*partition_by, *order_by]) if buckets is None else buckets
    work, whole = with_buckets(df, partition_by, order_by, buckets)
    work = work.withColumn("_v", value)
    inside = Window.partitionBy("_bucket", "_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    if whole:
        return work.withColumn(name, F.sum("_v").over(inside)).drop("_part", "_bucket", "_v")
    per_part = work.groupBy("_bucket", "_part").agg(F.sum("_v").alias("s"))
    border = per_part.groupBy("_bucket").agg(
        F.min("_part").alias("first"), F.max("_part").alias("last"), F.max_by("s", "_part").alias("tail")
    )
    # What a bucket's first partition has in the buckets before: one running sum over two rows for each bucket.
    steps = border.select("_bucket", F.col("last").alias("_first"), F.lit(1).alias("kind"), "tail").unionByName(
        border.select("_bucket", F.col("first").alias("_first"), F.lit(0).alias("kind"), F.lit(None).alias("tail")))
    ahead = Window.partitionBy("_first").orderBy("_bucket", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.withColumn("_carry", F.sum("tail").over(ahead)).filter("kind = 0").select("_bucket", "_first", "_carry")
    # One row per bucket, so its size is bounded by the bucket count.
    joined = dealt(work, buckets).join(F.broadcast(carry), "_bucket", "left")
    offset = F.when(F.col("_part").eqNullSafe(F.col("_first")), F.col("_carry")).otherwise(F.lit(0))
    total = F.sum("_v").over(inside) + F.coalesce(offset, F.lit(0))
    return joined.withColumn(name, total).drop("_part", "_bucket", "_v", "_first", "_carry")


def row_index(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "t",
              buckets: int | None = None) -> DataFrame:
    """Zero-based position of each row in a unique order, per partition."""
    out = running_sum(df, order_by, F.lit(1).cast("bigint"), name, partition_by, buckets)
    return out.withColumn(name, F.col(name) - 1)


def fill_along(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (),
               backward: bool = False, default=None, buckets: int | None = None) -> DataFrame:
    """Carry the nearest earlier (or later) non-null value into gaps."""
    buckets = bucket_count(df, [*partition_by, *order_by]) if buckets is None else buckets
    work, whole = with_buckets(df, partition_by, order_by, buckets)
    inside = Window.partitionBy("_bucket", "_part").orderBy(*order_by)
    if backward:
        span, take = inside.rowsBetween(0, Window.unboundedFollowing), F.first
    else:
        span, take = inside.rowsBetween(Window.unboundedPreceding, 0), F.last
    last_resort = {c: [] if default is None else [F.lit(default).cast(df.schema[c].dataType)] for c in columns}
    if whole:
        filled = {c: F.coalesce(take(c, ignorenulls=True).over(span), *last_resort[c]).alias(c) for c in columns}
        return work.select(*[filled.get(c, F.col(c)) for c in df.columns])
    at = F.struct(*[F.col(c) for c in order_by])
    pick = F.min if backward else F.max
    per_bucket = work.groupBy("_bucket").agg(
        *[
            pick(F.when(F.col(c).isNotNull(), F.struct(F.col("_part"), at.alias("at"), F.col(c).alias("v")))).alias(
                f"s{i}"
            )
            for i, c in enumerate(columns)
        ],
    )
    # One row per bucket: this ordered window never sees more than the bucket count.
    before = Window.orderBy(F.desc("_bucket") if backward else F.asc("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_bucket.select(
        F.col("_bucket"), *[F.last(f"s{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(columns))],
    )
    joined = dealt(work, buckets).join(F.broadcast(carried), "_bucket", "left")
    filled = {}
    for i, c in enumerate(columns):
        border = F.when(F.col("_part").eqNullSafe(F.col(f"_c{i}._part")), F.col(f"_c{i}.v"))
        filled[c] = F.coalesce(take(c, ignorenulls=True).over(span), border, *last_resort[c]).alias(c)
    return joined.select(*[filled.get(c, F.col(c)) for c in df.columns])
