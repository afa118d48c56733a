"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.registry import query, quoted, table, unused
from tablecraft.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# Documents of one source and bucket are ordered in one window, so a bucket is small whatever the source.
BUCKET_ROWS = 4096


def words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(column: str = "doc_id") -> Column:
    """A reproducible random number below 2^60, the same in other SQL engines: the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """The rows of ``sizes(source, source_size)`` with ``target`` and ``budget``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``percent`` of all sizes. A share stops
    at ``most`` times its source's size; what is above is reshared by weight until none is above. That is one pass over
    the sources by rising ``cap / weight``: a source is capped exactly when its part of what the sources before it left
    is at least its cap. The budget is the target rounded to whole words. One row for each source; an empty table has none.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    placed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source").cast("binary"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = (
        F.sum("source_size").over(everything) * (percent / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = placed.withColumn("left", left).withColumn("weight_left", weight_left)
    share = share.withColumn("capped", F.col("weight") * F.col("left") / F.col("weight_left") >= F.col("cap"))
    # The first source that is not capped says what a unit of weight is worth to all that follow.
    first_free = F.min_by(F.struct("left", "weight_left"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))
    open_ = share.where(~F.col("capped")).agg(first_free.alias("free"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free.left") / F.col("free.weight_left"))
    return share.join(open_).select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("budget"))


def _ties() -> list[Column]:
    """Two hashes that tell rows apart by all that the mix reads."""
    return [F.xxhash64("doc_id", "source", "text").alias("tie"), F.xxhash64("text", "source", "doc_id").alias("tie2")]


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """Per row of ``documents(doc_id, text, source)``: doc_id, source, size, source_size, target, taken.

    What is taken, and how, is told at ``_mix``.
    """
    return _mix(documents, weights, percent).drop("tie", "tie2")


def _mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """The rows of ``mix`` with two hashes of the row.

    Documents of a source stand in the order of a hash of their id (ties by id, size and a hash of the text, so that
    reruns agree; fully equal rows are alike). An epoch takes all of them; the mix takes whole epochs as long as the
    budget lasts and then the documents whose words come first; the one over the border gives its first words only.
    So every source gives its budget exactly, a document at most two epochs. Size counts words; null texts have 0 and
    are never taken. Null sources are one source. A row without id keeps its place by its other columns.

    The order is cut into ranges of the hash, as many as the source's rows ask for; sums of the ranges give each range
    its offset, so no window is larger than a range and a source with a third of all rows is as many tasks as it needs.
    """
    rows = documents.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), words().alias("size"),
        F.coalesce(hash_key(), F.lit(0)).alias("key"), *_ties())
    rows = materialize(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(sources.select("source", "source_size"), weights, percent)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = plan.alias("p").join(sources.alias("s"), same("p", "s")).select(
        "p.source", "p.source_size", "target", "budget", F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))
    plan = materialize(plan)
    placed = rows.alias("r").join(plan.alias("p"), same("r", "p")).select(
        "doc_id", "r.source", "size", "key", "tie", "tie2", "source_size", "target", "budget",
        F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("buckets")).alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    summed = summed.alias("d").join(offsets.alias("o"), same("d", "o") & (F.col("d.bucket") == F.col("o.bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("offset") - F.col("inner")
    taken = epochs * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return summed.select("doc_id", "d.source", "size", "source_size", "target", taken.cast("long").alias("taken"), "tie", "tie2")


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """The mix itself: the columns of ``documents``, a row for each time a text is taken, cut where a budget ends.

    Rows of which nothing is taken go. The text of the one document of each source that lies over the border ends
    behind its last word taken. Repeated rows are taken as often as all of them together.
    """
    names = documents.columns
    hash1, hash2, row, all_, size, left, one, two = unused(documents, "__hash1", "__hash2", "__row", "__all", "__size", "__left", "tie", "tie2")
    plan = _mix(documents, weights, percent).where("taken > 0").groupBy("tie", "tie2").agg(
        F.sum("taken").alias(all_), F.first("size").alias(size)).withColumnsRenamed({"tie": one, "tie2": two})
    hashed = documents.withColumns({hash1: _ties()[0], hash2: _ties()[1]})
    hashed = hashed.withColumn(row, F.row_number().over(Window.partitionBy(hash1, hash2).orderBy(hash1))).where(F.col(row) == 1)
    taken = hashed.join(plan, (F.col(hash1) == F.col(one)) & (F.col(hash2) == F.col(two)))
    epochs = F.sequence(F.lit(1), F.ceil(F.col(all_) / F.col(size)).cast("int"))
    taken = taken.withColumn(left, F.explode(F.transform(epochs, lambda i: F.least(F.col(size), F.col(all_) - (i - 1) * F.col(size)))))
    # The words of a text up to one number are those before the next word.
    words_ = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    begin = F.array_join(F.slice(words_, F.lit(1), F.col(left).cast("int")), "")
    cut = F.when(F.col(left) < F.col(size), begin).otherwise(F.col("text"))
    return taken.withColumn("text", cut).select(*quoted(names))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (
  SELECT *, 2 * source_size AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - CAST(coalesce(sum(2 * source_size) OVER before, 0) AS DOUBLE) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights, 2e0 * source_size / weight AS level
  FROM w WINDOW before AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, weight * rest / weights >= cap AS capped FROM c),
f AS (SELECT rest, weights FROM k WHERE NOT capped ORDER BY level, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT rest FROM f) / (SELECT weights FROM f) END AS target
  FROM k),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(greatest(budget % source_size - ahead, 0), size) ELSE 0 END AS BIGINT) AS taken
FROM p
"""


@query("op5_weighted_mix", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
