"""One-permutation MinHash fingerprints in built-in expressions: bins, optimal densification, packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.registry import query, table

WORDS = r"[\x20\x09-\x0D]+"
SHINGLE = 5
# 256 bins of 8 low-order bits each: 512 hex digits. Bin numbers are the top 8 of 63 hash bits.
BIN_BITS, LOW_BITS = 8, 8
BINS = 1 << BIN_BITS
_SHIFT = 63 - BIN_BITS
_LOW = (1 << _SHIFT) - 1
TRIES = 8
# Rows of a range of ids; at most 2^14 ranges, so that a range's bounds and first rows stay a small table.
RANGE_ROWS, MOST_LEVELS = 2048, 14


def _word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, A-Z lower-cased."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(plain, WORDS), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column) -> Column:
    """Non-negative even hashes of all runs of five words; of all words where there are fewer."""
    runs = F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
                    lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, SHINGLE)])),
    ).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(runs, lambda h: F.shiftleft(F.shiftrightunsigned(h, 2), 1))


def _in_order(shingles: Column) -> Column:
    """Hashes and a mark for each bin in order: the marks are the last values of their bins and odd, hashes are even."""
    marks = F.array(*[F.lit((b << _SHIFT) + _LOW) for b in range(BINS)])
    return F.sort_array(F.concat(shingles, marks))


def _bins(ordered: Column) -> Column:
    """The first value of each bin: its least hash, or its mark where it is empty."""
    return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT)))


def _is_hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(1)) == 0


def _densified(bins: Column, full: Column) -> Column:
    """The least hash of each bin without its bin number; an empty bin takes that of the first full bin on its own way.

    The way of bin j goes through all bins from a start by an odd stride, both hashed from j, so it meets every bin
    once. Its first steps are tried one after the other; where all meet empty bins, the full bin that comes first on
    the way is found from the list of full bins, of which there are few then.
    """
    begins = [(j * 2654435761 >> 7) % BINS for j in range(BINS)]
    strides = [(j * 40503 >> 5) % BINS | 1 for j in range(BINS)]
    start, stride = F.array(*map(F.lit, begins)), F.array(*map(F.lit, strides))
    inverse = F.array(*[F.lit(pow(s, -1, BINS)) for s in strides])
    low = F.lit(_LOW)

    def tried(j, step):
        x = F.get(bins, F.pmod(F.get(start, j) + F.get(stride, j) * F.lit(step), F.lit(BINS)))
        return F.when(_is_hash(x), x.bitwiseAND(low))

    def searched(j):
        step = lambda v: F.pmod((F.shiftright(v, _SHIFT) - F.get(start, j)) * F.get(inverse, j), F.lit(BINS))
        return F.array_min(F.transform(full, lambda v: F.shiftleft(step(v), _SHIFT) + v.bitwiseAND(low))).bitwiseAND(low)

    return F.transform(bins, lambda x, j: F.coalesce(
        F.when(_is_hash(x), x.bitwiseAND(low)), *[tried(j, t) for t in range(TRIES)], searched(j), low))


def _symbols(values: Column) -> Column:
    half = 1 << (LOW_BITS - 1)
    return F.transform(values, lambda v: (F.xxhash64(v).bitwiseAND(F.lit(2 * half - 1)) - half).cast("tinyint"))


def with_symbols(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the column ``into``: 256 symbols of the low-order bits of the text's bins, or an empty list.

    A null text, or one without words, has the empty list. Each array is a projection of its own, which the optimizer
    keeps apart because the next one reads it more than once, so nothing is computed anew for every element.
    """
    step = lambda i: f"__{into}_{i}"
    df = df.withColumn(step(0), _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(step(1), _in_order(_shingles(F.col(step(0)))))
    df = df.withColumn(step(2), _bins(F.col(step(1))))
    df = df.withColumn(step(3), F.filter(step(2), _is_hash))
    df = df.withColumn(into, F.when(F.size(step(3)) > 0, _symbols(_densified(F.col(step(2)), F.col(step(3))))).otherwise(F.array().cast("array<tinyint>")))
    return df.drop(*map(step, range(4)))


def packed(symbols: Column) -> Column:
    """The symbols as lower-case hex digits, two for each; empty for a text without words."""
    return F.lower(F.array_join(F.transform(symbols, lambda s: F.lpad(F.hex(s.cast("int") + (1 << (LOW_BITS - 1))), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two symbol lists, 0 to 1: the share of equal symbols, corrected for those equal by chance.

    Two empty lists are alike, an empty and a full one are not.
    """
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _ranged(df: DataFrame, bounds: list[int], levels: int) -> DataFrame:
    """``df`` with ``__range``: how many of the bounds are at most its doc_id, by binary search over one array literal.

    Rows without id follow all others, in 64 ranges of the hash ``__tie``.
    """
    ladder = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    df = df.withColumn("__range", F.lit(0))
    for level in range(levels - 1, -1, -1):
        step = 1 << level
        df = df.withColumn("__range", F.col("__range") + F.when(F.get(ladder, F.col("__range") + (step - 1)) <= F.col("doc_id"), step).otherwise(0))
    nameless = (F.shiftright("__tie", 58) + 32 + (1 << levels)).cast("int")
    return df.withColumn("__range", F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("__range")))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows by doc_id; the first row follows the last.

    Rows of one id follow each other by a hash of their text; rows without id come last in that order. Ids are cut
    into ranges at quantiles; the first row of each range is also sent to the range before it, so one shuffle of the
    rows is enough and no window is larger than a range. What is broadcast is one id for each range, at most 2^14.
    """
    spark = df.sparkSession
    df = df.withColumn("__tie", F.xxhash64("text"))
    rows = df.count()
    wanted = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    levels = min(MOST_LEVELS, max(1, wanted.bit_length()))
    bounds = df.approxQuantile("doc_id", [i / (1 << levels) for i in range(1, 1 << levels)], 0.25 / (1 << levels)) or [0.0] * ((1 << levels) - 1)
    df = _ranged(df, bounds, levels)
    firsts = df.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__tie")).alias("first"))
    along = Window.orderBy("__range")
    firsts = firsts.withColumn("__before", F.coalesce(F.lag("__range").over(along), F.max("__range").over(Window.partitionBy())))
    guests = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.__tie").alias("__first_tie"), "__before")
    met = df.join(F.broadcast(guests), df["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__first_tie")), "left")
    places = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest")), F.struct(F.col("__before").alias("r"), F.lit(True).alias("guest"))))
    sent = met.withColumn("__place", F.explode(places)).withColumns({"__range": F.col("__place.r"), "__guest": F.col("__place.guest")})
    order = Window.partitionBy("__range").orderBy("__guest", F.col("doc_id").isNull(), "doc_id", "__tie")
    sent = sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("__guest"))
    return sent.drop("__tie", "__range", "__id", "__first_tie", "__before", "__place", "__guest")


def fingerprint(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: the fingerprint of its text and of an edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the text that
    follows by doc_id. Null texts count as empty; an empty table gives no rows; a lone row follows itself. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Only built-in expressions.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(with_symbols(texts, "text", "own"), ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    own = with_symbols(own.withColumn("edited", edited), "edited", "new")
    return own.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"), packed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


@query("op3_one_permutation_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
