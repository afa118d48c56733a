"""Document statistics and domain classification as corpus jobs of built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.cells import text
from tablecraft.operators.taxonomies import DOMAIN_CORPORA, DOMAIN_KEYWORDS, FALLBACK_KEYWORDS, STOP_WORDS

# Patterns of document structure. --------------------------------------------------
RX_HEADING = r"(?i)^(#|\d+\.|\b(Chapter|Section|Abstract|Introduction|Methods|Results|Discussion|Conclusion)\b)"
RX_FIGURE = r"([$€₹]?\d+(?:,\d+)*(?:\.\d+)?%?)"
RX_DEFINITION = r"([A-Z][a-zA-Z\s]{2,25})\s+(?:is defined as|refers to|means|is an?|are)\s+([^.\n]+)"
RX_TOKEN = r"[\p{L}\p{N}_]{2,}"
# -----------------------------------------------------------------------------------------------


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _pieces(c, separator: str) -> Column:
    return F.filter(F.transform(F.split(text(c), separator, -1), _strip), lambda p: p != "")


def paragraphs(c) -> Column:
    return _pieces(c, "\n\n")


def lines(c) -> Column:
    return _pieces(c, "\n")


def word_count(c) -> Column:
    return F.size(F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != ""))


def _first(found: Column, limit: int | None) -> Column:
    return found if limit is None else F.slice(found, 1, limit)


def headings(c, limit: int | None = None) -> Column:
    """Short lines that open a section, or are all capitals; all of them unless limited."""
    def is_heading(line):
        capitals = (F.upper(line) == line) & (F.lower(line) != line)
        return (F.length(line) < 80) & (line.rlike(RX_HEADING) | capitals)

    return _first(F.filter(lines(c), is_heading), limit)


def figures(c, limit: int | None = None) -> Column:
    """Distinct numbers in order of appearance, with currency sign, separators and percent."""
    return _first(F.array_distinct(F.regexp_extract_all(text(c), F.lit(RX_FIGURE), F.lit(1))), limit)


def definitions(c, limit: int | None = None) -> Column:
    """``term, definition`` of sentences of the form 'Term is defined as ...'."""
    terms = F.transform(F.regexp_extract_all(text(c), F.lit(RX_DEFINITION), F.lit(1)), _strip)
    bodies = F.transform(F.regexp_extract_all(text(c), F.lit(RX_DEFINITION), F.lit(2)), _strip)
    return _first(F.arrays_zip(terms.alias("term"), bodies.alias("definition")), limit)


def summary(c, count: int = 4, width: int | None = 800) -> Column:
    joined = F.array_join(F.slice(paragraphs(c), 1, count), " ")
    return joined if width is None else F.substring(joined, 1, width)


def takeaways(c, count: int = 5, width: int = 160) -> Column:
    return F.transform(F.slice(paragraphs(c), 1, count), lambda p: F.concat(F.substring(p, 1, width), F.lit("...")))


def title(c) -> Column:
    return F.try_element_at(lines(c), F.lit(1))


def document_profile(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Everything the document report shows, one row per document, without a shuffle."""
    return df.select(
        *keys,
        word_count(column).alias("words"),
        F.length(column).alias("characters"),
        F.size(paragraphs(column)).alias("paragraphs"),
        title(column).alias("title"),
        headings(column).alias("headings"),
        figures(column).alias("figures"),
        definitions(column).alias("definitions"),
        summary(column).alias("summary"),
        takeaways(column).alias("takeaways"),
    )


# Domain by TF-IDF cosine -----------------------------------------------------------------------

def tokens(c) -> Column:
    """Words of two or more letters, digits or underscores of any script, without stop words."""
    words = F.regexp_extract_all(F.lower(text(c)), F.lit(f"({RX_TOKEN})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def term_rows(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """``keys, term``: one row per word and per neighbouring word pair."""
    words = df.select(*keys, tokens(column).alias("_w"))
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return words.select(*keys, F.explode(F.concat("_w", pairs)).alias("term"))


def corpus_weights(spark, corpora: Mapping[str, str] = DOMAIN_CORPORA) -> DataFrame:
    """``domain, term, idf, weight``: L2-normalised (1 + ln tf) * idf of the fixed domain texts."""
    docs = spark.createDataFrame(list(corpora.items()), "domain string, corpus string")
    counts = term_rows(docs, "corpus", "domain").groupBy("domain", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    df_counts = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1 + F.lit(len(corpora))) / (1 + F.col("df"))) + 1
    raw = counts.join(df_counts, "term").withColumn("idf", idf).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = raw.groupBy("domain").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "domain").select("domain", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def domain_scores(df: DataFrame, column: str, key: str) -> DataFrame:
    """``key, domain, similarity``: cosine of each document with each domain that shares a term.

    The weight table has one row per term of the fixed domain texts (under 1,500), so it is broadcast
    and documents are cut down to known terms before anything is shuffled.
    """
    weights = corpus_weights(df.sparkSession)
    vocabulary = weights.groupBy("term").agg(
        F.first("idf").alias("idf"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "weight")))).alias("domains"))
    found = term_rows(df, column, key).join(F.broadcast(vocabulary), "term")
    tf = found.groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"), F.first("domains").alias("domains"))
    w = (1 + F.log("tf")) * F.col("idf")
    per_doc = tf.select(key, w.alias("w"), "domains").groupBy(key).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.sum(F.col("w") * F.coalesce(F.try_element_at("domains", F.lit(d)), F.lit(0.0))).alias(d) for d in DOMAIN_CORPORA],
    )
    long = per_doc.unpivot([key, "norm"], list(DOMAIN_CORPORA), "domain", "dot")
    return long.filter("dot > 0").select(key, "domain", (F.col("dot") / F.col("norm")).alias("similarity"))


def classify_domain(df: DataFrame, column: str, key: str) -> DataFrame:
    """``key, domain, similarity, confidence`` for every document; weak matches are generic."""
    best = domain_scores(df, column, key).groupBy(key).agg(
        F.max_by("domain", F.struct(F.round("similarity", 12), "domain")).alias("domain"), F.max("similarity").alias("similarity"))
    joined = df.select(key).join(best, key, "left")
    s = F.coalesce("similarity", F.lit(0.0))
    known = s > 0.03
    confidence = F.least(F.lit(99), F.greatest(F.lit(68), F.floor(s * 180).cast("int") + 40))
    return joined.select(
        key, F.when(known, F.col("domain")).otherwise("generic").alias("domain"), s.alias("similarity"),
        F.when(known, confidence).otherwise(60).alias("confidence"))


def matched_terms(df: DataFrame, column: str, key: str, k: int = 6) -> DataFrame:
    """``key, rank, term, weight``: the strongest known terms of each document."""
    idf = corpus_weights(df.sparkSession).groupBy("term").agg(F.first("idf").alias("idf"))
    tf = (
        term_rows(df, column, key).join(F.broadcast(idf), "term")
        .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    )
    weighted = tf.withColumn("weight", F.round((1 + F.log("tf")) * F.col("idf"), 9))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        key, "rank", "term", "weight")


# Domain by keywords ------------------------------------------------------------------------------

def keyword_table(spark, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(d, w.replace("_", " ")) for d, words in keywords.items() for w in words]
    return spark.createDataFrame(rows, "domain string, keyword string")


def keyword_domains(schemas: DataFrame, samples: Column | None = None) -> DataFrame:
    """Score table schemas ``(dataset, columns ARRAY<STRING>)`` by weighted keywords.

    A keyword equal to a column name counts 4, contained either way 2, in the dataset name 3, and
    anywhere in names or sample text 0.5. Below 2 the table is general.
    """
    def plain(c):
        return F.regexp_replace(F.lower(c), "[-_]", " ")

    keywords = {d: [w.replace("_", " ") for w in words] for d, words in DOMAIN_KEYWORDS.items()}
    work = schemas.select(
        "dataset", plain(F.col("dataset")).alias("name"), F.transform("columns", plain).alias("cols"),
        (plain(samples) if samples is not None else F.lit("")).alias("sample"))
    work = work.withColumn("all", F.concat_ws(" ", "name", F.array_join("cols", " "), "sample"))

    def score(words):
        def per_word(w):
            hits = F.aggregate(
                "cols", F.lit(0.0),
                lambda acc, c: acc + F.when(c == w, 4.0).when(c.contains(w) | w.contains(c), 2.0).otherwise(0.0))
            return hits + F.when(F.col("name").contains(w), 3.0).otherwise(0.0) + F.when(F.col("all").contains(w), 0.5).otherwise(0.0)

        listed = F.array(*[F.lit(w) for w in words])
        return F.aggregate(F.transform(listed, per_word), F.lit(0.0), lambda a, b: a + b)

    scored = work.select("dataset", *[score(words).alias(d) for d, words in keywords.items()])
    long = scored.unpivot(["dataset"], list(keywords), "domain", "score")
    # The earliest listed domain wins ties.
    place = F.array_position(F.array(*[F.lit(d) for d in keywords]), F.col("domain"))
    best = long.groupBy("dataset").agg(
        F.max_by("domain", F.struct("score", -place)).alias("domain"), F.max("score").alias("score"))
    weak = F.col("score") < 2
    return best.select(
        "dataset", F.when(weak, "general").otherwise(F.col("domain")).alias("domain"), "score",
        F.when(weak, 60).otherwise(F.least(F.lit(98), F.round(50 + F.col("score") * 5).cast("int"))).alias("confidence"))


def substring_domain(df: DataFrame, column: str, key: str) -> DataFrame:
    """Domain with the most keywords contained in the text; none at all is generic."""
    cell = F.lower(text(column))
    counts = df.select(key, *[
        sum((cell.contains(w).cast("int") for w in words), F.lit(0)).alias(d) for d, words in FALLBACK_KEYWORDS.items()
    ])
    best = F.greatest(*FALLBACK_KEYWORDS)
    choice = F.coalesce(*[F.when(F.col(d) == best, d) for d in FALLBACK_KEYWORDS])
    return counts.select(key, F.when(best > 0, choice).otherwise("generic").alias("domain"), best.alias("hits"))
