"""Corpus preparation: language, near duplicates, repeated passages, mixture, tokens. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.chunks import remove_passages
from tablecraft.llm.hamming import near_duplicates
from tablecraft.llm.language import UNDETERMINED, held_out, identify, learn
from tablecraft.llm.mixing import mixed
from tablecraft.llm.rank_bpe import encode_checked
from tablecraft.llm.registry import quoted, stored, table, unused

# A document goes if no language has half of it.
LEAST_SHARE = 0.5
# Tokens of a hash join and of text edits have no twin in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns under numbers, so that no name meets one that a stage adds, and the name of the text."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language: those without letters, without text, or of no language by half go. A null lang gets the prediction."""
    plain, text = _plain(docs)
    lang = f"c{docs.columns.index('lang')}"
    found = identify(plain, learn(docs.where(~held_out())), text)
    clear = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return clear.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*plain.columns).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the lowest doc_id, and one row of it. Rows without id stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64(*quoted(docs.columns)))
    row, = unused(docs, "__row")
    chosen = docs.where("doc_id IS NOT NULL").withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).drop(row)
    return chosen.join(kept, "doc_id", "left_semi").select(*quoted(docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; documents of which nothing is left go."""
    plain, text = _plain(docs)
    left = remove_passages(plain, text, f"c{docs.columns.index('doc_id')}")
    some = (F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")
    kept = left.where(some).select(*plain.columns).toDF(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix of sources: documents not taken go, documents taken twice are two rows."""
    return mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text. Columns of the names that are added give way."""
    return encode_checked(docs)


STAGES = [("language", language), ("near", near), ("passages", passages), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored, because the next stage reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
