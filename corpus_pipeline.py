"""A training corpus in five stages, from `documents` to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatlake.llm import classifier, decontaminate, linedup, neardup, packing
from threatlake.llm.common import Scratch, filter_texts, table
from threatlake.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier gives a score of 0.5 or more, all columns.

    Null and empty texts are scored as empty ones; null ids are scored but not learned from;
    repeated rows and ties get equal scores, so all stay or all go. Texts of any length are
    scored whole, extra columns may have any name, an empty table gives no rows.
    """
    sent = spark.sparkContext.broadcast(classifier.fit(spark, docs, table(spark, sf_dir, "labels")))
    return filter_texts(docs, lambda texts: list(classifier.score(texts, sent.value) >= 0.5), "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs of LONG_WORDS words or more; every row stays.

    Shorter repeats, such as a license line, stay here (op4_line_dedup cuts them as well).
    Null texts stay null, a text that goes whole becomes empty; see dedup_lines for null ids,
    ties, repeated rows, long texts, empty tables and extra columns.
    """
    return linedup.dedup_lines(spark, docs, min_words=linedup.LONG_WORDS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, all columns.

    Null and empty texts are in no group and all stay. Ties, null ids, repeated rows, long
    texts, empty tables and extra columns: see drop_near_duplicates.
    """
    return neardup.drop_near_duplicates(spark, docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; all columns of the others stay.

    Null and empty texts hold none; null ids and repeated rows are judged row by row; texts
    of any length are searched whole; an empty table gives no rows.
    """
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences; one row per piece.

    A null or empty text is one end id. Null ids, repeated rows, long texts, extra columns and
    empty tables: see packing.pack.
    """
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("benchmark decontamination", leaks),
    ("packing", pack),
]

#: Learned, hashed and tokenized stages have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
