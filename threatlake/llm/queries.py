"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, classifier, ctw, decontaminate, html, linedup, neardup, oracles, packing, pii, rules, secrets, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_lines_cut", long_col="n_long_run_lines", run_col="longest_run_cut")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(spark, table(spark, sf_dir, "documents"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(control).alias("text")) for n, role in enumerate(("user", "assistant")))))
    )
    return rows.union(extra)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(_conversations(spark, sf_dir)), "conv_id")


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations written as JSON in eight layouts, known by their fingerprints."""
    turns = chat.table_turns(_conversations(spark, sf_dir), ("conv_id",))
    records = chat.to_turns(chat.as_records(turns, "conv_id", F.col("conv_id")), "json")
    return chat.digests(chat.format_turns(records), "conv_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark, table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Query]:
    found = (op1_decontaminate, op2_pii, op3_quality_rules, op4_line_dedup, op5_packing, op6_lm_score, op7_chat_format, op8_html_text, op9_quality_classifier, op10_near_duplicates)
    found += (op11_secrets, op12_filter_audit, op13_whitening, chat_layouts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express. The others are held against brute force in tests/llm."""
    return {"op7_chat_format": oracles.OP7, "chat_layouts": oracles.OP7, "op10_near_duplicates": oracles.OP10, "op12_filter_audit": oracles.OP12}
