"""Registered queries of the training-data operators and their SQL, where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import decontaminate, divergence, html, infill, langmodel, licenses, lines, mixing, neardup, quality, secrets, tokens, toxicity
from engramlake.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path(tokens.TOKENIZER)), public_tokenizers.PATTERN)


@query("op8_line_frequency_rules", lines.quality_rules_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.quality_rules(table(spark, sf_dir, "documents"))


@query("op10_source_mixing", mixing.mix_sql("documents"))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_rate", "mix_copies", "mix_copy", "mix_key")


@query("op5_maxent_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score_documents(table(spark, sf_dir, "documents"))


@query("op6_quality_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_license_digests", licenses.scan_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_template_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query("op3_secret_findings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).filter("is_secret")


@query("op11_toxicity_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_infill_forms", infill.digests_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", divergence.audit_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
