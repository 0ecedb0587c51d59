"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterql.llm import decontaminate, html_tree, licenses, ppm, quality_mil, quality_rules, secrets, sentencepiece_fst, simhash, substring_dedup
from meterql.llm.common import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to."""
    return sentencepiece_fst.encode(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document."""
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality_mil.scores(docs, quality_mil.train(docs, read(spark, sf_dir, "labels")))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return ppm.scores(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    return substring_dedup.repeats(read(spark, sf_dir, "documents")).drop("factors")


def op6_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_tree.extract(read(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document."""
    return secrets.findings(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged ledger of all documents, failure bits and measurements included."""
    return quality_rules.judge(quality_rules.ledger(read(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects, alone and beside the others."""
    return quality_rules.ablation(quality_rules.ledger(read(spark, sf_dir, "documents")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences stated in every document."""
    return licenses.findings(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_decontaminate": op2_decontaminate,
        "op3_quality_mil": op3_quality_mil,
        "op4_ppm": op4_ppm,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_html_tree": op6_html_tree,
        "op7_secrets": op7_secrets,
        "op8_quality_rules": op8_quality_rules,
        "quality_ablation": quality_ablation,
        "op9_licenses": op9_licenses,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.contamination_sql(),
        "op5_substring_dedup": substring_dedup.repeats_sql(),
        "op8_quality_rules": quality_rules.ledger_sql(),
        "quality_ablation": quality_rules.ablation_sql(),
    }
