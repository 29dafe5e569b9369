"""Registered queries of the operators, each over its whole table, next to their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from . import compression_quality, credential_formats, decontaminate, group_join, license_scan, line_rules, poisson_mix, ppm_score, spelling_variants, substring_dedup, token_alignment, token_counts, warc_zip
from .text import held_out, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ALIGNED = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
# Target shares of sources in the mixture: the first sources are raised, the others level.
MIX_WEIGHTS = {f"src{i}": w for i, w in enumerate([4.0, 3.0, 2.0, 2.0] + [1.0] * 16)}
# The weight of every source that is not named, null included.
OTHER_WEIGHT = 1.0


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def quality_model(spark: SparkSession, sf_dir: str) -> compression_quality.CompressionModel:
    """The classifier learned from labelled documents outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4))
    return compression_quality.fit_compression_model(table(spark, sf_dir, "documents"), labels)


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compression_quality.score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted", "size_difference")


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scanned = license_scan.scan_licenses(documents, license_scan.fit_license_model(documents))
    return scanned.select("doc_id", "n_paragraphs", F.size("findings").alias("n_findings"), F.array_join("families", ",").alias("families"))


@query("op3_line_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.zipf_scores(token_counts.read_ranks(VOCABULARY))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), scores)


@query("op5_mix_sources", poisson_mix.mix_sql(MIX_WEIGHTS, OTHER_WEIGHT))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, other=OTHER_WEIGHT)


@query("op7_warc_zip", warc_zip.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = written(warc_zip.write_packages(table(spark, sf_dir, "pages"), scratch(spark, "warc")), "warc-list")
    return warc_zip.read_packages(spark, packages, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_ppm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm_score.score_documents(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7))
    return scored.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_decontaminate", decontaminate.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_group_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, per_100=85).select("doc_id", "n_shingles", "component_id")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), *token_alignment.read_models(*ALIGNED))[0]


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_credential_formats")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return credential_formats.scan_secrets(documents, credential_formats.fit_format_model(documents))
