"""Corpus cleaning: five stages over documents, each the work of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourloom.llm import compression_quality, decontaminate, group_join, poisson_mix, substring_dedup
from hourloom.llm.queries import MIX_WEIGHTS, OTHER_WEIGHT, quality_model
from hourloom.llm.text import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts.

    Null and empty texts are scored as empty ones; repeated rows are judged alike; extra columns of any
    name stay; an empty table stays empty."""
    return compression_quality.accepted(docs, quality_model(spark, sf_dir))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word n-grams, 0.8).

    The row of smallest id stays, null ids last; repeated rows count as copies. Documents without words
    link with nothing and stay; an empty table stays empty; extra columns of any name stay."""
    return group_join.one_of_group(docs, n=5, per_100=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that stand in a document of smaller id; those
    left without any word go.

    Rows with a null id or a null text keep what they have; repeated rows lose alike; extra columns of
    any name stay; an empty table stays empty."""
    return substring_dedup.without_repeats(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate.

    Null and empty texts are clean; repeated rows are judged alike; extra columns of any name stay; an
    empty table, or an empty benchmark, removes nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of documents in target shares of their sources, in shuffled order.

    Rows with null ids, null texts or null sources draw as others do, repeated rows each for itself;
    extra columns stay, of any name but copy_no and mix_key; an empty table stays empty."""
    return poisson_mix.mix_sources(docs, MIX_WEIGHTS, other=OTHER_WEIGHT)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_duplicates", keep_one_of_group),
    ("substring_dedup", drop_repeats),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
]
# The classifier's compressed sizes have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
