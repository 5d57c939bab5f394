"""A training-corpus pipeline: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import decontamination, line_dedup, quality_classifier, simhash_dedup, source_mixing
from panelwright.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other, repeated rows each by itself, long texts whole. An empty table
    stays empty; without labelled rows all scores are 0.5 and all documents stay. All columns stay as they are.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line leave the texts; every document stays.

    Null and empty texts stay as they are, as do blank lines; of equal documents the first keeps its lines. Long texts are
    read whole, an empty table stays empty, and all columns but ``text`` stay as they are.
    """
    return line_dedup.dedup_lines(docs, exact_words=1, count=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (null last).

    Null and word-free texts are one group. Rows that repeat an id are told apart by their text. Long texts are read
    whole, an empty table stays empty, all columns stay as they are.
    """
    return simhash_dedup.keep_one_per_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do all documents where the benchmark is empty. Repeated rows are judged
    alike, long texts are read whole, an empty table stays empty, all columns stay as they are.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), any_length=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (doc_id, source, size, source_size, target, taken); those that it leaves out go.

    A null source is a source of its own. Null and empty texts have size 0 and go. Repeated rows are mixed each for itself;
    an empty table gives no rows.
    """
    return source_mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mixing),
]

#: Model scores and link components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
