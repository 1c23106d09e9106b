"""Corpus preparation from end to end; every stage is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import line_dedup, minhash_dedup, packing, quality, secret_scan
from changeflow.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame) -> DataFrame:
    """The character count follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def clean_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject."""
    return _sized(quality.clean_lines(docs).filter("__measures.kept").drop("__measures"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; a document may become empty, and stays."""
    return _sized(line_dedup.dedup_lines(docs).drop("__n_lines", "__n_dropped"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays, that of the smallest id."""
    return minhash_dedup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _sized(secret_scan.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; the end of the pipeline."""
    return packing.op4_best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean_by_rules),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Tokenisation is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
