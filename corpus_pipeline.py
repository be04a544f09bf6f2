"""A corpus pipeline of five stages over ``documents``: toxicity, near duplicates, benchmark decontamination, personal data, mixing.

Each stage takes the documents that its predecessor kept and returns a frame of the same columns; the last one adds what the mix takes of each document and drops those of which it takes nothing.

* toxicity: documents that score 0.5 or more go.
* near_duplicates: of each class the document with the smallest doc_id stays.
* decontamination: documents with windows of two or more benchmark items go; from those with one, the words that lie in its windows are cut.
* personal_data: personal data and the terms that disclose them are replaced by their kind.
* mixture: documents are chosen, whole and up to three times, so that each source's words come near its target.

Nulls in any column, empty texts and tables, repeated rows and further columns are handled as the operators' docstrings say. Where a stage changes a text, n_chars follows it if the table has that column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import decontaminate, mixture, near_dup, pii, toxicity
from plumbago.llm.cluster import checkpoint, read


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, read(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitise(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixing),
]

#: A recurrent network and weighted minimum hashing are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result kept in the shared checkpoint folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
