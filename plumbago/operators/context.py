"""Bounded contexts, prompts and sources of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbago.functions.text import snippet, source_label

#: The longest context, its header, and the words of a block in blocks().
LIMIT = 6000
HEADER = "\n" + "=" * 50


def blocks(results: DataFrame) -> DataFrame:
    """results with their context block."""
    label = source_label(F.col("source_type"), F.col("doc_name"), F.col("page"), F.col("section"), F.col("url"))
    return results.withColumn("block", F.concat(F.lit("【参考资料"), F.col("rank").cast("string"), F.lit("】\n来源: "), label, F.lit("\n内容:\n"), F.coalesce("content", F.lit("")), F.lit("\n")))


def packed(results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The blocks of each query up to the first that would pass the limit. Lengths are positive, so a running sum decides it."""
    upto = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return blocks(results).withColumn("upto", upto).filter(F.col("upto") <= limit)


def context(results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query_id, context. A query whose first block is too long has the header alone."""
    fit = packed(results, limit).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n").alias("body"))
    return results.select("query_id").distinct().join(fit, "query_id", "left").select("query_id", F.concat(F.lit(HEADER), F.coalesce("body", F.lit(""))).alias("context"))


def sources(results: DataFrame) -> DataFrame:
    """What an answer names as its sources."""
    return results.select("query_id", "rank", "chunk_id", "doc_id", "doc_name", "page", "section", snippet(F.col("content")).alias("content"), "source_type", F.when(F.col("source_type") == "web", F.col("url")).alias("url"))


def prompts(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """query_id, prompt from the question and its context."""
    user = F.concat(F.lit("资料:\n"), F.col("context"), F.lit("\n\n问题: "), F.col("question"), F.lit("\n\n请只依据以上资料回答，并注明来源。"))
    return questions.join(contexts, "query_id").select("query_id", F.concat(F.lit(system + "\n\n"), user).alias("prompt"))
