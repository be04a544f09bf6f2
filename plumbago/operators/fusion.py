"""Fusion of two rankings, the gate of the web branch, reranking, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights, bonus and thresholds of fusion, the web gate and reranking.
VECTOR_WEIGHT, LEXICAL_WEIGHT, BONUS = 0.6, 0.4, 1.2
WEB_BELOW = 0.5
LOCAL_WEIGHT, WEB_WEIGHT, WEB_DEFAULT = 0.7, 0.3, 0.5
#: Domains that count as authorities.
AUTHORITIES = ["mot.gov.cn", "mohurd.gov.cn", "std.samr.gov.cn", "openstd.samr.gov.cn", "cnki.net", "wanfangdata.com.cn"]


def best(side: DataFrame) -> DataFrame:
    """The best score and first rank of each chunk over all variants of a query."""
    return side.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """query_id, chunk_id, vector_score, lexical_score, score, rank. A chunk that both sides score above 0 gains a fifth, at most to 1."""
    v = best(vector).select("query_id", "chunk_id", F.col("score").alias("v"), F.col("rank").alias("v_rank"))
    b = best(lexical).select("query_id", "chunk_id", F.col("score").alias("b"), F.col("rank").alias("b_rank"))
    both = v.join(b, ["query_id", "chunk_id"], "full_outer")
    vs, bs = F.coalesce("v", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    plain = VECTOR_WEIGHT * vs + LEXICAL_WEIGHT * bs
    scored = both.select("query_id", "chunk_id", vs.alias("vector_score"), bs.alias("lexical_score"), F.when((vs > 0) & (bs > 0), F.least(BONUS * plain, F.lit(1.0))).otherwise(plain).alias("score"), "v_rank", "b_rank")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.coalesce("v_rank", F.lit(1 << 30)), F.coalesce("b_rank", F.lit(1 << 30)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).drop("v_rank", "b_rank")


def needs_web(queries: DataFrame, fused: DataFrame, below: float = WEB_BELOW) -> DataFrame:
    """query_id, top_score, use_web: no local result, or none that reaches the threshold."""
    top = fused.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", "top_score", (F.coalesce("top_score", F.lit(0.0)) < below).alias("use_web"))


def web_id(url):
    """A reproducible id of a web result."""
    return F.concat(F.lit("web_"), F.lpad(F.pmod(F.xxhash64(url), F.lit(1000000)).cast("string"), 6, "0"))


def is_authority(url):
    return F.exists(F.array(*map(F.lit, AUTHORITIES)), lambda d: F.contains(url, d))


def rerank(local: DataFrame, web: DataFrame, k: int = 5) -> DataFrame:
    """The k best of local and web results, weighted. local: query_id, chunk_id, doc_id, doc_name, content, page, section, score, rank; web: query_id, title, content, url, score, rank."""
    ours = local.select("query_id", "chunk_id", "doc_id", "doc_name", "content", F.col("page").cast("int").alias("page"), "section", F.lit("local").alias("source_type"), F.lit(None).cast("string").alias("url"), (F.col("score") * LOCAL_WEIGHT).alias("score"), F.lit(0).alias("side"), "rank")
    base = F.when(F.col("score") != 0, F.col("score")).otherwise(WEB_DEFAULT)
    none = F.lit(None).cast("string")
    theirs = web.select("query_id", web_id(F.col("url")).alias("chunk_id"), F.lit("web").alias("doc_id"), F.col("title").alias("doc_name"), "content", F.lit(None).cast("int").alias("page"), none.alias("section"), F.lit("web").alias("source_type"), "url", (base * WEB_WEIGHT).alias("score"), F.lit(1).alias("side"), "rank")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "side", "rank")
    return ours.unionByName(theirs).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("side", "rank").withColumnRenamed("place", "rank")


def merge(lists: list[DataFrame]) -> DataFrame:
    """Result lists (query_id, chunk_id, score, rank) in order: the first occurrence of a chunk stays, whatever its score; then by score."""
    every = reduce(lambda a, b: a.unionByName(b), (d.select("query_id", "chunk_id", "score", F.lit(k).alias("list"), "rank") for k, d in enumerate(lists)))
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("list", "rank"))).filter("n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "list", "rank"))).select("query_id", "chunk_id", "score", F.col("place").alias("rank"))


def unique_documents(results: DataFrame) -> DataFrame:
    """The first result of each document of an answer."""
    return results.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_name").orderBy("rank"))).filter("n = 1").drop("n")
