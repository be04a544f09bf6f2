"""The vector table: Parquet with one row a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbago.sources.versions import Versions

SCHEMA = "chunk_id string, embedding array<float>, content string, doc_id string, doc_name string, page bigint, section string, source_type string, chunk_index int"
#: Longest values, in code points.
LIMITS = {"content": 65535, "doc_name": 512, "section": 256}
FIELDS = ("chunk_id", "content", "doc_id", "doc_name", "page", "section", "source_type", "chunk_index")


class VectorStore:
    """Append, look up, filter, delete, truncate, count. What changes rows writes a version of the table and is seen once that is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def exists(self) -> bool:
        return self.versions.current() is not None

    def initialize(self) -> VectorStore:
        """Connect, or create an empty table."""
        if not self.exists():
            self.spark.createDataFrame([], SCHEMA).write.parquet(self.versions.next())
        return self

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.versions.current())

    @staticmethod
    def rows(chunks: DataFrame) -> DataFrame:
        """Chunks as they are stored: those with a vector, cut to the limits, nulls filled. A chunk's number in its document is what its metadata call ``index``."""
        cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, LIMITS[c]).alias(c)
        index = F.col("chunk_index") if "chunk_index" in chunks.columns else F.col("metadata")["index"] if "metadata" in chunks.columns else F.lit(None)
        return chunks.filter("embedding is not null").select(
            "chunk_id",
            F.col("embedding").cast("array<float>").alias("embedding"),
            cut("content"),
            F.coalesce("doc_id", F.lit("")).alias("doc_id"),
            cut("doc_name"),
            F.coalesce(F.col("page").cast("bigint"), F.lit(0).cast("bigint")).alias("page"),
            cut("section"),
            F.coalesce("source_type", F.lit("local")).alias("source_type"),
            F.coalesce(index.cast("int"), F.lit(0)).alias("chunk_index"),
        )

    def replaced(self, chunks: DataFrame) -> DataFrame:
        """The stored chunks of the documents that the chunks belong to."""
        return self.table().join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")

    def add(self, chunks: DataFrame, mode: str = "append") -> int:
        """Number of rows added. ``replace`` first drops the documents that the chunks belong to."""
        seen = Observation()
        rows = self.rows(chunks).observe(seen, F.count(F.lit(1)).alias("n"))
        if mode == "replace":
            left = self.table().join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("chunk_id", "embedding", *FIELDS[1:])
            self._write(left.unionByName(rows))
        else:
            rows.write.mode("append").parquet(self.versions.current())
        return seen.get["n"]

    def get(self, chunk_id: str) -> DataFrame:
        """One chunk; the filter reaches the scan."""
        return self.table().filter(F.col("chunk_id") == chunk_id).select(*FIELDS).limit(1)

    def where(self, condition: Column) -> DataFrame:
        return self.table().filter(condition)

    def delete_document(self, doc_id: str) -> None:
        self._write(self.table().filter(F.col("doc_id") != doc_id))

    def reset(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        rows.write.parquet(self.versions.next())
        self.versions.prune()

    def stats(self) -> DataFrame:
        return stats(self.table())


def stats(chunks: DataFrame) -> DataFrame:
    """total_chunks, total_documents."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct(F.expr("nullif(doc_id, '')")).alias("total_documents"))


def documents(chunks: DataFrame) -> DataFrame:
    """doc_id of every document, in order."""
    return chunks.filter("doc_id != ''").select("doc_id").distinct().orderBy("doc_id")
