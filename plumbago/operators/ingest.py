"""From files and rows to pages, records and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.functions import chunking, text

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def identified(files: DataFrame, file_name: Column) -> DataFrame:
    """files with doc_id and doc_name."""
    return files.withColumns({"doc_id": text.doc_id(file_name), "doc_name": text.doc_name(file_name)})


def to_pages(files: DataFrame, size: int = 1000) -> DataFrame:
    """doc_id, doc_name, page, content from doc_id, doc_name, text: cleaned, then cut."""
    cleaned = files.withColumn("text", text.clean_markdown(F.col("text")))
    return cleaned.select("doc_id", "doc_name", F.explode(text.pages(F.col("text"), size)).alias("p")).select("doc_id", "doc_name", "p.page", "p.content")


def to_chunks(pages: DataFrame, size: int = 1000, carry: int = 200, least: int = 100, drop_small_tables: bool = True) -> DataFrame:
    """Chunks of pages, numbered along each document. One document's pages meet in one task, as its numbering demands."""
    cut = pages.filter(~text.blank(F.col("content"))).select("doc_id", "doc_name", "page", F.posexplode(chunking.chunks("content", size, carry, least, drop_small_tables)).alias("pos", "c"))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1).cast("int")
    return cut.withColumn("index", index).select(
        text.chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"),
        "doc_id",
        "doc_name",
        F.col("c.content").alias("content"),
        "page",
        F.lit(None).cast("string").alias("section"),
        F.lit("local").alias("source_type"),
        F.create_map(F.lit("index"), F.col("index").cast("string"), F.lit("is_table"), F.col("c.is_table").cast("string")).alias("metadata"),
    )


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``name: value; name: value`` of a row, without unnamed columns, empty values and ``nan``."""
    named = [c for c in (columns or df.columns) if "Unnamed" not in c and c.strip()]
    part = lambda c: F.when(~text.strip(F.col(f"`{c}`").cast("string")).isin("", "nan"), F.concat(F.lit(f"{c.strip()}: "), text.strip(F.col(f"`{c}`").cast("string"))))
    return F.concat_ws("; ", *map(part, named))


def to_records(rows: DataFrame, row_index: str) -> DataFrame:
    """row_index, content, raw_data of the rows that aren't all null and say something; row_index is the row's number in its source."""
    data = [c for c in rows.columns if c != row_index]
    there = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("NaN")) if isinstance(rows.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{c}`").cast("string")
    known = rows.filter(F.coalesce(*map(there, data)).isNotNull()) if data else rows.limit(0)
    raw = F.map_from_arrays(F.array(*(F.lit(c.strip() if "Unnamed" not in c else "") for c in data if "Unnamed" not in c)), F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in data if "Unnamed" not in c)))
    return known.select(F.col(f"`{row_index}`").cast("int").alias("row_index"), row_text(rows, data).alias("content"), raw.alias("raw_data")).filter(~text.blank(F.col("content")))


def header_rows(rows: DataFrame, row_index: str, look: int = 5) -> int:
    """How many of the first rows are all null."""
    data = [c for c in rows.columns if c != row_index]
    filled = rows.filter(F.col(row_index) < look).filter(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in data)).isNotNull())
    first = filled.agg(F.min(row_index)).first()[0]
    return min(look, rows.filter(F.col(row_index) < look).count()) if first is None else int(first)


def record_chunks(records: DataFrame, doc_id: str, doc_name: str) -> DataFrame:
    """A chunk a record; ids count the records in the order of row_index. They are sorted over all tasks and numbered by the sizes of the parts, as one source may hold all rows."""
    ordered = records.repartitionByRange("row_index").withColumn("part", F.spark_partition_id()).persist()
    sizes = dict(ordered.groupBy("part").count().collect())  # a row a partition
    before, at = {}, 0
    for part in sorted(sizes):
        before[part] = at
        at += sizes[part]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("part")] if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy("row_index")) - 1
    return _record_chunks(ordered.withColumn("i", (offset + within).cast("int")).filter(~text.blank(F.col("content"))), F.lit(doc_id), F.lit(doc_name))


def workbook_chunks(books: DataFrame) -> DataFrame:
    """A chunk a record of workbooks (doc_id, doc_name, records), numbered along each."""
    rows = books.select("doc_id", "doc_name", F.posexplode("records").alias("i", "r")).select("doc_id", "doc_name", "i", "r.*")
    return _record_chunks(rows, F.col("doc_id"), F.col("doc_name"))


def _record_chunks(numbered: DataFrame, doc_id: Column, doc_name: Column) -> DataFrame:
    own = F.create_map(F.lit("row_index"), F.col("row_index").cast("string"), F.lit("index"), F.col("i").cast("string"))
    raw = F.map_filter("raw_data", lambda k, v: ~k.isin("row_index", "index"))  # the chunk's own numbers win
    return numbered.select(
        text.chunk_id(doc_id, F.col("i")).alias("chunk_id"),
        doc_id.alias("doc_id"),
        doc_name.alias("doc_name"),
        "content",
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("string").alias("section"),
        F.lit("local").alias("source_type"),
        F.map_concat(own, raw).alias("metadata"),
    )
