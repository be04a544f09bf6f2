"""Corpus files: markdown read whole, tables from CSV, Parquet or workbooks, with failures as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.operators.ingest import identified, to_pages, to_records
from plumbago.sources import workbooks

#: Suffixes in the order in which a folder is read.
MARKDOWN, WORKBOOKS = ("md",), ("xls", "xlsx")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, text, doc_id, doc_name, status of the markdown files of a folder (not of its subfolders). A file that isn't UTF-8 has an empty text and the status ``failed``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select("path", F.coalesce(decoded, F.lit("")).alias("text"), F.when(decoded.isNull(), "failed").otherwise("ok").alias("status"), name.alias("name"))
    return identified(rows, F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))).drop("name")


def table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one table with their number in ``row_index``: CSV with a header, Parquet, or a workbook's first sheet."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
    elif path.rsplit(".", 1)[-1] in WORKBOOKS:
        return workbook(spark, path)
    else:
        raise ValueError(f"not a table: {path}")
    return rows.withColumn("row_index", F.monotonically_increasing_id())


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, all values as text, its first row as names."""
    blob = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one workbook
    names, rows = workbooks.first_sheet(bytes(blob), path)
    schema = T.StructType([T.StructField("row_index", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema)


def workbook_records(spark: SparkSession, folder: str) -> DataFrame:
    """path, doc_id, doc_name, status and records (row_index, content, raw_data) of the workbooks of a folder (not of its subfolders). One that can't be read has no records and the status ``failed``. A task holds one workbook."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xls,xlsx}").load(folder).select("path", "content")

    @F.pandas_udf("struct<status:string,records:array<struct<row_index:int,content:string,raw_data:map<string,string>>>>")
    def read(paths: pd.Series, blobs: pd.Series) -> pd.DataFrame:
        out = []
        for path, blob in zip(paths, blobs, strict=True):
            try:
                out.append(("ok", [{"row_index": k, "content": c, "raw_data": d} for k, c, d in workbooks.records(*workbooks.first_sheet(blob, path))]))
            except Exception:  # a broken file, or one without a reader, is told as such
                out.append(("failed", []))
        return pd.DataFrame(out, columns=["status", "records"])

    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select("path", read("path", "content").alias("r"), name.alias("name")).select("path", "name", "r.status", "r.records")
    return identified(rows, F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))).drop("name")


def pick_folder(spark: SparkSession, base: str) -> str:
    """``processed`` if it has files, else ``raw``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/processed")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{base}/processed" if fs.exists(path) and len(fs.listStatus(path)) else f"{base}/raw"


def parse_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One markdown file as pages: doc_id, doc_name, page, content."""
    folder, _, name = path.rpartition("/")
    return to_pages(markdown(spark, folder or ".").filter(F.element_at(F.split("path", "/"), -1).isin(name, name.replace(" ", "%20")) & (F.col("status") == "ok")))


def parse_table(spark: SparkSession, path: str) -> DataFrame:
    """One table as records: row_index, content, raw_data."""
    return to_records(table(spark, path), "row_index")
