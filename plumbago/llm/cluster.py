"""What the operators share on a cluster: the checkpoint folder, row keys, size-checked broadcasts, components.

Cases. Keys tell nulls from empty texts; equal rows have equal keys. Empty frames are small and have no components; an edge from a node to itself gives the node. Names from fresh() clash with no column of the frame in any case.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was counted to have no more rows and bytes than these; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder the session names; a folder of our own only where it names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbago-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted rows and bytes allow it. ``df`` is read once more for that: a kept or cheap frame."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)

    def width(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, plain):
            return F.lit(8)
        return F.coalesce(F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))), F.lit(0)) + 16

    n, held = df.agg(F.count("*"), F.sum(reduce(lambda a, b: a + b, map(width, df.schema.fields)).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows apart by these columns, nulls included."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (node, root): smallest neighbour's label, then pointer jumping, until nothing changes.

    The number of rounds is logarithmic in the diameter. No edge or label is ever collected; a node with very many edges is met by
    partial aggregation.
    """
    both = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        seen = both.join(labels, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "root")
        least = seen.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        least = checkpoint(least)
        up = least.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = least.join(up, "root").select("node", F.least("root", "top").alias("root"))
        new = checkpoint(new)
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").filter(F.col("root") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels
