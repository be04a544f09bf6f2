"""A bounded sample of labelled documents for fitting a classifier.

Cases. Labels without a doc_id or a value are left out; of a doc_id with several labels the larger counts. Documents without a text, or of more than LONGEST code points, aren't fitted to; scoring has no such bounds. Repeated rows of a labelled document are
each fitted to. Empty tables give an empty sample. Columns but doc_id, text and the label are neither read nor needed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a model is fitted to, and the longest text among them. Scoring has no such bounds.
SAMPLE = 4000
LONGEST = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text is a multiple of 5. A null doc_id isn't one of them, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, longest: int = LONGEST) -> tuple[pa.Array, list[int]]:
    """Texts and labels of at most ``most`` documents that aren't held out, in the order of a hash of doc_id; of a doc_id with several labels the larger counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = known.orderBy(order, "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    table = rows.orderBy(order, "doc_id", "text").limit(most).select("text", "y").toArrow()
    return table.column("text").combine_chunks(), table.column("y").to_pylist()
