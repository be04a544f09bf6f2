"""Vector search: exact scan, and inverted cells by k-means."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.functions import vectors
from plumbago.operators.lexical import top

CELLS, PROBES = 128, 16
#: Query vectors that one scan broadcasts; more are asked in several scans.
QUERIES_A_SCAN = 10_000
#: Candidates that a task holds before it cuts them to the k best of each query.
HELD = 500_000


def normed(table: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The norm as a column, computed once a vector."""
    return table.withColumn("norm", vectors.norm(F.col(embedding)))


def search(queries: DataFrame, table: DataFrame, k: int = 5, mode: str = "cosine") -> DataFrame:
    """query_id, chunk_id, cosine, score, rank: exact, nearest by cosine first. The stated query set is scanned against all vectors in blocks of a checked size, by matrix products over batches; a task keeps k candidates a query. Rows without a vector aren't found."""
    whole = table.filter("embedding is not null").select(F.lit(0).alias("cell"), "chunk_id", "embedding")
    parts = [_best(whole, queries.schema["query_id"], ids, x, np.ones((len(ids), 1), bool), k) for ids, x in _asked(queries)]
    return reduce(lambda a, b: a.union(b), parts).select("query_id", "chunk_id", "cosine", vectors.score(F.col("cosine"), mode).alias("score"), "rank")


def _asked(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the stated query set, in blocks of a checked size that the driver holds one at a time; at least one."""
    some = queries.filter("embedding is not null").select("query_id", "embedding")
    blocks = max(1, -(-some.count() // QUERIES_A_SCAN))
    numbered = some.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.filter(F.col("block") == b).collect()
        if rows or not b:
            yield [r.query_id for r in rows], _units([r.embedding for r in rows]) if rows else np.zeros((0, 1))


class CellIndex:
    """Vectors by the nearest of some k-means centres, fitted to a bounded sample; every vector is indexed. Written partitioned by cell, so a probe reads its cells only."""

    def __init__(self, model, table: DataFrame):
        self.model, self.table = model, table

    @classmethod
    def fit(cls, table: DataFrame, cells: int = CELLS, sample: int = 50_000, seed: int = 1) -> CellIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.linalg import Vectors  # noqa: F401

        n = table.count()
        unit = lambda df: df.withColumn("v", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))))
        ready = unit(normed(table))
        some = ready if n <= sample else ready.orderBy(F.xxhash64("chunk_id")).limit(sample)
        model = KMeans(k=min(cells, max(1, n)), seed=seed, featuresCol="v", predictionCol="cell", maxIter=10).fit(some)
        return cls(model, model.transform(ready).drop("v"))

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        self.model.write().overwrite().save(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        from pyspark.ml.clustering import KMeansModel

        return cls(KMeansModel.load(f"{path}/centres"), spark.read.parquet(f"{path}/cells"))

    def _radii(self):
        """Of each cell, the distance of its farthest unit vector from the centre; as many as cells."""
        centres = np.array(self.model.clusterCenters())

        @F.pandas_udf("double")
        def away(embedding, cell):
            return pd.Series(np.linalg.norm(_units(embedding) - centres[cell.to_numpy()], axis=1))

        out = np.zeros(len(centres))
        for cell, far in self.table.groupBy("cell").agg(F.max(away("embedding", "cell"))).collect():
            out[cell] = far
        return out

    def search(self, queries: DataFrame, k: int = 5, probes: int = PROBES, mode: str = "cosine") -> DataFrame:
        """The k best of all vectors. The ``probes`` nearest cells of each query come first; then every other cell that may hold a vector as near as the k-th found.

        By the triangle inequality a cell has none if its centre is farther than its radius and the k-th distance together. Unit vectors are at the distance sqrt(2 - 2 cos);
        the slack covers the rounding of cosines to nine places. The stated query set is asked in blocks of a checked size, which the driver holds one at a time.
        """
        centres, radii = np.array(self.model.clusterCenters()), self._radii()
        out = []
        for ids, x in _asked(queries):
            far = np.stack([np.linalg.norm(x - c, axis=1) for c in centres], 1) if ids else np.zeros((0, len(centres)))
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, np.argsort(far, 1, kind="stable")[:, :probes], True, 1)
            near = _best(self.table, queries.schema["query_id"], ids, x, first, k).persist()
            kth = {r.query_id: r.cosine for r in near.filter(F.col("rank") == k).collect()}  # at most one a query
            reach = np.sqrt(np.maximum(2 - 2 * np.array([kth.get(i, -1.0) for i in ids]), 0) + 1e-8)  # without a k-th vector all are in reach
            may = (far - radii[None] <= reach[:, None] + 1e-6) & ~first
            out += [near, _best(self.table, queries.schema["query_id"], ids, x, may, k)]
        found = reduce(lambda a, b: a.union(b), out)
        return top(found.drop("rank"), k, F.round("cosine", 9)).select("query_id", "chunk_id", "cosine", vectors.score(F.col("cosine"), mode).alias("score"), "rank")


def _best(table: DataFrame, query_id: T.StructField, ids: list, x: np.ndarray, probed: np.ndarray, k: int) -> DataFrame:
    """query_id, chunk_id, cosine, rank: the k best of the cells marked in ``probed`` (queries x cells) for each query; a task keeps k candidates a query."""
    schema = T.StructType([query_id, table.schema["chunk_id"], T.StructField("cosine", T.DoubleType())])
    told = table.sparkSession.sparkContext.broadcast((ids, x, probed))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, probed = told.value
        best, held, size, floor = pd.DataFrame({"q": [], "chunk_id": [], "cosine": []}), [], 0, np.full(len(ids), -np.inf)

        def cut() -> pd.DataFrame:
            every = pd.concat([f for f in (best, *held) if len(f)]) if size or len(best) else best
            every = every.assign(by=-every["cosine"].round(9)).sort_values(["q", "by", "chunk_id"])
            return every[every.groupby("q").cumcount() < k].drop(columns="by")

        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                asked = np.flatnonzero(probed[:, cell])
                some = max(1, HELD // max(1, len(asked)))
                for at in range(0, len(rows) if len(asked) else 0, some):
                    part = rows.iloc[at : at + some]
                    cos = x[asked] @ _units(part["embedding"]).T
                    least = np.partition(cos, -k, 1)[:, -k] if cos.shape[1] > k else np.full(len(asked), -np.inf)
                    q, v = np.nonzero(cos >= np.maximum(least, floor[asked])[:, None] - 2e-9)
                    held.append(pd.DataFrame({"q": asked[q], "chunk_id": part["chunk_id"].to_numpy()[v], "cosine": cos[q, v]}))
                    size += len(q)
                    if size > HELD:
                        best, held, size = cut(), [], 0
                        full = best.groupby("q")["cosine"].agg(["size", "min"])
                        full = full[full["size"] == k]
                        floor[full.index.to_numpy(int)] = full["min"]
        best = cut()
        if len(best):
            yield pd.DataFrame({"query_id": [ids[q] for q in best["q"].astype(int)], "chunk_id": best["chunk_id"].to_numpy(), "cosine": best["cosine"].to_numpy()})

    return top(table.select("cell", "chunk_id", "embedding").mapInPandas(work, schema), k, F.round("cosine", 9))


def _units(embedding) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in embedding])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine similarity of vectors paired by ``pair_id``."""
    return left.select("pair_id", F.col("embedding").alias("a")).join(right.select("pair_id", F.col("embedding").alias("b")), "pair_id").select("pair_id", vectors.cosine(F.col("a"), F.col("b")).alias("similarity"))
