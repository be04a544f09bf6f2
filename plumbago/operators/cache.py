"""A result cache as a table: key, data, question, created_at, expires_at. First in, first out; a hit doesn't extend an entry."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions.text import cache_key

TTL = timedelta(seconds=3600)
ENTRIES = 1000
SCHEMA = "key string, data string, question string, created_at timestamp, expires_at timestamp"


def keyed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("key", cache_key(F.col("question"), F.col("use_web_search")))


def get(cache: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests with data, null for a miss; an entry lives until after expires_at."""
    live = cache.filter(now <= F.col("expires_at")).select("key", "data")
    return keyed(requests).join(live, "key", "left")


def put(cache: DataFrame, answers: DataFrame, now: Column, ttl: timedelta = TTL, entries: int = ENTRIES) -> DataFrame:
    """The cache with answers (question, use_web_search, data) in it. As many of the oldest entries go as answers come in beyond the bound, an answer that overwrites its key included."""
    new = keyed(answers).dropDuplicates(["key"]).select("key", "data", "question", now.alias("created_at"), (now + F.expr(f"interval {int(ttl.total_seconds())} seconds")).alias("expires_at"))
    old = cache.join(new.select("key"), "key", "left_anti")
    return old.unionByName(new).orderBy(F.col("created_at").desc(), "key").limit(entries)  # each task keeps no more


def invalidate(cache: DataFrame, requests: DataFrame) -> DataFrame:
    return cache.join(keyed(requests).select("key"), "key", "left_anti")


def clear(cache: DataFrame) -> DataFrame:
    """The cache without entries."""
    return cache.limit(0)


def evicted(cache: DataFrame) -> DataFrame:
    """The key that goes next."""
    return cache.agg(F.min_by("key", F.struct("created_at", "key")).alias("key"))


def stats(cache: DataFrame, ttl: timedelta = TTL, entries: int = ENTRIES) -> DataFrame:
    return cache.agg(F.count("*").alias("entries")).select("entries", F.lit(entries).alias("max_size"), F.lit(int(ttl.total_seconds())).alias("ttl_seconds"))


def save(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)


def load(spark, path: str, now: Column) -> DataFrame:
    """A saved cache without what has expired."""
    return spark.read.schema(SCHEMA).json(path).filter(F.col("expires_at") > now)


def replay(events: DataFrame, key: Column, ttl: timedelta = TTL) -> DataFrame:
    """key, requests, hits of a request log under the time to live alone: a request later than ttl after the entry it would hit makes a new entry. Requests without a time are left out.

    Every step depends on the last entry of the key, so each key is read in order of time, as a stream of sorted batches: a task holds one batch and one key's state, however many requests a key has.
    """
    micros = int(ttl.total_seconds() * 1_000_000)
    times = events.select(key.cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).filter("t is not null")
    ordered = times.repartition("key").sortWithinPartitions("key", "t")
    types = pa.schema([("key", pa.string()), ("requests", pa.int64()), ("hits", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: list = []  # key, requests, hits, time of the living entry
        for b in batches:
            keys, t = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            done = []
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if not open_key or open_key[0] != keys[i]:
                    if open_key:
                        done.append(open_key[:3])
                    open_key = [keys[i], 0, 0, None]
                open_key[1] += j - i
                while i < j:
                    if open_key[3] is not None and t[i] - open_key[3] <= micros:
                        n = int(np.searchsorted(t[i:j], open_key[3] + micros, "right"))
                        open_key[2] += n
                        i += n
                    else:
                        open_key[3] = int(t[i])
                        i += 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, d, strict=True)) for d in done], types)
        if open_key:
            yield pa.RecordBatch.from_pylist([dict(zip(types.names, open_key[:3], strict=True))], types)

    return ordered.mapInArrow(work, "key string, requests long, hits long")
