"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what passes it.

A canonical URL is the host (A-Z lower-cased) followed by the path, without scheme, query and fragment. A listed entry fits its host and all subdomains if the path begins with the entry's. The filter holds the listed hosts and the listed entries. A URL
is looked up in two steps: the suffixes of its host, up to as many labels as a listed host has, and, for those that pass alone, the beginnings of its path at every length that a listed path has. Blocks have 512 bits in eight words; an entry sets one bit in each word of one block. The
filter is built on the executors and OR-ed together block by block; its size is at most MOST_BLOCKS blocks (64 MiB) whatever the list's size, so it can be broadcast. The join removes all false positives, so the filter's fill affects cost alone: at 16 bits an entry few pass, beyond 33
million entries and hosts more and more. Of entries that fit, the longest wins; rules go before the list.

Cases. A null URL, or one without ``://``, has an empty host and path and fits nothing. Of equal entries with different verdicts, block wins. Repeated rows are judged each, with equal results. An empty list judges all URLs
by the default; an empty table gives an empty result. Very long hosts and paths are whole. Other columns pass through judge() unchanged; host, path, rule and verdict
replace columns of these names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm.cluster import checkpoint, fresh, read, small

BITS_PER_ENTRY = 16
MOST_BLOCKS = 1 << 20
#: Look-ups that a task holds at a time.
CANDIDATES = 8192
_HOST = "\0"  # stands before a host in the filter, never in an entry
#: Rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Blocked hosts of the query, for URLs that no rule fits.
LISTED = [(f"{name}.example.{top}", "/") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _places(entries: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each entry, and its eight words' bits."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(e.encode("utf-8", "surrogatepass")) for e in entries), np.uint64, len(entries))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    salts = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)  # fixed odd multipliers of split-block filters
    bit = ((h[:, None] * salts) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << bit


class Bloom:
    """A blocked Bloom filter in numpy."""

    def __init__(self, blocks: int):
        self.words = np.zeros((blocks, 8), np.uint64)

    def passes(self, entries: list[str]) -> np.ndarray:
        block, bits = _places(entries, len(self.words))
        return ((self.words[block] & bits) == bits).all(1)


def build(listed: DataFrame, entries: int) -> Bloom:
    """The filter of the column ``entry``."""
    blocks = int(min(MOST_BLOCKS, max(1, -(-entries * BITS_PER_ENTRY // 512))))
    names = [f"w{k}" for k in range(8)]
    schema = pa.schema([("block", pa.int64()), *((n, pa.int64()) for n in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, bits = _places(b.column(0).to_pylist(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(bits[:, k].view(np.int64)) for k in range(8))], schema=schema)

    out = Bloom(blocks)
    rows = listed.select("entry").mapInArrow(work, "block long, " + ", ".join(f"{n} long" for n in names)).groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names))
    for r in rows.toLocalIterator():
        out.words[r[0]] = np.array(r[1:], np.int64).view(np.uint64)
    return out


def suffixes(host: str, labels: int) -> list[str]:
    """The host's ends of at most so many labels."""
    parts = host.rsplit(".", labels) if host and labels else []
    return [".".join(parts[k:]) for k in range(max(0, len(parts) - labels), len(parts))]


def _hits(bloom: Bloom, urls: Iterator[tuple[str, str, str]], labels: int, lengths: list[int]) -> Iterator[tuple[str, str]]:
    """(key, entry) of all that passes the filter, from key, host, path."""

    def passing(found: Iterator[tuple[tuple, str]]) -> Iterator[tuple[tuple, str]]:
        while some := list(islice(found, CANDIDATES)):
            ok = bloom.passes([e for _, e in some])
            yield from (some[k] for k in np.flatnonzero(ok).tolist())

    hosts = passing(((key, path, end), _HOST + end) for key, host, path in urls for end in suffixes(host, labels))
    for (key, _, _), entry in passing(((x, x[2] + x[1][:n]) for x, _ in hosts for n in lengths[: bisect_right(lengths, len(x[1]))])):
        yield key, entry


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the entry of rules that fits, or null) and verdict. rules: host, path, verdict; listed: host, path of blocked URLs."""
    pages = pages.drop("host", "path", "rule", "verdict")
    known = rules.select("host", "path", "verdict", F.lit(1).alias("first")).union(listed.select("host", "path", F.lit("block"), F.lit(0)))
    known = known.groupBy(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("entry"), "first").agg(F.max("verdict").alias("verdict"), F.collect_set(F.length("path")).alias("lengths"), F.collect_set(F.translate("host", _UPPER, _LOWER)).alias("hosts"))
    known = checkpoint(known)
    lengths = sorted(r[0] for r in known.select(F.explode("lengths")).distinct().collect())  # as many as paths have lengths
    labels = known.agg(F.coalesce(F.max(F.array_max(F.transform("hosts", lambda h: F.size(F.split(h, "[.]"))))), F.lit(0))).first()[0]
    every = known.select("entry").union(known.select(F.explode("hosts").alias("h")).distinct().select(F.concat(F.lit(_HOST), "h")))
    told = pages.sparkSession.sparkContext.broadcast((build(every, every.count()), labels, lengths))
    urls = pages.select(F.md5("url").alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host != ''")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for i in range(0, b.num_rows, 1024) for x in zip(*(b.column(c).slice(i, 1024).to_pylist() for c in range(3)), strict=True))
        hits = _hits(told.value[0], rows, *told.value[1:])
        while some := list(islice(hits, CANDIDATES)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.string()) for k in (0, 1)], ["key", "entry"])

    maybe = urls.mapInArrow(work, "key string, entry string")
    known = known.select("entry", "first", "verdict")
    fits = maybe.join(small(known), "entry").groupBy("key").agg(F.max(F.struct("first", F.length("entry").alias("n"), "entry", "verdict")).alias("best"))
    fits = checkpoint(fits.select(F.col("key").alias(key := fresh(pages, "key")), F.when(F.col("best.first") == 1, F.col("best.entry")).alias("rule"), F.col("best.verdict").alias("verdict")))
    rows = pages.withColumn(key, F.md5("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.join(small(fits), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(key)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(LISTED, "host string, path string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with p as (
  select page_id, case when url like '%://%' then translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when url like '%://%' then regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), k(r_host, r_path, r_verdict, first) as (values """ + ", ".join(f"('{h}', '{p}', '{v}', 1)" for h, p, v in RULES) + ", " + ", ".join(f"('{h}', '{p}', 'block', 0)" for h, p in LISTED) + """),
best as (
  select page_id, host, path, first, r_host || r_path as entry, r_verdict, row_number() over (partition by page_id, host, path order by first desc nulls last, length(r_host || r_path) desc) as n
  from (select distinct page_id, host, path from p) left join k on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select p.page_id, p.host, p.path, case when first = 1 then entry end as rule, coalesce(r_verdict, 'allow') as verdict
from p join best b on p.page_id is not distinct from b.page_id and p.host = b.host and p.path = b.path and n = 1
"""
