"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every item of the benchmark becomes its windows of eight consecutive words (one window of all its words if it has fewer, none if it has
no words). The windows' hashes, sorted, and the normalised texts that they point into are sent to all executors in blocks of a bounded number of windows; documents are tokenised and hashed in numpy, a bitmap
drops nearly all positions, a sorted search the rest, and every hit is verified word by word. All blocks are scanned the same way: the first tells the number of words of every row, every one the rows that it hits, and
the findings of a row are merged by a key of the columns kept and its text. Nothing is left out.

Cost. A window takes some 30 bytes beside its text. The driver makes one block at a time and drops it once it is sent.

Cases. Null and empty texts have no words: no hits, and as benchmark items no windows. Items that share a window are all reported. Repeated
rows of documents are judged each; repeated item_ids count once; a null item_id is reported as "null". Very long texts are whole: they are hashed
in pieces of bounded memory; an item longer than a block is cut into blocks that overlap by a window. Empty tables give empty results. Further columns are kept by clean() and ignored by scan().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm.arrays import let, replaced, running
from plumbago.llm.cluster import checkpoint, fresh, read, row_key, small
from plumbago.llm.text import Words, arrow_schema, blocks, grams, words_of

WINDOW = 8
#: A document with this many items counts as contaminated.
ITEMS = 2
#: Most windows in one broadcast; a larger benchmark is cut into blocks.
BLOCK_WINDOWS = 1 << 20
_BITS = 22


class Index:
    """Windows of some items: for each length a bitmap, the sorted hashes, and for each entry where its words lie in the normalised texts and which item it is of. Equal hashes stand together."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        """items: each with its words, lower-cased."""
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        self.said = b" ".join(b" ".join(w) for _, w in items)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        at = 0
        for item, w in items:
            size = np.array([len(x) + 1 for x in w], np.int64)
            begin = at + np.cumsum(size) - size
            n = min(window, len(w))
            data = b" ".join(w)
            words = words_of(data, np.array([0, len(data)]))
            h, first = grams(words.hashes(), words.first, n)
            found.setdefault(n, []).append((h, begin[first], begin[first + n - 1] + size[first + n - 1] - 1, np.full(len(h), number[item], np.int32)))
            at += len(data) + 1
        for n, parts in found.items():
            h, begin, end, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[h >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = (bitmap, h[order], begin[order], end[order], item[order])

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie inside an occurrence of a window, and the items found in each text."""
        hit, items = np.zeros(len(words), bool), {}
        if not len(words):
            return hit, items
        hashes = words.hashes()
        for n, (bitmap, listed, begin, end, item) in self.by_length.items():
            g, at = grams(hashes, words.first, n)
            maybe = np.flatnonzero(bitmap[g >> np.uint64(64 - _BITS)])
            g, at = g[maybe], at[maybe]
            low, high = np.searchsorted(listed, g), np.searchsorted(listed, g, "right")
            maybe = np.flatnonzero(low < high)
            text = np.searchsorted(words.first, at[maybe], "right") - 1
            for i, a, b, k in zip(at[maybe].tolist(), low[maybe].tolist(), high[maybe].tolist(), text.tolist(), strict=True):
                said = b" ".join([words.word(x) for x in range(i, i + n)])
                if of := {int(item[e]) for e in range(a, b) if self.said[begin[e] : end[e]] == said}:
                    hit[i : i + n] = True
                    items.setdefault(k, set()).update(of)
        return hit, {k: {self.items[x] for x in of} for k, of in items.items()}


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _runs(mask: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, int, np.ndarray, list, list]]:
    """For blocks of rows: number of words, runs of hit words (word numbers and code points), items."""
    for i, j, data, off in blocks(column):
        words = words_of(data, off)
        hit, items = index.hits(words)
        runs: list = [[] for _ in range(j - i)]
        for k in items:
            a, b = words.first[k], words.first[k + 1]
            seen, chars = 0, 0  # code points are counted once along the text
            text = data[off[k] : off[k + 1]]
            for x, y in _runs(hit[a:b]).tolist():
                at = []
                for byte in (int(words.starts[a + x] - off[k]), int(words.ends[a + y - 1] - off[k])):
                    chars += len(text[seen:byte].decode("utf-8", "surrogatepass"))
                    seen = byte
                    at.append(chars)
                runs[k].append({"first": x, "after": y, "start": at[0], "end": at[1]})
        yield i, j, words.counts, runs, [sorted(items.get(k, ())) for k in range(j - i)]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Index]:
    """The benchmark by blocks of at most ``most`` windows, one at a time; at least one, though it be empty."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    held, size, made = [], 0, 0
    for item, text in rows.toLocalIterator():
        data = text.encode("utf-8", "surrogatepass")
        words = words_of(data, np.array([0, len(data)]))
        said = [words.word(k) for k in range(len(words))]
        while said:
            windows = max(1, len(said) - WINDOW + 1)
            if held and size + windows > most:
                yield Index(held)
                held, size, made = [], 0, made + 1
            some = said if windows <= most else said[: most + WINDOW - 1]
            held.append((item, some))
            size += max(1, len(some) - WINDOW + 1)
            said = said[most:] if windows > most else []
    if held or not made:
        yield Index(held)


def scan(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with n_words, runs (hit words: word numbers, code points, end exclusive) and items, in a struct ``found``."""
    keep = docs.columns if keep is None else keep
    found = "found" if "found" not in [c.lower() for c in keep] else fresh(docs, "found")
    sc = docs.sparkSession.sparkContext
    told = [sc.broadcast(index) for index in _blocks(benchmark, block_windows)]
    key, text = fresh(docs, "key"), fresh(docs, "scanned")
    keyed = docs.select(*keep, F.col("text").cast("string").alias(text))
    if len(told) == 1:
        return _scanned(keyed, keep, text, told[0], found)
    rows = keyed.withColumn(key, row_key(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in keep), F.md5(text)))  # rows that share it share their findings
    whole = _scanned(rows.select(*keep, key, text), [*keep, key], text, told[0], found)
    rest = [_scanned(rows.select(key, text), [key], text, index, found, True) for index in told[1:]]
    also = reduce(lambda a, b: a.union(b), rest).distinct().groupBy(F.col(key).alias(other := fresh(whole, "other"))).agg(F.flatten(F.collect_list(f"{found}.runs")).alias("r"), F.flatten(F.collect_list(f"{found}.items")).alias("i"))  # at most one row a block
    also = checkpoint(also.select(other, F.struct("r", "i").alias(more := fresh(whole, "more"))))
    joined = whole.join(small(also), F.col(key) == F.col(other), "left")
    f, m = F.col(found), F.col(more)
    both = F.when(m.isNull(), f).otherwise(F.struct(f["n_words"].alias("n_words"), F.expr(_joined(f"concat({found}.runs, {more}.r)")).cast(_FOUND["runs"].dataType).alias("runs"), F.array_sort(F.array_distinct(F.concat(f["items"], m["i"]))).alias("items")))
    return joined.select(*keep, both.alias(found))


def _joined(runs: str) -> str:
    """SQL for runs of several blocks in order, those that meet made one."""
    upto = lambda part: running(f"transform(s, y -> y.{part})", "greatest(p, q)")
    last = "if(j + 1 < size(f), f[j + 1], size(s)) - 1"
    made = f"transform(f, (i, j) -> named_struct('first', s[i].first, 'after', m.after[{last}], 'start', s[i].start, 'end', m.end[{last}]))"
    firsts = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].first > m.after[i - 1])"
    return let("s", f"array_sort({runs})", let("m", f"named_struct('after', {upto('after')}, 'end', {upto('end')})", let("f", firsts, made)))


def _scanned(rows: DataFrame, keep: list[str], text: str, told: Broadcast, found: str, hits_only: bool = False) -> DataFrame:
    """The columns ``keep`` (the first of rows) and the findings in the last column, ``text``; of all rows, or of those with findings."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(found, _FOUND)])
    types = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts, runs, items in _scan(batch.column(len(keep)), told.value):
                struct = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, types.field(found).type.field("runs").type), pa.array(items, pa.list_(pa.string()))], fields=list(types.field(found).type))
                out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).cast(types.field(c).type) for c in range(len(keep))), struct], schema=types)
                yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if hits_only else out

    return rows.select(*keep, text).mapInArrow(work, schema)


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of docs without contaminated documents (``items`` or more items found); from the others the hit spans are cut out of the text."""
    found = scan(docs, benchmark)
    f = found.columns[-1]
    runs = F.col(f)["runs"]
    return found.filter(F.size(F.col(f)["items"]) < items).withColumn("text", F.when(F.size(runs) > 0, F.expr(replaced("text", f"{f}.runs", "''"))).otherwise(F.col("text"))).select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("found.items")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.aggregate("found.runs", F.lit(0).cast("long"), lambda a, r: a + r["after"] - r["first"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.size(items) >= ITEMS).alias("contaminated"),
    )


#: A plain statement of the result: every word with its place, windows of eight by equality of word lists.
SQL = r"""
with words as (
  select doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, text, row_number() over () as rid from documents)
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct coalesce(cast(item_id as varchar), 'null') as item, least(len(w), 8) as n, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') as said
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) as i from items where len(w) > 0)
), lengths as (select distinct n from windows),
places as (
  select rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as said
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)
), found as (
  select rid, item, p.n, i from places p join windows v on p.n = v.n and p.said = v.said
), hits as (
  select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + n)) as k from found) group by rid
), named as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from found) group by rid
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words w left join hits h on w.rid = h.rid left join named m on w.rid = m.rid
"""
