"""Mixing overlapping sources to target weights by minimum-cost flow.

Membership. Sources overlap where they hold equal texts. The pattern of a text is the set of sources that hold it; documents are aggregated by pattern and source. Words flow from patterns to the quotas of their
sources: a source can take those of its own rows, each up to ``repeats`` times. Using all distinct words of a pattern k times costs k squared for each (the k-th use costs 2k - 1), whichever source asks, so repetition is convex in all copies
of a text together: where a source has texts of its own, it leans on them and leaves shared ones to those that need them.

Flow. A source that shares no text has one pattern, so its flow is its quota and never meets the solver. The rest, one edge for each pattern and source, is solved on the driver in numpy: all sources fill their patterns to a common marginal cost in the light of
the others' flow, and the joint move is followed as far as it lowers the cost, until it doesn't. As the cost is convex and quotas bind one source each, a flow in which no source can shift words from a dearer pattern to a cheaper one is optimal.
The driver holds a few numbers and a 16-byte key for each source and each edge; documents never reach it.

Documents. The flow of a pattern in a source becomes whole uses of all of its rows and one more use of those that come first in a seeded order. What is left to a source's quota, less than one document each, is made up from its rows with a use to
spare, the largest that fit first, and rounded by the smallest. The seeded order is by buckets of a hash. Bucket sums, not documents, are summed up in order; only the rows of the one bucket in which a remainder ends are ordered, 1 of BUCKETS. So a
source with a third of all rows is spread over all tasks. Rows are told by a narrow table (keys and sizes); where the small tables made from it can be broadcast, no texts are shuffled but those of such edge buckets.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... by default and share 100 % of all words by weight. A target stops at ``repeats`` times the source's size; the excess is shared by the others by weight, until none is above.

Cases. The size of a text is its number of runs of anything but U+0009 to U+000D and the space; a null text has size 0. Rows of size 0 are never taken. Rows that tie in the hash are ordered by doc_id, size and a digest; repeated rows are documents of
their own and may differ by a use at the boundary, the same multiset at each run. A null source is a source of its own. An empty table gives an empty result. A table whose rows lie in several sources each is exploded to one row a source first. Other columns
are kept by sample() and mixed().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm.cluster import checkpoint, fresh, read, row_key, small

REPEATS = 3
SEED = "mix"
BUCKETS = 4096
#: The flow is settled once a round lowers the cost by less than this share.
SETTLED = 1e-9
SIZE = r"[^\x20\x09-\x0D]+"
Weights = Callable[[Sequence[str | None]], Sequence[int]]


def cycling(sources: Sequence[str | None]) -> list[int]:
    """1, 2, 3, repeating."""
    return [k % 3 + 1 for k in range(len(sources))]


def targets(sizes: dict[str | None, int], total: int, weights: Weights = cycling, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = dict(zip(order, weights(order), strict=True))
    rest, left = total, sum(weight.values())
    out = {}
    for s in sorted(order, key=lambda s: repeats * sizes[s] / weight[s]):  # those that reach their limit first
        limit = repeats * sizes[s]
        if limit * left < weight[s] * rest:
            out[s] = float(limit)
            rest -= limit
            left -= weight[s]
    return out | {s: rest * weight[s] / left for s in order if s not in out}


def route(source: np.ndarray, pattern: np.ndarray, room: np.ndarray, width: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Words on each edge (source number, pattern number, most words) of the flow that meets each source's quota at the least sum of y * y / width over patterns, y being the words taken of a pattern."""
    room, quota = room.astype(float), quota.astype(float)
    offered = np.bincount(source, room, len(quota))
    x = room * (quota / np.maximum(offered, 1))[source]
    w = np.maximum(width[pattern], 1).astype(float)
    cost = np.inf
    while True:
        y = np.bincount(pattern, x, len(width))
        now = float((y * y / np.maximum(width, 1)).sum())
        if not now < cost * (1 - SETTLED):
            break
        cost = now
        others = y[pattern] - x
        fill = lambda level: np.clip(level[source] * w - others, 0, room)
        low, high = np.zeros(len(quota)), np.zeros(len(quota))
        np.maximum.at(high, source, (others + room) / w)
        for _ in range(40):
            mid = (low + high) / 2
            over = np.bincount(source, fill(mid), len(quota)) > quota
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        a, b = fill(low), fill(high)
        short, span = quota - np.bincount(source, a, len(quota)), np.bincount(source, b - a, len(quota))
        move = a + (b - a) * np.clip(short / np.where(span > 0, span, 1), 0, 1)[source] - x
        dy = np.bincount(pattern, move, len(width))
        curve = float((dy * dy / np.maximum(width, 1)).sum())
        x = x + move * (min(1.0, max(0.0, -float((y * dy / np.maximum(width, 1)).sum()) / curve)) if curve > 0 else 0)
    return _whole(source, x, room, quota)


def _whole(source: np.ndarray, x: np.ndarray, room: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Whole words with the same sums: the edges with the largest fractions are rounded up."""
    down = np.minimum(np.floor(x + 1e-9), room)
    short = np.rint(quota - np.bincount(source, down, len(quota)))
    order = np.lexsort((down - x, source))
    first = np.searchsorted(source[order], np.arange(len(quota)))
    place = np.empty(len(x))
    place[order] = np.arange(len(x)) - first[source[order]]
    return np.minimum(down + (place < short[source]), room).astype(np.int64)


def _sized(docs: DataFrame, seed: str) -> tuple[DataFrame, str]:
    """docs with a struct of source key, size, digest of the text, tie, draw (the seeded order) and its bucket, and the struct's name."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(SIZE)), F.lit(0)).cast("long")
    name = fresh(docs, "mix")
    with_text = docs.withColumn(name, F.struct(F.coalesce(F.concat(F.lit("v"), source), F.lit("n")).alias("s"), size.alias("size"), F.md5(text).alias("digest")))
    m = F.col(name)
    tied = with_text.withColumn(name, m.withField("tie", row_key(F.col("doc_id"), m["digest"], m["s"])))
    drawn = tied.withColumn(name, m.withField("draw", F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.hex(m["tie"]))), 1, 12), 16, 10).cast("long")))
    return drawn.withColumn(name, m.withField("bucket", F.pmod(m["draw"], F.lit(BUCKETS)).cast("int"))), name


def _group(s: Column, pattern: Column) -> Column:
    """The key of a pattern in a source."""
    return row_key(s, pattern)


@dataclass
class Plan:
    """Kept tables. shared: digest, pattern. dealt: g (a pattern in a source), whole, edge, open. sources: s, source_size, target. decided: doc_id, s, size, tie, uses, special (decided by order, not by dealt alone)."""

    shared: DataFrame
    dealt: DataFrame
    sources: DataFrame
    decided: DataFrame


def _patterns(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that several sources hold (digest, pattern, size), and the distinct words that each source holds alone (s, width)."""
    texts = narrow.filter("digest is not null and size > 0").groupBy("digest").agg(F.max("size").alias("size"), F.collect_set("s").alias("held"))
    texts = texts.withColumn("pattern", F.when(F.size("held") > 1, F.md5(F.to_json(F.array_sort("held")))))
    shared = checkpoint(texts.filter("pattern is not null").select("digest", "pattern", "size"))
    return shared, texts.filter("pattern is null").groupBy(F.col("held")[0].alias("s")).agg(F.sum("size").alias("width"))


def _flows(groups: DataFrame, shared: DataFrame, alone: DataFrame, quota: dict[str, int], repeats: int) -> dict[bytes, int]:
    """Words of each pattern in each source, for the sources that share texts."""
    if shared.isEmpty():
        return {}
    wide = shared.groupBy("pattern").agg(F.sum("size").alias("width"))
    core = groups.filter("pattern is not null").select("s").distinct()
    own = groups.filter("pattern is null").join(core, "s").join(alone, "s", "left").select("g", "s", F.concat(F.lit("="), "s").alias("pattern"), "words", F.coalesce("width", F.lit(0)).alias("width"))
    edges = groups.join(wide, "pattern").select("g", "s", "pattern", "words", "width").union(own).filter("words > 0").toArrow().sort_by("g")
    number = lambda c: pa.chunked_array(edges.column(c)).combine_chunks().dictionary_encode()
    s, p = number("s"), number("pattern")
    source, pattern = s.indices.to_numpy(), p.indices.to_numpy()
    width = np.zeros(len(p.dictionary), np.int64)
    width[pattern] = edges.column("width").to_numpy()
    flow = route(source, pattern, repeats * edges.column("words").to_numpy(), width, np.array([quota[x] for x in s.dictionary.to_pylist()], np.int64))
    return dict(zip(edges.column("g").to_pylist(), flow.tolist(), strict=True))


def plan(docs: DataFrame, weights: Weights = cycling, repeats: int = REPEATS, seed: str = SEED) -> Plan:
    """What each row is used for. docs: doc_id, text, source."""
    spark = docs.sparkSession
    sized, mix = _sized(docs, seed)
    narrow = checkpoint(sized.select("doc_id", f"{mix}.*"))
    shared, alone = _patterns(narrow)
    placed = narrow.join(small(shared.select("digest", "pattern")), "digest", "left").withColumn("g", _group(F.col("s"), F.col("pattern"))).drop("digest")
    sums = checkpoint(placed.groupBy("g", "s", "pattern", "bucket").agg(F.sum("size").alias("words")))
    groups = checkpoint(sums.groupBy("g", "s", "pattern").agg(F.sum("words").alias("words")))
    sizes = {r.s: r.words for r in groups.groupBy("s").agg(F.sum("words").alias("words")).collect()}  # a row a source
    named = {None if s == "n" else s[1:]: n for s, n in sizes.items()}
    wanted = {("n" if s is None else "v" + s): t for s, t in (targets(named, sum(named.values()), weights, repeats) if named else {}).items()}
    quota = {s: int(t + 0.5) for s, t in wanted.items()}
    of = pa.table({"s": pa.array(list(sizes), pa.string()), "source_size": pa.array(list(sizes.values()), pa.int64()), "target": pa.array([wanted[s] for s in sizes], pa.float64()), "quota": pa.array([quota[s] for s in sizes], pa.int64())})
    sources = checkpoint(spark.createDataFrame(of))
    flows = _flows(groups, shared, alone, quota, repeats)
    routed = spark.createDataFrame(pa.table({"g": pa.array(list(flows), pa.binary()), "flow": pa.array(list(flows.values()), pa.int64())}))
    flow = F.coalesce("flow", "quota")  # the only pattern of its source takes the quota
    told = groups.filter("words > 0").join(small(sources), "s").join(small(routed), "g", "left").select("g", F.expr("coalesce(flow, quota) div words").alias("whole"), (flow % F.col("words")).alias("rest"))
    ends = sums.withColumn("upto", F.expr("sum(words) over (partition by g order by bucket)")).join(told, "g").filter("upto > rest")
    ends = ends.groupBy("g").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("open"))).alias("last"), F.first("whole").alias("whole"))
    dealt = checkpoint(ends.select("g", "whole", F.col("last.bucket").alias("edge"), F.col("last.open").alias("open")))
    first = _first(placed, dealt)
    extra = _extra(first, sources, repeats)
    decided = first.join(small(extra.groupBy("tie").agg(F.count("*").alias("more"))), "tie", "left")
    repeated = decided.filter("more is not null").withColumn("n", F.expr("row_number() over (partition by tie order by uses)"))  # equal rows of a made-up use are told apart
    columns = ["doc_id", "s", "size", "tie"]
    rest = decided.filter("more is null").select(*columns, "uses", "special")
    return Plan(shared, dealt, sources.drop("quota"), checkpoint(rest.union(repeated.select(*columns, F.col("uses") + (F.col("n") <= F.col("more")).cast("long"), F.lit(True)))))


def _first(placed: DataFrame, dealt: DataFrame) -> DataFrame:
    """Rows with their uses by the flow: all whole ones, and one more up to the place where the words of a group's remainder end."""
    rows = placed.join(small(dealt), "g", "left")
    edge = F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    clear = rows.filter(~edge).withColumn("first", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    before = F.expr("coalesce(sum(size) over (partition by g order by draw, doc_id, size, tie rows between unbounded preceding and 1 preceding), 0)")
    ordered = rows.filter(edge).withColumn("first", before + F.col("size") <= F.col("open"))
    number = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + F.col("first").cast("int")).otherwise(0).cast("long")
    return checkpoint(clear.withColumn("special", F.lit(False)).union(ordered.withColumn("special", F.lit(True))).select("doc_id", "s", "size", "draw", "tie", number.alias("uses"), "special"))


def _extra(first: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """The rows (tie) that get one use more to make up a source's quota: the largest that fit in what is left, then the smallest if that comes nearer."""
    taken = first.groupBy("s").agg(F.sum(F.col("size") * F.col("uses")).alias("taken"))
    left = sources.join(small(taken), "s").select("s", (F.col("quota") - F.col("taken")).alias("left")).filter("left > 0")
    left = checkpoint(left)
    spare = first.filter(f"size > 0 and uses < {repeats}")
    counts = checkpoint(spare.groupBy("s", "size").agg(F.count("*").alias("n")).join(small(left), "s").filter("size <= 2 * left"))
    step = """aggregate(reverse(array_sort(z)), cast(named_struct('left', left, 'out', array()) as struct<left:bigint,out:array<struct<size:bigint,k:bigint>>>),
      (a, x) -> if(a.left >= x.size, named_struct('left', a.left - least(x.n, a.left div x.size) * x.size, 'out', concat(a.out, array(named_struct('size', x.size, 'k', least(x.n, a.left div x.size))))), a))"""
    fitted = counts.groupBy("s").agg(F.collect_list(F.struct("size", "n")).alias("z"), F.first("left").alias("left")).select("s", F.expr(step).alias("a"))  # sizes up to that of one document
    fitted = checkpoint(fitted.select("s", F.col("a.left").alias("over"), F.col("a.out").alias("out")))
    some = fitted.select("s", F.explode("out").alias("o")).select("s", "o.size", "o.k")
    spared = counts.join(small(some), ["s", "size"], "left").filter("n > coalesce(k, 0)").join(small(fitted.select("s", "over")), "s").filter("size <= 2 * over")
    picks = checkpoint(some.union(spared.groupBy("s").agg(F.min("size").alias("size")).withColumn("k", F.lit(1).cast("long"))).groupBy("s", "size").agg(F.sum("k").alias("k")))
    most = int(picks.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0])
    order = F.expr("row_number() over (partition by s, size order by draw, doc_id, tie)")
    return checkpoint(spare.join(small(picks), ["s", "size"]).withColumn("n", order).filter(F.col("n") <= most).filter("n <= k").select("tie"))  # each task keeps the first ``most`` rows of a size


def uses(docs: DataFrame, made: Plan, seed: str = SEED) -> tuple[DataFrame, str]:
    """docs with a struct of s, size and uses (how often the mix takes the row), and its name."""
    sized, mix = _sized(docs, seed)
    m = F.col(mix)
    names = [fresh(sized, n) for n in ("pattern", "limit", "tied", "listed")]
    shared = small(made.shared.select(F.col("digest").alias(fresh(sized, "digest")), F.col("pattern").alias(names[0])))
    placed = sized.join(shared, m["digest"] == F.col(shared.columns[0]), "left")
    limits = small(made.dealt.select(F.struct("g", "whole", "edge").alias(names[1])))
    placed = placed.join(limits, _group(m["s"], F.col(names[0])) == F.col(names[1])["g"], "left")
    special = made.decided.filter("special").groupBy(F.col("tie").alias(names[2])).agg(F.sort_array(F.collect_list("uses")).alias(names[3]))  # as many as equal rows
    edge = F.col(names[1])["edge"]
    loose = small(special.select(names[2])).withColumn(flag := fresh(sized, "flag"), F.lit(True))
    placed = placed.join(loose, m["tie"] == F.col(names[2]), "left").drop(names[2])
    plain = placed.filter(F.col(flag).isNull())
    number = F.when(m["size"] > 0, F.coalesce(F.col(names[1])["whole"], F.lit(0)) + F.coalesce((m["bucket"] < edge).cast("int"), F.lit(0))).otherwise(0).cast("long")
    done = lambda rows, n: rows.select(*docs.columns, F.struct(m["s"].alias("s"), m["size"].alias("size"), n.alias("uses")).alias(mix))
    single = placed.filter(F.col(flag)).withColumn(n := fresh(placed, "n"), F.expr(f"row_number() over (partition by {mix}.tie order by {mix}.tie)")).join(special, m["tie"] == F.col(names[2]))
    return done(plain, number).union(done(single, F.element_at(F.col(names[3]), F.col(n)))), mix


def sample(docs: DataFrame, weights: Weights = cycling, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it is used."""
    rows, mix = uses(docs, plan(docs, weights, repeats, seed), seed)
    return rows.filter(F.col(mix)["uses"] > 0).withColumn(mix, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mix)["uses"]))).select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """Every row of docs with size, source_size, target and taken; columns of these names are replaced."""
    docs = docs.drop("size", "source_size", "target", "taken")
    made = plan(docs)
    rows, mix = uses(docs, made)
    of = small(made.sources.select(F.struct(*made.sources.columns).alias(about := fresh(rows, "about"))))
    joined = rows.join(of, F.col(mix)["s"] == F.col(about)["s"])
    return joined.select(*docs.columns, F.col(mix)["size"].alias("size"), F.col(about)["source_size"].alias("source_size"), F.col(about)["target"].alias("target"), (F.col(mix)["size"] * F.col(mix)["uses"]).alias("taken"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return made.decided.join(small(made.sources), "s").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("uses")).alias("taken"))
