"""Near-duplicate documents by BagMinHash signatures over multisets of five-word shingles.

A document is the multiset of its runs of five words; two documents are near duplicates if the weighted Jaccard similarity of these
multisets, sum of minima over sum of maxima, is 0.8 or more. Classes are the connected components of that relation.

Method. Every shingle of weight w owns independent unit-rate Poisson processes on [0, 1), [1, 2), ... up to w. They are drawn
hierarchically, as one process a dyadic block of weights whose points are then split down to unit levels; points at levels not below
w are dropped. Each point carries a register; a register keeps the earliest point it has seen. Two documents agree in a register
with probability equal to their weighted Jaccard similarity. Points are drawn in order of time only up to the time by which all registers
of the document are expected to be filled, so a long document costs about one hash a shingle.

Signatures of 125 registers are cut into 25 bands of 5 (a pair at exactly 0.8 shares no band with probability 5e-5). Within a bucket:

1. every member is compared with one hub, the member that shares most buckets with others (a star, not all pairs). The hub's signature and text are dealt out once for each HUB_ROWS of its members, so no task meets all members of a large group;
2. the classes so far are the components of these links. In buckets that hold more than one, those outside the bucket's largest class are compared with each other and with the largest class, in square blocks of at most about 1,024
   members a side, first by signature and then, only for those with a promising partner, by exact multiset overlap, and only a spanning forest of
   what was found is emitted. Members of the largest class aren't compared with each other, so a bucket costs the product of its size and of what the star left. Nothing is capped; a bucket of any size is dealt out over as many blocks as it needs.

Signatures that agree in fewer than 80 of 125 registers aren't verified (probability below 1e-5 for a pair at 0.8).

Cases. A null text has no copies: its class is its own row. Texts that are equal, empty ones included, are one class. A text of one to
four words is one shingle of all its words; a text without words equals only identical texts. Very long texts are hashed in pieces of
bounded memory. An empty table gives an empty result. Repeated rows are copies like others. Rows whose doc_id is null take the smallest non-null doc_id of their class. Other
columns of the input are neither read nor needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm.cluster import checkpoint, components, fresh, read, small
from plumbago.llm.text import blocks, grams, map_arrow, mix, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 5
REGISTERS = BANDS * BAND_ROWS
#: Fewest equal registers of a pair that is verified.
PROMISING = 80
BLOCK_MEMBERS = 1024
#: Shared buckets of a hub, of which it has at least as many as members, a copy of its signature and text.
HUB_ROWS = 20_000
_OWNER_BITS = 12
_GOLD = 0x9E3779B97F4A7C15


def shingles(data: bytes, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, with repetitions, and the text each belongs to."""
    words = words_of(data, offsets)
    h, counts, owner = words.hashes(), words.counts, words.owner
    parts, owners = [], []
    for n in range(1, size + 1):
        if n < size and not (counts == n).any():
            continue
        g, at = grams(h, words.first, n)
        own = owner[at] if len(at) else np.empty(0, np.int64)
        if n < size:
            only = counts[own] == n
            g, own = g[only], own[only]
        parts.append(g)
        owners.append(own)
    return np.concatenate(parts), np.concatenate(owners)


def bag_minhash(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (texts x registers, float64 times; inf for texts without shingles) of weighted sets given as distinct hashes with integer weights."""
    out = np.full(texts * registers, np.inf)
    total = np.bincount(owner, counts, minlength=texts)
    horizon = registers * (math.log(registers) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        h, w, own = hashes[at], counts[at], owner[at]
        out.reshape(texts, registers)[todo] = np.inf
        state, rate, low, limit, whose = [mix(h)], [np.ones(len(h))], [np.zeros(len(h), np.int64)], [w], [own]
        k = 1
        while (more := w > (1 << (k - 1))).any():  # the dyadic block [2**(k-1), 2**k)
            h, w, own = h[more], w[more], own[more]
            state.append(mix(h + np.uint64(k * _GOLD & (1 << 64) - 1)))
            rate.append(np.full(len(h), float(1 << (k - 1))))
            low.append(np.full(len(h), 1 << (k - 1), np.int64))
            limit.append(w)
            whose.append(own)
            k += 1
        s, rate, low, w, own = (np.concatenate(x) for x in (state, rate, low, limit, whose))
        t = np.zeros(len(s))
        while len(s):
            s = mix(s + np.uint64(_GOLD))
            t = t - np.log(((s >> np.uint64(11)) + np.float64(0.5)) * 2.0**-53) / rate
            go = np.flatnonzero(t < horizon[own])
            s, t, rate, low, w, own = s[go], t[go], rate[go], low[go], w[go], own[go]
            split = mix(s ^ np.uint64(0x5851F42D4C957F2D))
            level = low + (split & np.uint64(0xFFFFFFFF)).astype(np.int64) % np.maximum(low, 1)
            hit = np.flatnonzero(level < w)
            register = (split >> np.uint64(32)).astype(np.int64)[hit] % registers
            np.minimum.at(out, own[hit] * registers + register, t[hit])
        todo &= np.isinf(out.reshape(texts, registers)).any(1)
        horizon = np.where(todo, horizon * 2.5, horizon)
    return out.reshape(texts, registers)


def signatures(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen bits a register (texts x REGISTERS) and the number of shingles of each text."""
    texts = len(offsets) - 1
    h, owner = shingles(data, offsets)
    key = (owner.astype(np.uint64) << np.uint64(64 - _OWNER_BITS)) | (h >> np.uint64(_OWNER_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    times = bag_minhash(key << np.uint64(_OWNER_BITS), counts, (key >> np.uint64(64 - _OWNER_BITS)).astype(np.int64), texts)
    return (mix(times.view(np.uint64)) >> np.uint64(48)).astype("<u2"), np.bincount(owner, minlength=texts)


def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes in order, their counts, and their total."""
    data = text.encode("utf-8", "surrogatepass")
    h, _ = shingles(data, np.array([0, len(data)]))
    values, counts = np.unique(h, return_counts=True)
    return values, counts, len(h)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not a[2]:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    inter = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return inter / (a[2] + b[2] - inter)


class _Bags:
    """The last bags made, kept up to a number of shingles, not of texts."""

    def __init__(self, most: int = 2_000_000):
        self.kept, self.room, self.most = {}, most, most

    def __call__(self, node: bytes, text: str) -> tuple:
        if (x := self.kept.get(node)) is None:
            x = bag(text)
            if len(x[0]) > self.room:
                self.kept.clear()
                self.room = self.most
            self.room -= len(x[0])
            self.kept[node] = x
        return x


def _sketch(batch: pa.RecordBatch) -> Iterator[dict]:
    ids, texts = batch.column(0), batch.column(1)
    for i, j, data, off in blocks(texts, rows=1 << _OWNER_BITS):
        sig, n = signatures(data, off)
        valid = texts.slice(i, j - i).is_valid().to_pylist()
        node = [hashlib.md5(data[a:b]).digest() if v else None for a, b, v in zip(off[:-1], off[1:], valid, strict=True)]
        rows = [s.tobytes() if k else None for s, k in zip(sig, n, strict=True)]
        yield {"doc_id": ids.slice(i, j - i), "node": pa.array(node, pa.binary()), "sig": pa.array(rows, pa.binary()), "n": n}


def _near(batch: pa.RecordBatch) -> Iterator[dict]:
    """Pairs whose signatures are promising."""
    c = {k: batch.column(k) for k in batch.schema.names}
    x, y = (np.frombuffer(b"".join(c[k].to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("sig_a", "sig_b"))
    n, m = (c[k].to_numpy(zero_copy_only=False) for k in ("n_a", "n_b"))
    ok = ((x == y).sum(1) >= PROMISING) & (np.minimum(n, m) >= THRESHOLD * np.maximum(n, m))
    if ok.any():
        yield {k: c[k].filter(pa.array(ok)) for k in ("a", "b", "part")}


def _verified(batch: pa.RecordBatch) -> Iterator[dict]:
    bags, links = _Bags(), []
    for a, b, s, t in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b")), strict=True):
        if similarity(bags(a, s), bags(b, t)) >= THRESHOLD:
            links.append((a, b))
    if links:
        yield {"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())}


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Regroup rows that arrive sorted by cell into one column dictionary a cell."""
    held: list[pa.RecordBatch] = []

    def whole() -> dict:
        t = pa.Table.from_batches(held)
        return {k: t.column(k).to_pylist() for k in t.schema.names}

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "x", "y")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            piece = batch.slice(i, j - i)
            if held and any(held[-1].column(k)[0].as_py() != piece.column(k)[0].as_py() for k in ("bucket", "x", "y")):
                yield whole()
                held = []
            held.append(piece)
    if held:
        yield whole()


def _pairs(cell: dict) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later ones of the cell that may be near duplicates of another class and share no earlier bucket."""
    sig = np.frombuffer(b"".join(cell["sig"]), "<u2").reshape(-1, BANDS, BAND_ROWS)
    n, root, side, band = np.array(cell["n"]), np.unique(np.array(cell["root"], object), return_inverse=True)[1], np.array(cell["side"]), cell["band"][0]
    across = cell["x"][0] != cell["y"][0]
    for i in range(len(n) - 1):
        ok = (root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) >= THRESHOLD * np.maximum(n[i + 1 :], n[i]))
        if across:
            ok &= side[i + 1 :] != side[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            same = sig[at] == sig[i]
            good = same.sum((1, 2)) >= PROMISING
            if band:
                good &= ~same[:, :band].all(2).any(1)
            if good.any():
                yield i, at[good]


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a promising partner there."""
    for cell in _cells(batches):
        flag = np.zeros(len(cell["n"]), bool)
        for i, at in _pairs(cell):
            flag[i] = True
            flag[at] = True
        if flag.any():
            keep = np.flatnonzero(flag).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([cell[f.name][i] for i in keep], f.type) for f in _CELL_ARROW], schema=_CELL_ARROW)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the near-duplicate links between the classes of each cell."""
    for cell in _cells(batches):
        bags, up, links = _Bags(), {}, []

        def top(x: bytes, up: dict = up) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for i, at in _pairs(cell):
            for j in at.tolist():
                if (p := top(cell["root"][i])) != (q := top(cell["root"][j])):
                    if similarity(bags(cell["node"][i], cell["text"][i]), bags(cell["node"][j], cell["text"][j])) >= THRESHOLD:
                        up[p] = q
                        links.append((cell["root"][i], cell["root"][j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


_CELL = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("band", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType())])
_CELL_ARROW = pa.schema([("bucket", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("band", pa.int32()), ("node", pa.binary()), ("root", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())])
_LINK = "a binary, b binary"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows of the class), kept (doc_id is the class_id): a row for each row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_node = _classes(base)
    keyed = base.select("doc_id", F.unhex(F.md5("text")).alias("node"))
    out = keyed.join(small(of_node), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("class_size").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each class: that of the smallest doc_id, once if it is repeated. All columns stay. Only rows without copies skip the last shuffle."""
    node, extra = fresh(docs, "node"), [fresh(docs, "class_id"), fresh(docs, "class_size")]
    of_node = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    of_node = small(of_node.toDF(node, *extra))
    keyed = docs.withColumn(node, F.unhex(F.md5(F.col("text").cast("string"))))
    alone = keyed.join(of_node, node, "left_anti")
    first = keyed.join(of_node, node).filter(F.col("doc_id").eqNullSafe(F.col(extra[0]))).dropDuplicates(["doc_id", node])
    return alone.select(*docs.columns).union(first.select(*docs.columns))


def _classes(base: DataFrame) -> DataFrame:
    """node, class_id, class_size of the texts whose class has more than one row."""
    sketch = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("n", T.LongType())])
    nodes = map_arrow(base, _sketch, sketch).filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = checkpoint(nodes)
    named = nodes.select("node", "id", "rows").join(_roots(base, nodes), "node")
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size"))
    return checkpoint(named.join(classes, "root").filter("class_size > 1").select("node", "class_id", "class_size"))


def _roots(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the class of every text, as one of its nodes."""
    width = 2 * BAND_ROWS
    bands = nodes.filter("sig is not null").select("node", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")).alias("band", "bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = checkpoint(bands.join(sizes, "bucket"))
    sigs = nodes.select("node", "n", "sig")
    first = checkpoint(_starred(base, nodes, members, sigs))
    below = checkpoint(nodes.select("node").join(components(first), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    cells = _dealt(members.join(below, "node"), sigs)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "x", "y"]
    together = lambda df: df.repartition(parts, *order).sortWithinPartitions(*order)
    some = checkpoint(together(cells).mapInArrow(_promising, _CELL))
    rest = _texts(base, nodes, some.select("node").distinct())
    second = checkpoint(together(some.join(rest, "node").select(*_CELL.names, "text")).mapInArrow(_forest, _LINK).distinct())
    above = components(second).withColumnRenamed("root", "top")  # of classes, not of texts
    return below.join(small(above.withColumnRenamed("node", "root")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _starred(base: DataFrame, nodes: DataFrame, members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Verified links between the hub of each bucket and its members."""
    degree = members.groupBy("node").agg(F.sum(F.col("members") - 1).alias("degree"))
    hubs = members.select("bucket", "node").join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub"))
    copies = (F.expr(f"hub.degree div {HUB_ROWS}") + 1).cast("int")
    hubs = checkpoint(hubs.select("bucket", F.col("hub.node").alias("a"), copies.alias("copies")))
    stars = members.select("bucket", F.col("node").alias("b")).join(hubs, "bucket").filter("a != b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("part")).distinct()
    side = lambda k: sigs.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    centres = hubs.select("a", "copies").distinct().join(side("a"), "a").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part")).drop("copies")
    near = stars.join(side("b"), "b").join(centres, ["a", "part"]).select("a", "b", "part", "n_a", "n_b", "sig_a", "sig_b")
    near = checkpoint(map_arrow(near, _near, T._parse_datatype_string(f"{_LINK}, part int")))
    texts = _texts(base, nodes, near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    said = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    centres = near.select("a", "part").distinct().join(said("a"), "a")
    return map_arrow(near.join(said("b"), "b").join(centres, ["a", "part"]).select("a", "b", "text_a", "text_b"), _verified, T._parse_datatype_string(_LINK))


def _dealt(rooted: DataFrame, sigs: DataFrame) -> DataFrame:
    """Cells of the buckets with several classes: x is a part of the members outside the largest class, y another of these or, numbered after them, a part of the largest class."""
    largest = rooted.groupBy("bucket", "members", "root").agg(F.count("*").alias("n")).groupBy("bucket", "members").agg(F.max(F.struct("n", "root")).alias("m"))
    parts = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    several = largest.filter("m.n < members").select("bucket", F.col("m.root").alias("major"), parts(F.col("members") - F.col("m.n")).alias("few"), parts(F.col("m.n")).alias("many"))
    rows = rooted.join(several, "bucket").withColumn("minor", F.col("root") != F.col("major"))
    side = F.when(F.col("minor"), F.pmod(F.hash("node"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.hash("node"), F.col("many"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    placed = rows.withColumn("side", side).select("bucket", "band", "node", "root", "side", F.explode(others).alias("other"))
    return placed.select("bucket", "band", "node", "root", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")).join(sigs, "node").select(*_CELL.names)


def _texts(base: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes: one row each but for rows that are repeated as they are."""
    wanted = checkpoint(wanted.join(nodes.select("node", "id"), "node"))
    keyed = base.withColumn("node", F.unhex(F.md5("text")))
    return checkpoint(keyed.join(small(wanted).withColumnRenamed("node", "key"), (F.col("node") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text").dropDuplicates(["node"]))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: The relation itself: all shingles of all texts, their multiset overlaps, and what is linked by them.
SQL = r"""
with recursive t as (
  select row_number() over () as node, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select distinct text from documents where text is not null)
), s as (
  select node, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') as said, count(*) as c
  from (select node, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from t where len(w) > 0) group by 1, 2
), z as (select node, sum(c) as total from s group by node),
p as (select a.node as a, b.node as b, sum(least(a.c, b.c)) as i from s a join s b on a.said = b.said and a.node < b.node group by 1, 2),
e as (select a, b from p join z x on x.node = a join z y on y.node = b where 5 * i >= 4 * (x.total + y.total - i)),
g as (select a, b from e union all select b, a from e),
r(node, other) as (select node, node from t union select r.node, g.b from r join g on g.a = r.other),
c as (select node, min(other) as root from r group by node),
d as (select doc_id, root from documents join t using (text) join c using (node)),
k as (select root, min(doc_id) as class_id, count(*) as class_size from d group by root)
select doc_id, class_id, class_size, doc_id is not distinct from class_id as kept from d join k using (root)
union all select doc_id, doc_id, 1, true from documents where text is null
"""
