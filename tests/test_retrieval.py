from __future__ import annotations

import json
import math
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from plumbago.functions import vectors
from plumbago.operators import cache, context, fusion, ingest, lexical, vector
from plumbago.plans import queries
from plumbago.plans.answer import REQUEST, Engine, health, valid
from plumbago.plans.providers import SYSTEM, BatchedEmbedder, HttpAnswerer, HttpEmbedder, HttpSearch, PageSearch
from plumbago.plans.routes import Api
from plumbago.plans.settings import Settings
from plumbago.sources import files
from plumbago.sources.store import VectorStore, documents
from plumbago.sources.versions import Versions

HIT = "query_id long, chunk_id string, score double, rank int"


def raw(spark, docs, question):
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, content string")
    index = lexical.build(chunks, with_han=False)
    got = lexical.scores(spark.createDataFrame([(0, question)], "query_id long, question string"), index, with_han=False)
    return {r.chunk_id: round(r.raw, 6) for r in got.collect()}


def test_bm25(spark):
    docs = ["aa bb aa", "aa cc", "dd", "ee ff", ""]
    assert raw(spark, docs, "aa") == {0: 0.375161, 1: 0.302447}
    assert raw(spark, docs, "cc") == {1: 0.987517}
    assert raw(spark, docs, "cc cc") == {1: 1.975033}
    assert raw(spark, ["aa bb", "aa", "aa cc dd", "ee"], "aa") == {0: 0.119418, 1: 0.157462, 2: 0.09618}
    assert raw(spark, docs, "") == {}


def test_scan_gives_the_scores_of_an_index(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["aa bb aa", "aa", "aa cc dd", "ee", "", None])], "chunk_id int, content string")
    q = spark.createDataFrame([(0, "aa cc"), (1, "ee zz"), (2, "")], "query_id long, question string")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.raw, 9)) for r in df.collect())
    assert rows(lexical.scan(q, docs, with_han=False)) == rows(lexical.scores(q, lexical.build(docs, with_han=False), with_han=False)) != []
    assert rows(lexical.scan(q, docs.limit(0), with_han=False)) == []


def test_index_after_changes_is_the_index_of_what_is_left(spark, tmp_path):
    path = str(tmp_path / "i")
    schema = "chunk_id string, content string"
    a, b, c = (spark.createDataFrame(x, schema) for x in ([("a", "aa bb"), ("b", "bb cc cc"), ("c", "")], [("b", "bb cc cc")], [("d", "dd aa"), ("e", "aa")]))
    assert not lexical.LexicalIndex.exists(spark, path)
    lexical.build(a).save(spark, path)
    lexical.LexicalIndex.load(spark, path).changed(b, c).save(spark, path)
    got, want = lexical.LexicalIndex.load(spark, path), lexical.build(a.filter("chunk_id != 'b'").union(c))
    for t in ("postings", "terms", "stats"):
        rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert rows(getattr(got, t)) == rows(getattr(want, t).select(*getattr(got, t).columns)), t
    assert lexical.LexicalIndex.exists(spark, path)
    lexical.release()


def test_versions_are_seen_when_whole(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.current() is None
    for k in range(4):
        spark.range(k).write.parquet(v.next())
        v.prune()
    half = tmp_path / "t" / "v5"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"x")
    assert v.current().endswith("/v4") and v.numbers() == [3, 4] and spark.read.parquet(v.current()).count() == 3
    assert v.next().endswith("/v5") and not half.exists()


def test_bm25_ties_and_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([(c, "aa xx") for c in "dbca"] + [("z", "bb"), ("y", "cc"), ("x", "dd"), ("w", "ee"), ("v", "ff")], "chunk_id string, content string")
    lexical.build(chunks).save(spark, str(tmp_path / "i"))
    got = lexical.retrieve(spark.createDataFrame([("q", "aa")], "query_id string, question string"), lexical.LexicalIndex.load(spark, str(tmp_path / "i")), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and all(0 < r.score <= 1 for r in got)


def test_vector_scores(spark):
    s = lambda cos, mode: round(spark.range(1).select(vectors.score(F.lit(cos), mode)).first()[0], 6)
    assert [s(c, "reference") for c in (0.9, 1.0, -0.5)] == [0.1, 0.0, 1.0]
    assert [s(c, "cosine") for c in (0.9, 1.0, -0.5)] == [0.9, 1.0, 0.0]
    with pytest.raises(ValueError):
        vectors.score(F.lit(1.0), "other")


def test_cells_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = t.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact = pairs(vector.search(q, t, 10))
    assert len(exact) == 100
    assert len(exact & pairs(vector.CellIndex.fit(t, cells=32).search(q, 10))) / len(exact) >= 0.9


def test_saved_cells(spark, tmp_path):
    t = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(40)], "chunk_id int, embedding array<float>")
    q = t.filter("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    vector.CellIndex.fit(t, cells=5).write(str(tmp_path / "cells"))
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())
    assert rows(vector.CellIndex.load(spark, str(tmp_path / "cells")).search(q, 3, probes=1)) == rows(vector.search(q, t, 3))


def test_vectors_that_are_not_there(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.chunk_id, r.cosine) for r in vector.search(q, t, 5).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 3, 0.0)]
    assert vector.search(q.limit(0), t, 5).count() == vector.search(q, t.limit(0), 5).count() == 0


def test_registered_cells_find_all(spark):
    d = "/root/testdata/sf0.1"
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())
    assert rows(queries.ann_topk(spark, d)) == rows(queries.vector_topk_batch(spark, d))


def test_cells_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(vector, "HELD", 3)
    t = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(60)] + [(60, [0.0, 0.0]), (61, [1e-15, 0.0])], "chunk_id int, embedding array<double>")
    q = t.filter("chunk_id in (0, 7, 33, 60)").withColumnRenamed("chunk_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())
    index = vector.CellIndex.fit(t, cells=12)
    assert rows(index.search(q, 5, probes=1)) == rows(vector.search(q, t, 5)) and rows(index.search(q, 70, probes=1)) == rows(vector.search(q, t, 70))


def test_queries_in_blocks(spark, monkeypatch):
    t = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "chunk_id int, embedding array<float>")
    q = t.withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, vector.search(q, t, 2).collect()))
    monkeypatch.setattr(vector, "QUERIES_A_SCAN", 4)
    assert sorted(map(tuple, vector.search(q, t, 2).collect())) == whole


def fused(spark, v, b):
    return {r.chunk_id: round(r.score, 6) for r in fusion.fuse(spark.createDataFrame(v, HIT), spark.createDataFrame(b, HIT)).collect()}


def test_fusion(spark):
    v = [(0, "both", 0.5, 1), (0, "full", 1.0, 2), (0, "v", 0.8, 3), (0, "zero", 0.0, 4), (0, "both", 0.1, 5)]
    b = [(0, "both", 0.5, 1), (0, "full", 1.0, 2), (0, "b", 1.0, 3), (0, "zero", 0.5, 4)]
    assert fused(spark, v, b) == {"both": 0.6, "full": 1.0, "v": 0.48, "b": 0.4, "zero": 0.2}


def test_web_gate(spark):
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    f = spark.createDataFrame([(1, 0.49), (2, 0.5)], "query_id long, score double")
    assert {r.query_id: r.use_web for r in fusion.needs_web(q, f).collect()} == {0: True, 1: True, 2: False}


def test_rerank_and_merge(spark):
    local = spark.createDataFrame([(0, "a", "d", "n", "c", 1, None, 0.6, 1)], "query_id long, chunk_id string, doc_id string, doc_name string, content string, page int, section string, score double, rank int")
    web = spark.createDataFrame([(0, "t", "c", "u1", 0.9, 1), (0, "t", "c", "u2", 0.0, 2), (0, "t", "c", "u3", None, 3)], "query_id long, title string, content string, url string, score double, rank int")
    got = fusion.rerank(local, web).orderBy("rank").collect()
    assert [(r.url, round(r.score, 6)) for r in got] == [(None, 0.42), ("u1", 0.27), ("u2", 0.15), ("u3", 0.15)]
    lists = [spark.createDataFrame(x, HIT) for x in ([(0, "a", 0.2, 1)], [(0, "a", 0.9, 1), (0, "b", 0.5, 2)])]
    assert [(r.chunk_id, r.score) for r in fusion.merge(lists).orderBy("rank").collect()] == [("b", 0.5), ("a", 0.2)]


def test_context_stops_at_the_first_block_that_overflows(spark):
    rows = [(0, k + 1, "local", "n", 0, "", None, "x" * n) for k, n in enumerate((3000, 2900, 200, 50))]
    r = spark.createDataFrame(rows, "query_id long, rank int, source_type string, doc_name string, page int, section string, url string, content string")
    head = len("【参考资料1】\n来源: n\n内容:\n\n")
    cut = r.withColumn("content", F.expr(f"substring(content, 1, length(content) - {head})"))
    assert [x["rank"] for x in context.packed(cut).orderBy("rank").collect()] == [1, 2]
    assert context.context(cut, 10).first().context == context.HEADER


def test_records(spark):
    t = spark.createDataFrame([(0, None, None, None), (1, " a ", None, "u"), (2, "nan", "b", "u")], "i int, ` x ` string, y string, `Unnamed: 3` string")
    got = [(r.row_index, r.content, r.raw_data) for r in ingest.to_records(t, "i").orderBy("row_index").collect()]
    assert got == [(1, "x: a", {"x": " a ", "y": ""}), (2, "y: b", {"x": "nan", "y": "b"})]
    assert ingest.header_rows(t, "i") == 1
    assert ingest.record_chunks(ingest.to_records(t, "i"), "d", "n").count() == 2


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "v")).initialize()
    rows = [(f"c{k}", [1.0], "x" * 70000, f"d{k % 2}", None, None, None, None) for k in range(4)] + [("no", None, "x", "d0", None, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, content string, doc_id string, doc_name string, page int, section string, source_type string")
    s.add(chunks)
    assert tuple(s.stats().first()) == (4, 2) and len(s.get("c1").first().content) == 65535 and s.get("c1").first().page == 0
    s.add(chunks)
    assert s.stats().first().total_chunks == 8
    s.add(chunks, "replace")
    assert s.stats().first().total_chunks == 4
    s.delete_document("d0")
    assert [r.doc_id for r in documents(s.table()).collect()] == ["d1"]
    s.reset()
    assert s.stats().first().total_chunks == 0


def test_cache(spark):
    now = lambda x: F.lit(x).cast("timestamp")
    empty = spark.createDataFrame([], cache.SCHEMA)
    a = spark.createDataFrame([("q", True, "1")], "question string, use_web_search boolean, data string")
    c = cache.put(empty, a, now("2024-01-01 00:00:00"))
    look = lambda at, c=c: cache.get(c, a.drop("data"), now(at)).first().data
    assert look("2024-01-01 01:00:00") == "1" and look("2024-01-01 01:00:01") is None
    b = spark.createDataFrame([("r", True, "2")], a.schema)
    d = cache.put(c, b, now("2024-01-01 00:00:05"), entries=1)
    assert [r.question for r in d.collect()] == ["r"] and cache.stats(d).first().entries == 1
    assert cache.clear(d).count() == 0 and cache.invalidate(d, b).count() == 0 and cache.evicted(c).first().key == c.first().key


def test_cache_replay(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {r.key: (r.requests, r.hits) for r in cache.replay(e, F.col("event_type")).collect()}
    want: dict = {}
    made: dict = {}
    for r in e.orderBy("ts").select("event_type", F.col("ts").cast("timestamp").cast("double").alias("t")).collect():
        n, h = want.get(r.event_type, (0, 0))
        hit = r.t - made.get(r.event_type, -math.inf) <= 3600
        if not hit:
            made[r.event_type] = r.t
        want[r.event_type] = (n + 1, h + hit)
    assert got == want


def test_cache_saved_and_loaded(spark, tmp_path):
    now = lambda x: F.lit(x).cast("timestamp")
    a = spark.createDataFrame([("q", True, "1")], "question string, use_web_search boolean, data string")
    c = cache.put(spark.createDataFrame([], cache.SCHEMA), a, now("2024-01-01 00:00:00"))
    cache.save(c, str(tmp_path / "c"))
    assert [r.question for r in cache.load(spark, str(tmp_path / "c"), now("2024-01-01 00:59:59")).collect()] == ["q"] and cache.load(spark, str(tmp_path / "c"), now("2024-01-01 01:00:00")).count() == 0


def test_replay_of_awkward_rows(spark):
    rows = [("a", 0), ("a", 0), ("a", 3600), ("a", 3601), ("a", None), (None, 5), (None, 6), ("b", None)] + [("hot", 7 * k) for k in range(20_000)]
    e = spark.createDataFrame(rows, "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    got = {r.key: (r.requests, r.hits) for r in cache.replay(e, F.col("k")).collect()}
    assert got == {"a": (4, 2), None: (2, 1), "hot": (20_000, 20_000 - 39)}
    assert cache.replay(e.limit(0), F.col("k")).count() == 0


def test_streamed_cache_equals_replay(spark, tmp_path):
    from plumbago.streaming.cache import hits

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "e"))
    stream = hits(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.key: r.n for r in spark.table("replayed").groupBy("key").agg(F.sum(F.col("hit").cast("int")).alias("n")).collect()}
    assert got == {r.key: r.hits for r in cache.replay(e, F.col("key")).collect()}


def test_health_and_validation(spark):
    ok = lambda *v: health(spark.createDataFrame([({str(k): x for k, x in enumerate(v)},)], "components map<string,string>")).first().status
    assert ok("ok", "ok") == "healthy" and ok("ok", "error") == "degraded"
    assert valid(spark.createDataFrame([("",), ("a" * 1000,), ("a" * 1001,)], "question string")).count() == 1


def test_embedder_keeps_rows_apart(spark):
    def model(texts):
        if "bad" in texts:
            raise OSError
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a",), (" ",), ("bad",), ("abc",)], "t string").coalesce(1)
    got = {r.t: r.embedding for r in BatchedEmbedder(model, 1).embed(rows, "t").collect()}
    assert got == {"a": [1.0], " ": None, "bad": None, "abc": [3.0]}


def test_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "标准.md").write_text("# 标题\n粉煤灰 检测项目 JTG 细度 烧失量。" * 60, "utf-8")
    (folder / "other.md").write_text("钢绞线 取样方法 GB 每批 一次。" * 60, "utf-8")
    (folder / "bad.md").write_bytes(b"\xff\xfe\x00")
    (folder / "no.txt").write_text("x")
    pages = spark.createDataFrame([(1, "http://a.example/x", "<html><head><title>T</title></head><body><p>sunspot cycle</p></body></html>"), (2, "http://b.example/y", "<p>plain</p>"), (3, "http://c.example", "<p>other words</p>")], "page_id long, url string, html string")
    e = Engine(spark, Settings(index_path=str(tmp_path / "i"), vector_path=str(tmp_path / "v")), web=PageSearch(pages))
    told = e.ingest(str(folder)).first()
    assert told.total_docs == 3 and len(told.failed_docs) == 1 and told.total_chunks >= 2
    q = spark.createDataFrame([("1", "粉煤灰检测项目有哪些", True, 5), ("2", "sunspot cycle", True, 5), ("3", "sunspot cycle", False, 5), ("4", "", True, 5)], REQUEST)
    first = e.answer(q).persist()
    got = {r.query_id: r for r in first.collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].sources[0].doc_name == "标准" and "粉煤灰" in got["1"].answer
    assert got["2"].used_web and any(s.source_type == "web" for s in got["2"].sources) and not got["3"].used_web
    kept = e.remember(spark.createDataFrame([], cache.SCHEMA), first, q)
    found = cache.get(kept, q, F.current_timestamp())
    assert {r.query_id for r in found.filter("data is not null").collect()} == {"1", "2", "3"}
    assert list(e.stream(""))[-1].startswith("event: error")
    one = e.store.table().first().chunk_id
    assert e.source(one).count() == 1 and e.source(one, neighbours=True).count() == 1
    assert e.health().first().status == "healthy"


def xlsx(rows):
    """A workbook of shared and inline strings, numbers and gaps, by hand."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared: list = []

    def cell(k, r, v):
        ref = f"{chr(65 + k)}{r}"
        if isinstance(v, int):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if len(v) % 2:
            return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(k, r, v) for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1) if any(v is not None for v in row))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{v}</t></r></si>" for v in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    book = xlsx([["项目", None, "数量 ", "项目"], ["钢绞线", "x", 3, "b"], [None, None, None, None], ["nan", "y", None, None], [" 锚具", None, 12, None]])
    (tmp_path / "a b.xlsx").write_bytes(book)
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    (tmp_path / "old.xls").write_bytes(b"no")
    rows = {r.doc_name: r for r in files.workbook_records(spark, str(tmp_path)).collect()}
    assert {n: r.status for n, r in rows.items()} == {"a b": "ok", "bad": "failed", "old": "failed"}
    assert [(x.row_index, x.content, x.raw_data) for x in rows["a b"].records] == [(0, "项目: 钢绞线; 数量: 3; 项目.1: b", {"项目": "钢绞线", "数量": "3", "项目.1": "b"}), (3, "项目: 锚具; 数量: 12", {"项目": " 锚具", "数量": "12", "项目.1": ""})]
    got = ingest.workbook_chunks(files.workbook_records(spark, str(tmp_path))).collect()
    assert [r.metadata["row_index"] for r in got] == ["0", "3"] and [r.metadata["index"] for r in got] == ["0", "1"] and len({r.chunk_id for r in got}) == 2
    same = ingest.record_chunks(files.parse_table(spark, str(tmp_path / "a b.xlsx")), got[0].doc_id, "a b").collect()
    assert sorted((r.chunk_id, r.content) for r in same) == sorted((r.chunk_id, r.content) for r in got)


def test_records_are_numbered_over_all_parts(spark):
    r = spark.range(0, 5000, 1, 7).select(F.col("id").cast("int").alias("row_index"), F.when(F.col("id") % 3 == 0, "").otherwise("x").alias("content"), F.create_map(F.lit("a"), F.lit("b")).alias("raw_data"))
    got = ingest.record_chunks(r, "d", "n").collect()
    assert sorted(int(x.metadata["index"]) for x in got) == [k for k in range(5000) if k % 3] and all(x.metadata["index"] == x.metadata["row_index"] for x in got)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """An engine over markdown and a workbook."""
    d = tmp_path_factory.mktemp("corpus")
    (d / "in").mkdir()
    (d / "in" / "long.md").write_text("".join(f"第{k}句讲锚具检测频率与路基。" for k in range(300)), "utf-8")
    (d / "in" / "short.md").write_text("钢绞线 取样方法 GB 每批 一次。" * 30, "utf-8")
    (d / "in" / "t.xlsx").write_bytes(xlsx([["name", "value"], ["quartz", 7], ["basalt", 9]]))
    (d / "in" / "bad.xlsx").write_bytes(b"no")
    e = Engine(spark, Settings(index_path=str(d / "i"), vector_path=str(d / "v"), chunk_size=300, chunk_overlap=60, min_chunk_size=20, cache_seconds=7))
    return e, e.ingest(str(d / "in")).first(), str(d / "in")


def test_ingest_of_a_folder(spark, corpus):
    e, told, folder = corpus
    n = e.store.table().count()
    assert told.total_docs == 4 and told.total_chunks == n > 6 and [x.rpartition("/")[2] for x in told.failed_docs] == ["bad.xlsx"] and told.processing_time > 0
    again = e.ingest(folder).first()
    assert again.total_chunks == n == e.store.table().count()
    index = lexical.LexicalIndex.load(spark, e.conf.index_path)
    assert index.stats.first().n == n
    whole = lexical.build(e.store.table())
    assert sorted(map(tuple, index.terms.select("term", "df").collect())) == sorted(map(tuple, whole.terms.select("term", "df").collect()))
    lexical.release()


def test_chunks_of_one_page_stand_in_order(spark, corpus):
    e = corpus[0]
    rows = e.store.table().filter("doc_name = 'long'").orderBy("chunk_index").collect()
    assert len({r.page for r in rows}) < len(rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    for k in (0, 1, len(rows) - 1):
        x = e.source(rows[k].chunk_id, neighbours=True).first()
        assert x.context_before == (rows[k - 1].content if k else None) and x.context_after == (rows[k + 1].content if k + 1 < len(rows) else None)


def test_requests_choose_how_many(spark, corpus):
    e = corpus[0]
    q = spark.createDataFrame([("a", "锚具检测频率", False, 1), ("b", "锚具检测频率", False, 7), ("c", "锚具检测频率", False, None)], REQUEST)
    got = {}
    for r in e.retrieve(q)[0].collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    assert {k: len(v) for k, v in got.items()} == {"a": 1, "b": 7, "c": 5} and sorted(got["c"]) == sorted((r["rank"], r.chunk_id) for r in e.retrieve(q.filter("query_id = 'c'"))[0].collect())
    only = e.retrieve(q, F.col("doc_name") == "short")[0].collect()
    assert {r.doc_name for r in only} == {"short"} and len(only) >= 3
    cells = Engine(spark, Settings(index_path=e.conf.index_path, vector_path=e.conf.vector_path, probe_cells=3))
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in cells.retrieve(q)[0].collect()) == sorted((q, *x) for q, v in got.items() for x in v)


def test_a_model_may_rewrite(spark, corpus):
    e = corpus[0]
    q = spark.createDataFrame([("a", "quartz?", False, 3)], REQUEST)
    other = Engine(spark, e.conf, rewriter=lambda c: F.lit("basalt"))
    names = lambda x: {r.content for r in x.retrieve(q)[0].collect()}
    assert any("basalt" in c for c in names(other)) and Engine(spark, e.conf, rewriter=lambda c: F.lit("basalt " * 9)).retrieve(q)[0].count() == len(names(e))


def test_prompts(spark):
    q, c = spark.createDataFrame([("1", "why?")], "query_id string, question string"), spark.createDataFrame([("1", "because")], "query_id string, context string")
    said = context.prompts(q, c, SYSTEM).first().prompt
    assert said.startswith(SYSTEM) and said.index("because") < said.index("why?")


def test_routes(spark, corpus):
    api = Api(corpus[0])
    assert api.handle("GET", "/")[0] == 200 and api.handle("GET", "/nothing")[0] == 404 and api.handle("POST", "/api/v1/query", {"question": ""})[0] == 422
    status, told = api.handle("POST", "/api/v1/query", {"question": "锚具检测频率", "options": {"top_k": 2}})
    assert status == 200 and len(told["data"]["sources"]) == 2 and not told["data"]["cached"] and told["data"]["query_time_ms"] >= 0
    status, again = api.handle("POST", "/api/v1/query", {"question": "锚具检测频率"})
    assert again["data"]["cached"] and again["data"]["answer"] == told["data"]["answer"] and api.cache.first().expires_at - api.cache.first().created_at == timedelta(seconds=7)
    api.clear()
    events = list(api.handle("POST", "/api/v1/query/stream", {"question": "锚具检测频率"})[1])
    assert events[0].startswith("event: message\ndata: {") and events[-1].startswith("event: done") and "query_time_ms" in events[-1]
    one = told["data"]["sources"][0]["chunk_id"]
    assert api.handle("GET", f"/api/v1/source/{one}")[1]["data"]["chunk_id"] == one and api.handle("GET", "/api/v1/source/none")[0] == 404
    health = api.handle("GET", "/api/v1/health")[1]
    assert health["status"] == "healthy" and health["components"]["bm25"] == "ok" and health["stats"]["total_documents"] == 3


def test_http_providers(spark):
    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embed":
                told, status = {"output": {"embeddings": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]["texts"]]}}, 500 if "bad" in body["input"]["texts"] else 200
            elif self.path == "/search":
                told, status = {"results": [{"title": body["query"], "content": body["include_domains"][0], "url": "u", "score": 0.9}, {"url": "v"}]}, 503 if body["query"] == "bad" else 200
            else:
                said = body["messages"][1]["content"]
                told, status = ({"message": "quota"}, 429) if "bad" in said else ({"choices": [{"message": {"content": "re: " + said}}]}, 200)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(told).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = spark.createDataFrame([("a",), ("bad",), ("abc",), (" ",)], "t string").coalesce(1)
        assert {r.t: r.embedding for r in HttpEmbedder(base + "/embed", "k", "m", 1).embed(rows, "t").collect()} == {"a": [1.0, 1.0], "bad": None, "abc": [3.0, 1.0], " ": None}
        q = spark.createDataFrame([("1", "x"), ("2", "bad")], "query_id string, question string")
        assert [tuple(r) for r in HttpSearch(base + "/search", "k").search(q, 2).orderBy("rank").collect()] == [("1", "x", "mot.gov.cn", "u", 0.9, 1), ("1", "", "", "v", None, 2)]
        assert HttpSearch(base + "/search", "").search(q).count() == 0
        p = spark.createDataFrame([("1", SYSTEM + "\n\nask"), ("2", "bad")], "query_id string, prompt string")
        said = lambda a: {r.query_id: r.answer for r in a.answer(p).collect()}
        assert said(HttpAnswerer(base, "k", "m")) == {"1": "re: ask", "2": HttpAnswerer.NAMED + "quota"}
        assert set(said(HttpAnswerer(base, "", "m")).values()) == {HttpAnswerer.NOT_READY} and set(said(HttpAnswerer("http://127.0.0.1:9", "k", "m", seconds=2)).values()) == {HttpAnswerer.FAILED}
    finally:
        server.shutdown()


def test_question_stream(spark, tmp_path):
    from plumbago.streaming.questions import answer_stream

    e = Engine(spark, Settings(index_path=str(tmp_path / "i"), vector_path=str(tmp_path / "v")))
    chunks = spark.createDataFrame([("c1", "d", "n", "road density", 1, None, "local", {})], ingest.CHUNK_SCHEMA)
    e.index(chunks)
    spark.createDataFrame([("1", "road density", False, 5)], REQUEST).write.parquet(str(tmp_path / "q"))
    out = []
    s = answer_stream(e, spark.readStream.schema(REQUEST).parquet(str(tmp_path / "q")), lambda df, n: out.extend(df.collect()), str(tmp_path / "c"))
    s.awaitTermination(120)
    assert [r.query_id for r in out] == ["1"]


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    assert files.pick_folder(spark, str(tmp_path)) == f"{tmp_path}/raw"
    (tmp_path / "processed").mkdir()
    (tmp_path / "processed" / "a.md").write_text("x")
    assert files.pick_folder(spark, str(tmp_path)) == f"{tmp_path}/processed"
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert files.table(spark, str(tmp_path / "t.csv")).select("a", "b").first() == ("1", "2")
    with pytest.raises(ValueError):
        files.table(spark, "x.pdf")
