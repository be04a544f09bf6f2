"""Ingest, retrieval and answers as whole plans."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.functions import rewrite
from plumbago.operators import cache as caching
from plumbago.operators import context as contexts
from plumbago.operators import fusion, ingest, lexical, vector
from plumbago.plans.providers import APOLOGY, SYSTEM, Answerer, Embedder, Extract, HashedTerms, WebSearch
from plumbago.plans.settings import Settings, settings
from plumbago.sources import files
from plumbago.sources.store import VectorStore

REQUEST = "query_id string, question string, use_web_search boolean, top_k int"


def valid(requests: DataFrame) -> DataFrame:
    """Questions of 1 to 1000 code points."""
    return requests.filter(F.length("question").between(1, 1000))


@dataclass
class Engine:
    spark: SparkSession
    conf: Settings = field(default_factory=settings)
    embedder: Embedder | None = None
    answerer: Answerer = field(default_factory=Extract)
    web: WebSearch | None = None
    #: A model's rewriting of a question column; one that is too long isn't asked.
    rewriter: Callable[[Column], Column] | None = None

    def __post_init__(self):
        self.embedder = self.embedder or HashedTerms(self.conf.embedding_dim)
        self.store = VectorStore(self.spark, self.conf.vector_path)

    def ingest(self, folder: str, mode: str = "replace") -> DataFrame:
        """Markdown and workbooks of a folder to chunks, vectors and the lexical index; a row of counters: total_docs (files read, empty ones included), total_chunks (chunks that came in), failed_docs, processing_time in seconds."""
        start = time.perf_counter()
        read, books = files.markdown(self.spark, folder), files.workbook_records(self.spark, folder).persist()
        pages = ingest.to_pages(read.filter("status = 'ok'"))
        chunks = ingest.to_chunks(pages, self.conf.chunk_size, self.conf.chunk_overlap, self.conf.min_chunk_size).unionByName(ingest.workbook_chunks(books))
        added = self.index(chunks, mode)
        told = read.select("path", "status").union(books.select("path", "status"))
        counted = told.agg(F.count("*").alias("total_docs"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("path")))).alias("failed_docs")).first()  # names of files
        books.unpersist()
        row = (counted.total_docs, added, counted.failed_docs, round(time.perf_counter() - start, 2))
        return self.spark.createDataFrame([row], "total_docs long, total_chunks long, failed_docs array<string>, processing_time double")

    def index(self, chunks: DataFrame, mode: str = "replace") -> int:
        """Store chunks and bring the lexical index up to date; only chunks that come or go are tokenised. The number of chunks that came in."""
        self.store.initialize()
        rows = self.store.rows(self.embedder.embed(chunks, "content")).persist()
        known = self.store.table()
        gone = (self.store.replaced(rows) if mode == "replace" else known.limit(0)).select("chunk_id", "content")
        if lexical.LexicalIndex.exists(self.spark, self.conf.index_path):
            new = lexical.LexicalIndex.load(self.spark, self.conf.index_path).changed(gone, rows)
        else:
            left = known if mode != "replace" else known.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
            new = lexical.build(left.select("chunk_id", "content").union(rows.select("chunk_id", "content")))
        new.save(self.spark, self.conf.index_path)
        added = self.store.add(rows, mode)
        lexical.release()
        rows.unpersist()
        return added

    def _depths(self, requests: DataFrame) -> tuple[DataFrame, int]:
        """query_id, k: how many results each request wants; and the most."""
        own = F.col("top_k") if "top_k" in requests.columns else F.lit(None)
        ks = valid(requests).select("query_id", F.greatest(F.coalesce(own.cast("int"), F.lit(self.conf.top_k)), F.lit(1)).alias("k"))
        n, most = ks.agg(F.count("*"), F.coalesce(F.max("k"), F.lit(self.conf.top_k))).first()
        return F.broadcast(ks) if n <= vector.QUERIES_A_SCAN else ks, most

    def retrieve(self, requests: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Reranked results with their payload, and per query top_score and used_web. requests: query_id, question, use_web_search, and top_k, which counts where it isn't null. ``where``: a condition on stored chunks, met before the cut."""
        ks, most = self._depths(requests)
        within = lambda df, by, times=1: df.join(ks, "query_id").filter(F.col(by) <= times * F.col("k")).drop("k")
        table = self.store.table() if where is None else self.store.where(where)
        asked = valid(requests).select("query_id", "use_web_search", "question", F.explode(self._variants(F.col("question"))).alias("variant"))
        vectors = self.embedder.embed(asked, "variant").filter("embedding is not null").select("query_id", "embedding")
        near = self._per_variant(vectors, table, 2 * most)
        index = lexical.LexicalIndex.load(self.spark, self.conf.index_path)
        said = lexical.retrieve(asked.select("query_id", F.col("variant").alias("question")), index, 2 * most, among=None if where is None else table)
        fused = fusion.fuse(within(near, "rank", 2), within(said, "rank", 2))
        gate = fusion.needs_web(valid(requests), fused).join(requests.select("query_id", "question", "use_web_search"), "query_id")
        local = within(fused, "rank").join(table.drop("embedding", "source_type", "chunk_index"), "chunk_id")
        none = "query_id string, title string, content string, url string, score double, rank int"
        open_ = gate.filter("use_web and use_web_search").select("query_id", "question")
        web = self.spark.createDataFrame([], none) if self.web is None or not self.conf.use_web_search else within(self.web.search(open_, most), "rank")
        used = web.select("query_id").distinct().withColumn("used_web", F.lit(True))
        return within(fusion.rerank(local, web, most), "rank"), gate.select("query_id", "top_score").join(used, "query_id", "left").withColumn("used_web", F.coalesce("used_web", F.lit(False)))

    def _variants(self, question: Column) -> Column:
        own = rewrite.variants(question)
        return own if self.rewriter is None else F.array_distinct(F.concat(own, F.array(rewrite.accepted(self.rewriter(question), question))))

    def _per_variant(self, vectors: DataFrame, table: DataFrame, k: int) -> DataFrame:
        """The nearest chunks of each request; with ``probe_cells`` by an index of cells, which finds the same."""
        chunks = table.select("chunk_id", "embedding")
        if self.conf.probe_cells and not table.isEmpty():
            near = vector.CellIndex.fit(chunks, cells=self.conf.probe_cells).search(vectors, k, mode=self.conf.vector_score)
        else:
            near = vector.search(vectors, chunks, k, self.conf.vector_score)
        return near.select("query_id", "chunk_id", "score", "rank")

    def answer(self, requests: DataFrame, cache: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """query_id, question, answer, sources, used_web, cached. A query without results gets an apology."""
        requests = valid(requests)
        hits = None
        if cache is not None and self.conf.use_cache:
            found = caching.get(cache, requests, F.current_timestamp())
            hits = found.filter("data is not null").select("query_id", "question", F.from_json("data", _DATA).alias("d")).select("query_id", "question", "d.answer", "d.sources", "d.used_web", F.lit(True).alias("cached"))
            requests = found.filter("data is null").select(*requests.columns)
        results, stats = self.retrieve(requests, where)
        context = contexts.context(results)
        prompts = contexts.prompts(requests, context, SYSTEM).join(context, "query_id").join(requests.select("query_id", "question"), "query_id")
        answers = self.answerer.answer(prompts)
        listed = contexts.sources(results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*_SOURCE))).alias("sources"))
        out = requests.select("query_id", "question").join(answers, "query_id", "left").join(listed, "query_id", "left").join(stats.select("query_id", "used_web"), "query_id", "left")
        none = F.array().cast(_DATA_SOURCES)
        found = out.select("query_id", "question", F.coalesce("answer", F.lit(APOLOGY)).alias("answer"), F.coalesce(F.col("sources"), none).cast(_DATA_SOURCES).alias("sources") if self.conf.include_source else none.alias("sources"), F.coalesce("used_web", F.lit(False)).alias("used_web"), F.lit(False).alias("cached"))
        return found if hits is None else found.unionByName(hits)

    def remember(self, cache: DataFrame, answered: DataFrame, requests: DataFrame) -> DataFrame:
        """The cache with new answers that have sources in it."""
        new = answered.filter("not cached and size(sources) > 0").join(requests.select("query_id", "use_web_search"), "query_id")
        return caching.put(cache, new.select("question", "use_web_search", F.to_json(F.struct("answer", "sources", "used_web")).alias("data")), F.current_timestamp(), timedelta(seconds=self.conf.cache_seconds), self.conf.cache_entries)

    def ask(self, question: str, use_web_search: bool = True, top_k: int | None = None, cache: DataFrame | None = None) -> dict:
        """One question's answer: answer, sources, used_web_search, cached, query_time_ms."""
        start = time.perf_counter()
        row = self.answer(self.spark.createDataFrame([("0", question, use_web_search, top_k)], REQUEST), cache).first()
        if row is None:
            raise ValueError("the question must have 1 to 1000 characters")
        return {"answer": row.answer, "sources": [s.asDict() for s in row.sources], "used_web_search": row.used_web, "cached": row.cached, "query_time_ms": round((time.perf_counter() - start) * 1000)}

    def stream(self, question: str, use_web_search: bool = True, size: int = 200, top_k: int | None = None) -> Iterator[str]:
        """One question's answer as server-sent events: fragments, then its sources; an error event if it fails."""
        try:
            told = self.ask(question, use_web_search, top_k)
            for i in range(0, len(told["answer"]), size):
                yield event("message", {"type": "answer", "content": told["answer"][i : i + size]})
            yield event("done", {k: v for k, v in told.items() if k != "answer"})
        except Exception as e:  # told to the client
            yield event("error", {"error": str(e)})

    def source(self, chunk_id: str, neighbours: bool = False) -> DataFrame:
        """A chunk's detail; with what stands before and after it in its document if asked for."""
        one = self.store.get(chunk_id)
        if not neighbours:
            return one.withColumns({"context_before": F.lit(None).cast("string"), "context_after": F.lit(None).cast("string")})
        same = self.store.table().join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi")  # one row
        return with_neighbours(same).filter(F.col("chunk_id") == chunk_id)

    def health(self) -> DataFrame:
        """status and components in one row."""
        parts = {"vectordb": self.store.exists(), "bm25": lexical.LexicalIndex.exists(self.spark, self.conf.index_path), "llm": self.answerer is not None, "embedder": self.embedder is not None}
        states = F.create_map(*(F.lit(x) for k, v in parts.items() for x in (k, "ok" if v else "error")))
        return health(self.spark.range(1).select(states.alias("components")))


_SOURCE = ["rank", "chunk_id", "doc_id", "doc_name", "page", "section", "content", "source_type", "url"]
_DATA_SOURCES = "array<struct<rank:int,chunk_id:string,doc_id:string,doc_name:string,page:int,section:string,content:string,source_type:string,url:string>>"
_DATA = f"answer string, sources {_DATA_SOURCES}, used_web boolean"


def event(name: str, body: dict) -> str:
    """One server-sent event."""
    return f"event: {name}\ndata: {json.dumps(body, ensure_ascii=False)}\n\n"


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunks with the content of the chunk before and after each in its document, by chunk_index. One document's chunks meet in one task."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    return chunks.withColumns({"context_before": F.lag("content").over(w), "context_after": F.lead("content").over(w)})


def health(components: DataFrame) -> DataFrame:
    return components.select(F.when(F.forall(F.map_values("components"), lambda v: v == "ok"), "healthy").otherwise("degraded").alias("status"), "components")
