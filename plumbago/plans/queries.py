"""The registered queries of the retrieval engine, and DuckDB SQL that states their results.

The driver's tables stand in for a corpus: a document is a chunk, embeddings.vec_id is taken for a doc_id, pages are the web.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions import rewrite, text, tokens, vectors
from plumbago.functions.chunking import chunks
from plumbago.operators import cache, context, fusion, ingest, lexical, vector
from plumbago.plans import answer
from plumbago.plans.providers import page_text, page_title
from plumbago.plans.settings import Settings
from plumbago.sources import store

QUESTION = "the onent thand stupid idiot"
K = 10


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: under the one that the session names, or where it names none the machine's own, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbago-")
    return f"{base}/{uuid.uuid4().hex}"


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    """A table. Texts that come in fewer parts than there are cores, as a small file does, are dealt out; tables of many files aren't shuffled."""
    df = spark.read.parquet(f"{d}/{t}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if t in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return _read(spark, d, "documents").select(text.doc_id(name).alias("doc_id"), text.doc_name(name).alias("doc_name"), "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.to_pages(_files(spark, d))
    return p.withColumn("chunk_id", text.chunk_id(F.col("doc_id"), F.col("page") - 1))


def clean_text(spark, d):
    c = text.clean_markdown(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n_clean"))


def paginate(spark, d):
    return _pages(spark, d).select("doc_id", "doc_name", F.col("page").cast("long").alias("page"), "chunk_id", F.md5("content").alias("content_md5"))


def record_text(spark, d):
    part = _read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumn("Unnamed: 0", F.lit("x"))
    r = ingest.to_records(part, "p_partkey")
    return r.select(F.col("row_index").cast("long").alias("row_index"), "content", F.size("raw_data").cast("long").alias("n_values"))


def tokenize_stats(spark, d):
    t = tokens.latin(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def term_df(spark, d):
    i = lexical.build(_chunks(spark, d), with_han=False)
    return i.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def han_tokens(spark, d):
    return _asked_words(spark).select("id", F.array_join(tokens.tokens(F.col("question")), "|").alias("tokens"))


def _lexical(spark, d, queries, k=K):
    return lexical.ranked(lexical.scan(queries, _chunks(spark, d), with_han=False), k)


def lexical_index(spark, d):
    """A question asked of a saved index, after a document was taken out and put in again."""
    path, chunks = _folder(spark), _chunks(spark, d)
    lexical.build(chunks, with_han=False).save(spark, path)
    one = chunks.filter("chunk_id = 7")
    for gone, new in ((one, one.limit(0)), (one.limit(0), one)):
        lexical.LexicalIndex.load(spark, path).changed(gone, new, with_han=False).save(spark, path)
    return lexical.retrieve(_question(spark), lexical.LexicalIndex.load(spark, path), K, with_han=False).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _question(spark):
    return spark.createDataFrame([(0, QUESTION)], "query_id long, question string")


def bm25_topk(spark, d):
    return _lexical(spark, d, _question(spark)).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk_batch(spark, d):
    q = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return _lexical(spark, d, q).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _asked(spark, d, ids="vec_id = 0"):
    return _read(spark, d, "embeddings").filter(ids).select(F.col("vec_id").alias("query_id"), "embedding")


def _near(spark, d, ids="vec_id = 0", mode="cosine"):
    return vector.search(_asked(spark, d, ids), _vectors(spark, d), K, mode).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_topk(spark, d):
    return _near(spark, d)


def vector_topk_batch(spark, d):
    return _near(spark, d, "vec_id % 50 = 0")


def vector_score_reference(spark, d):
    return _near(spark, d, "vec_id % 50 = 0", "reference")


def similarity_pairs(spark, d):
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"), "embedding")
    return vector.similar_pairs(e, e.select((F.col("pair_id") + 1).alias("pair_id"), "embedding")).select("pair_id", F.round("similarity", 6).alias("similarity"))


def ann_topk(spark, d):
    i = vector.CellIndex.fit(_vectors(spark, d))
    return i.search(_asked(spark, d, "vec_id % 50 = 0"), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _fused(spark, d):
    q = _question(spark)
    v = vector.search(_asked(spark, d), _vectors(spark, d), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
    b = _lexical(spark, d, q).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
    return fusion.fuse(v, b)


def fuse_scores(spark, d):
    return _fused(spark, d).select("chunk_id", F.round("vector_score", 6).alias("vector_score"), F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def web_gate(spark, d):
    """Every benchmark text by its words and by the vector of its number, whose own row isn't a result."""
    q = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    asked = _read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(F.broadcast(q.select("query_id")), "query_id", "left_semi")  # the stated queries
    v = vector.search(asked, _vectors(spark, d), K + 1).filter("query_id != chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
    b = _lexical(spark, d, q).withColumn("score", F.round("score", 6))
    return fusion.needs_web(q, fusion.fuse(v, b)).select("query_id", F.round("top_score", 6).alias("top_score"), "use_web")


def _web(spark, d):
    p = _read(spark, d, "pages").select(F.col("page_id").alias("chunk_id"), "url", page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("content"))
    found = lexical.ranked(lexical.scan(_question(spark), p, with_han=False), 5)
    return found.join(p.join(F.broadcast(found.select("chunk_id")), "chunk_id", "left_semi"), "chunk_id")  # five rows


def web_candidates(spark, d):
    return _web(spark, d).select("chunk_id", "url", "title", F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def authority_filter(spark, d):
    """A third of the pages moved to an authority's domain."""
    moved = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("example.org"), F.lit("std.samr.gov.cn"))).otherwise(F.col("url"))
    return _read(spark, d, "pages").select("page_id", fusion.is_authority(moved).alias("authority"))


def _reranked(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_name"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"))
    local = _fused(spark, d).filter(F.col("rank") <= 5).select("query_id", "chunk_id", "score", "rank").join(docs, "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    web = _web(spark, d).select("query_id", "title", "content", "url", F.round("score", 6).alias("score"), "rank")
    return fusion.rerank(local, web, 8)


def rerank_union(spark, d):
    r = _reranked(spark, d)
    return r.select(F.col("rank").cast("long").alias("rank"), "doc_id", "doc_name", "source_type", "url", F.round("score", 6).alias("score"))


def merge_dedup(spark, d):
    e = _read(spark, d, "events")
    side = lambda kind, n: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("chunk_id")).agg(F.round(F.max("value"), 6).alias("score")).select(F.lit(0).alias("query_id"), "chunk_id", "score", F.lit(n).alias("rank"))
    m = fusion.merge([side("click", 1), side("purchase", 2), side("view", 3)])
    return m.select("chunk_id", "score")


def _asked_words(spark):
    rows = [(k, q) for k, q in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "id long, question string")


#: Questions that exercise the rewriting rules.
QUESTIONS = ["粉煤灰检测项目有哪些", "锚具检测频率是多少", "钢绞线取样方法", "土方路基压实度检测频率是多少？", "水泥混凝土试验规程", "压实度怎么检", "多久检一次", "粉煤灰检什么", "请问砂浆强度怎么做", "碎石压实", "cbr是多少", "怎么检测压实度", "  JTG 标准 有哪些? ", "JT/T 公路工程"]


#: Their tokens, by hand: Latin runs, then lexicon terms and the pairs of characters between them.
HAN = {
    "粉煤灰检测项目有哪些": "粉煤灰|检测项目|有哪|哪些",
    "锚具检测频率是多少": "锚具|检测频率|是多|多少",
    "钢绞线取样方法": "钢绞线|取样方法",
    "土方路基压实度检测频率是多少？": "土方|路基|压实度|检测频率|是多|多少",
    "水泥混凝土试验规程": "水泥|泥混|混凝|凝土|土试|试验|规程",
    "压实度怎么检": "压实度|怎么|么检",
    "多久检一次": "多久|久检|检一|一次",
    "粉煤灰检什么": "粉煤灰|检什|什么",
    "请问砂浆强度怎么做": "请问|问砂|砂浆|浆强|强度|度怎|怎么|么做",
    "碎石压实": "碎石|石压|压实",
    "cbr是多少": "cbr|是多|多少",
    "怎么检测压实度": "怎么|么检|检测|压实度",
    "  JTG 标准 有哪些? ": "JTG|标准|有哪|哪些",
    "JT/T 公路工程": "JT|T|公路|路工|工程",
}


def rewrite_queries(spark, d):
    return _asked_words(spark).select("id", rewrite.rewrite(F.col("question")).alias("rewritten"))


def expand_queries(spark, d):
    return _asked_words(spark).select("id", F.explode(rewrite.variants(F.col("question"))).alias("variant"))


def query_keywords(spark, d):
    return _asked_words(spark).select("id", F.array_join(rewrite.keywords(F.col("question")), "|").alias("keywords"))


def chunk_documents(spark, d):
    c = _read(spark, d, "documents").select("doc_id", F.posexplode(chunks("text", 300, 60, 100)).alias("pos", "c"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.expr("cast(c.index as bigint)").alias("index"), F.expr("c.is_table").alias("is_table"), F.expr("md5(c.content)").alias("content_md5"))


def _marked(c):
    """A text with full stops of the kind at which sentences end, and paragraphs after colons and semicolons."""
    return F.replace(F.replace(F.replace(c, F.lit(". "), F.lit("。")), F.lit("; "), F.lit("\n \n")), F.lit(": "), F.lit("\n\n"))


def chunk_sentences(spark, d):
    """The chunker on documents with sentences and paragraphs."""
    c = _read(spark, d, "documents").select("doc_id", _marked(F.col("text")).alias("text")).select("doc_id", F.posexplode(chunks("text", 300, 60, 100)).alias("pos", "c"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.expr("cast(c.index as bigint)").alias("index"), F.expr("md5(c.content)").alias("content_md5"))


def _page_chunks(spark, d):
    """Chunks of pages with sentences: several a page."""
    pages = ingest.to_pages(_files(spark, d)).withColumn("content", F.replace("content", F.lit(". "), F.lit("。")))
    return ingest.to_chunks(pages, 300, 60, 100)


def ingest_chunks(spark, d):
    return _page_chunks(spark, d).select("chunk_id", "doc_id", F.col("page").cast("long").alias("page"), F.md5("content").alias("content_md5"))


def context_pack(spark, d):
    r = _reranked(spark, d)
    return context.context(r).select(F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


def source_snippets(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.snippet(F.col("text"))).alias("snippet_md5"), text.source_label(F.lit("local"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.pmod("doc_id", F.lit(3)).cast("int"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit(None).cast("string")).alias("label"))


def source_lookup(spark, d):
    one = text.chunk_id(text.doc_id(F.lit("7.md")), F.lit(0))
    return _pages(spark, d).filter(F.col("chunk_id") == one).select("chunk_id", "doc_id", F.col("page").cast("long").alias("page"), "content")


def neighbours(spark, d):
    """Chunks in the order of their document, several on a page."""
    n = answer.with_neighbours(_page_chunks(spark, d).withColumn("chunk_index", F.col("metadata")["index"].cast("int")))
    return n.select("chunk_id", F.md5("context_before").alias("before_md5"), F.md5("context_after").alias("after_md5"))


def corpus_stats(spark, d):
    return store.stats(_pages(spark, d))


def _stored(spark, d):
    s = store.VectorStore(spark, _folder(spark)).initialize()
    s.add(_pages(spark, d).withColumns({"embedding": F.array(F.lit(0.0)), "section": F.lit(None).cast("string"), "source_type": F.lit("local")}))
    return s


def delete_doc(spark, d):
    """What a store holds after a document went."""
    s = _stored(spark, d)
    s.delete_document(hashlib.md5(b"7.md").hexdigest()[:16])
    return s.stats()


def store_filter(spark, d):
    """The nearest stored chunks of some documents alone."""
    table = _vectors(spark, d).filter("chunk_id % 2 = 1")
    return vector.search(_asked(spark, d, "vec_id % 50 = 0"), table, K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_rows(spark, d):
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    c = _read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("doc_id"), F.col("lang").alias("doc_name"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), F.lit("local").alias("source_type"))
    rows = store.VectorStore.rows(c.join(e, "doc", "left"))
    return rows.select("chunk_id", F.md5("content").alias("content_md5"), "doc_id", "doc_name", "page", "section", "source_type", F.size("embedding").cast("long").alias("dim"))


def _requests(spark, d):
    return _read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), (F.col("turn") % 4 < 2).alias("use_web_search"))


def cache_keys(spark, d):
    return cache.keyed(_requests(spark, d)).select("conv_id", "turn", "key")


def cache_replay(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return cache.replay(_read(spark, d, "events"), key)


def health_summary(spark, d):
    """An engine before anything was ingested, and after."""
    base = _folder(spark)
    e = answer.Engine(spark, Settings(index_path=f"{base}/index", vector_path=f"{base}/vectors"))
    before = e.health().collect()  # one row
    one = _pages(spark, d).filter(F.col("doc_id") == hashlib.md5(b"7.md").hexdigest()[:16])
    e.index(one.withColumns({"section": F.lit(None).cast("string"), "source_type": F.lit("local")}))
    states = spark.createDataFrame([("before", *before[0])], "phase string, status string, components map<string,string>").union(e.health().select(F.lit("after"), "status", "components"))
    return states.select("phase", "status", F.array_join(F.array_sort(F.map_keys(F.map_filter("components", lambda k, v: v != "ok"))), ",").alias("missing"))


def request_validation(spark, d):
    return answer.valid(_requests(spark, d)).groupBy("use_web_search").agg(F.count("*").alias("n_valid"))


def embedding_input(spark, d):
    c = text.truncate(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(c).alias("input_md5"), F.length(c).cast("long").alias("n_input"))


def unique_documents(spark, d):
    r = _read(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("doc_name"), F.col("doc_id").alias("rank"))
    return fusion.unique_documents(r).select("query_id", "doc_name", "rank")


def _alone(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that first frees what the last ones have kept."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        lexical.release()
        return f(spark, d)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _alone(f)
    for f in (
        clean_text,
        paginate,
        record_text,
        tokenize_stats,
        han_tokens,
        term_df,
        lexical_index,
        bm25_topk,
        bm25_topk_batch,
        vector_topk,
        vector_topk_batch,
        vector_score_reference,
        similarity_pairs,
        ann_topk,
        fuse_scores,
        web_gate,
        web_candidates,
        authority_filter,
        rerank_union,
        merge_dedup,
        rewrite_queries,
        expand_queries,
        query_keywords,
        chunk_documents,
        chunk_sentences,
        ingest_chunks,
        context_pack,
        source_snippets,
        source_lookup,
        neighbours,
        corpus_stats,
        delete_doc,
        store_filter,
        vector_rows,
        cache_keys,
        cache_replay,
        health_summary,
        request_validation,
        embedding_input,
        unique_documents,
    )
}

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_CLEAN = "text"
for _p, _r in (("#.*?\\n", "chr(10)"), ("\\*\\*|__", "''"), ("\\*|_", "''"), ("\\[.*?\\]\\(.*?\\)", "''"), ("(?s)```.*?```", "''"), (f"{_WS}+", "' '")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {_r}, 'g')"
_CLEAN = _STRIP(_CLEAN)
_PAGES = f"""files as (select doc_id as n, substr(md5(doc_id || '.md'), 1, 16) as doc_id, cast(doc_id as varchar) as doc_name, {_CLEAN} as t from documents),
pages_ as (select doc_id, doc_name, page, substr(md5(doc_id || '_' || (page - 1)), 1, 16) as chunk_id, substr(t, (page - 1) * 1000 + 1, 1000) as content
  from (select *, unnest(range(1, cast(ceil(length(t) / 1000.0) as bigint) + 1)) as page from files)),
p as (select * from pages_ where {_STRIP("content")} <> '')"""
_TOKEN = "[A-Za-z0-9]+(?:\\.[0-9]+)?%?"


def _bm25(docs: str, queries: str, k: int, name: str = "hit") -> str:
    """CTEs that end in ``name``: query_id, chunk_id, score, rank."""
    return f"""{name}_tok as (select chunk_id, regexp_extract_all(content, '{_TOKEN}') as t from ({docs})),
{name}_post as (select chunk_id, term, any_value(dl) as dl, count(*) as tf from (select chunk_id, len(t) as dl, unnest(t) as term from {name}_tok) group by chunk_id, term),
{name}_stats as (select count(*) as n, avg(len(t)) as avgdl from {name}_tok),
{name}_raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from {name}_post, {name}_stats group by term),
{name}_terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from {name}_raw) else raw end as idf from {name}_raw),
{name}_asked as (select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(question, '{_TOKEN}')) as term from ({queries})) group by query_id, term),
{name}_scored as (select query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw from {name}_asked join {name}_post using (term) join {name}_terms using (term), {name}_stats group by query_id, chunk_id),
{name} as (select query_id, chunk_id, least(raw / 20, 1) as score, row_number() over (partition by query_id order by round(raw, 9) desc, chunk_id) as rank from {name}_scored where raw > 0 qualify rank <= {k})"""


_DOCS = "select doc_id as chunk_id, text as content from documents"
_ONE = f"select 0 as query_id, '{QUESTION}' as question"
_BENCH = "select item_id as query_id, text as question from benchmark"
_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


def _nearest(where: str, k: int = K) -> str:
    return f"near_ as (select a.vec_id as query_id, b.vec_id as chunk_id, {_COS} as cos from embeddings a, embeddings b where {where}), near as (select *, row_number() over (partition by query_id order by round(cos, 9) desc, chunk_id) as rank from near_ qualify rank <= {k})"


_FUSED = f"""{_nearest("a.vec_id = 0")}, {_bm25(_DOCS, _ONE, K)},
both_ as (select coalesce(near.chunk_id, hit.chunk_id) as chunk_id, case when cos is null then 0 else round(greatest(0, least(1, cos)), 6) end as v, coalesce(round(score, 6), 0) as b, near.rank as vr, hit.rank as br from near full join hit on near.chunk_id = hit.chunk_id),
fused as (select *, case when v > 0 and b > 0 then least(1.2 * (0.6 * v + 0.4 * b), 1.0) else 0.6 * v + 0.4 * b end as score from both_),
ranked as (select *, row_number() over (order by round(score, 9) desc, coalesce(vr, 1 << 30), coalesce(br, 1 << 30), chunk_id) as rank from fused)"""
_PAGE = "select page_id as chunk_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\\b.*?</script>', ' ', 'g'), '(?s)<style\\b.*?</style>', ' ', 'g'), '(?s)<head\\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as content from pages"
_RERANKED = f"""{_FUSED}, {_bm25(_PAGE, _ONE, 5, "web")},
local_ as (select 0 as side, rank, cast(chunk_id as varchar) as doc_id, 'd' || chunk_id as doc_name, 'local' as source_type, cast(null as varchar) as url, score * 0.7 as score, text as content, 1 as page from ranked join documents on doc_id = chunk_id where rank <= 5),
web_ as (select 1 as side, rank, 'web' as doc_id, title as doc_name, 'web' as source_type, url, case when round(score, 6) <> 0 then round(score, 6) else 0.5 end * 0.3 as score, content, cast(null as int) as page from web join ({_PAGE}) using (chunk_id)),
answer_ as (select *, row_number() over (order by round(score, 9) desc, side, rank) as place from (select * from local_ union all select * from web_) qualify place <= 8)"""
_LIST = ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUESTIONS))
_TERMS = "[" + ", ".join(f"{{'k': '{a}', 'v': '{b}'}}" for a, b in rewrite.TERMS) + "]"
_REPLACED = f"""list_reduce(list_prepend({{'k': {_STRIP("question")}, 'v': ''}}, {_TERMS}), lambda a, p: {{'k': case when contains(a.k, p.k) and not contains(a.k, p.v) then replace(a.k, p.k, p.v) else a.k end, 'v': ''}}).k"""
for _w in rewrite.FILLERS:
    _REPLACED = f"replace({_REPLACED}, '{_w}', '')"
_ENDS = "case " + " ".join(f"when regexp_matches(r, '^(.+?){a}[？?]?$') then regexp_replace(r, '^(.+?){a}[？?]?$', '\\1{b}')" for a, b in rewrite.SENTENCES) + " else r end"
_REWRITTEN = f"q(id, question) as (values {_LIST}), r as (select id, question, {_REPLACED} as r from q), w as (select id, question, {_STRIP(_ENDS)} as rewritten from r)"
_BLOCK = "'【参考资料' || place || '】' || chr(10) || '来源: ' || case when source_type = 'web' then '网络来源: ' || doc_name || ' (' || url || ')' else doc_name || ' - 第' || page || '页' end || chr(10) || '内容:' || chr(10) || content || chr(10)"
_HEAD = "substr(text, 1, 8000)"
_CUT = f"greatest(case when instr({_HEAD}, '。') > 0 then 8001 - instr(reverse({_HEAD}), '。') else 0 end, case when instr({_HEAD}, chr(10)) > 0 then 8001 - instr(reverse({_HEAD}), chr(10)) else 0 end)"
_INPUT = f"case when length(text) <= 8000 then text else {_STRIP(f'case when {_CUT} - 1 > 5600 then substr({_HEAD}, 1, {_CUT}) else {_HEAD} end')} end"



def _chunked(rows: str, size: int, carry: int, name: str = "cut") -> str:
    """CTEs that end in ``name``: key, pos, index, content of the chunks of rows (key, x) without tables."""
    tail = f"right(a.c, {carry})"
    over = f"case when length(a.c) <= {carry} then a.c when regexp_matches({tail}, '[。！？；]') then regexp_replace({tail}, '(?s)^.*?[。！？；]', '') else {tail} end"
    flushed = f"case when {_STRIP('a.c')} <> '' then list_append(a.o, {_STRIP('a.c')}) else a.o end"
    ended = lambda z: f"case when {_STRIP(z + '.c')} <> '' then list_append({z}.o, {_STRIP(z + '.c')}) else {z}.o end"
    mark = "'[^。！？；\\n]*[。！？；\\n]'"
    none, rest = "cast([] as varchar[])", "substr(p, length(coalesce(array_to_string(parts, ''), '')) + 1)"
    return f"""{name}_p as (select key, x, unnest(regexp_split_to_array(x, '\\n{_WS}*\\n')) as p, generate_subscripts(regexp_split_to_array(x, '\\n{_WS}*\\n'), 1) as i from ({rows}) where {_STRIP('x')} <> ''),
{name}_s as (select key, x, i, {_STRIP('p')} as p from {name}_p where {_STRIP('p')} <> ''),
{name}_t as (select *, regexp_extract_all(p, {mark}) as parts from {name}_s),
{name}_u as (select *, case when {_STRIP(rest)} <> '' then list_append(parts, {rest}) else parts end as said from {name}_t),
{name}_b as (select *, case when length(p) > {size} then list_reduce(list_prepend({{'o': {none}, 'c': ''}}, list_transform(said, lambda s: {{'o': {none}, 'c': s}})), lambda a, s: case when length(a.c) + length(s.c) <= {size} then {{'o': a.o, 'c': a.c || s.c}} else {{'o': {flushed}, 'c': {over} || s.c}} end) end as z from {name}_u),
{name}_g as (select key, any_value(x) as x, list_prepend({{'o': {none}, 'c': ''}}, list({{'o': case when z is null then {none} else {ended('z')} end, 'c': p}} order by i)) as q from {name}_b group by key),
{name}_f as (select key, x, list_reduce(q, lambda a, b: case when length(a.c) + length(b.c) <= {size} then {{'o': a.o, 'c': a.c || b.c || chr(10)}}
  when length(b.c) > {size} then {{'o': list_concat({flushed}, b.o), 'c': ''}} else {{'o': {flushed}, 'c': {over} || b.c || chr(10)}} end) as w from {name}_g),
{name}_c as (select key, x, unnest({ended('w')}) as content, generate_subscripts({ended('w')}, 1) - 1 as index from {name}_f),
{name} as (select key, content, cast(index as bigint) as index, row_number() over (partition by key order by case when contains(x, left(content, 50)) then instr(x, left(content, 50)) else 1000000 end, index) - 1 as pos from {name}_c)"""


_SENTENCES = "replace(replace(replace(text, '. ', '。'), '; ', chr(10) || ' ' || chr(10)), ': ', chr(10) || chr(10))"
_PAGE_CHUNKS = f"""{_PAGES}, {_chunked("select doc_id || '/' || page as key, replace(content, '. ', '。') as x from p", 300, 60)},
i as (select doc_id, page, content, row_number() over (partition by doc_id order by page, pos) - 1 as i from (select c.content, c.pos, p.doc_id, p.page from cut c join p on c.key = p.doc_id || '/' || p.page))"""

ORACLE_SQL: dict[str, str] = {
    "clean_text": f"select doc_id, md5(c) as clean_md5, length(c) as n_clean from (select doc_id, {_CLEAN} as c from documents)",
    "paginate": f"with {_PAGES} select doc_id, doc_name, page, chunk_id, md5(content) as content_md5 from p",
    "record_text": "select p_partkey as row_index, concat_ws('; ', 'p_name: ' || trim(p_name), 'p_brand: ' || trim(p_brand), 'p_type: ' || trim(p_type), 'p_size: ' || p_size) as content, cast(4 as bigint) as n_values from part",
    "tokenize_stats": f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_terms from (select doc_id, regexp_extract_all(text, '{_TOKEN}') as t from documents)",
    "han_tokens": f"with q(id, question) as (values {_LIST}), t(question, tokens) as (values {', '.join(f"('{q}', '{t}')" for q, t in HAN.items())}) select cast(id as bigint) as id, tokens from q join t using (question)",
    "term_df": f"with {_bm25(_DOCS, _ONE, K)} select term, df, round(idf, 6) as idf from hit_terms",
    "bm25_topk": f"with {_bm25(_DOCS, _ONE, K)} select chunk_id, round(score, 6) as score, rank from hit",
    "bm25_topk_batch": f"with {_bm25(_DOCS, _BENCH, K)} select query_id, chunk_id, round(score, 6) as score, rank from hit",
    "vector_topk": f"with {_nearest('a.vec_id = 0')} select query_id, chunk_id, round(greatest(0, least(1, cos)), 6) as score, rank from near",
    "vector_topk_batch": f"with {_nearest('a.vec_id % 50 = 0')} select query_id, chunk_id, round(greatest(0, least(1, cos)), 6) as score, rank from near",
    "vector_score_reference": f"with {_nearest('a.vec_id % 50 = 0')} select query_id, chunk_id, round(greatest(0, least(1, 1 - cos)), 6) as score, rank from near",
    "ann_topk": f"with {_nearest('a.vec_id % 50 = 0')} select query_id, chunk_id, round(greatest(0, least(1, cos)), 6) as score, rank from near",
    "store_filter": f"with {_nearest('a.vec_id % 50 = 0 and b.vec_id % 2 = 1')} select query_id, chunk_id, round(greatest(0, least(1, cos)), 6) as score, rank from near",
    "lexical_index": f"with {_bm25(_DOCS, _ONE, K)} select chunk_id, round(score, 6) as score, rank from hit",
    "similarity_pairs": f"select a.vec_id as pair_id, round({_COS}, 6) as similarity from embeddings a join embeddings b on a.vec_id = b.vec_id + 1",
    "fuse_scores": f"with {_FUSED} select chunk_id, round(v, 6) as vector_score, round(b, 6) as lexical_score, round(score, 6) as score, rank from ranked",
    "web_gate": f"""with {_nearest("a.vec_id in (select item_id from benchmark) and a.vec_id <> b.vec_id")}, {_bm25(_DOCS, _BENCH, K)},
j as (select coalesce(near.query_id, hit.query_id) as q, case when cos is null then 0 else round(greatest(0, least(1, cos)), 6) end as v, coalesce(round(score, 6), 0) as b from near full join hit on near.query_id = hit.query_id and near.chunk_id = hit.chunk_id),
t as (select q, max(case when v > 0 and b > 0 then least(1.2 * (0.6 * v + 0.4 * b), 1.0) else 0.6 * v + 0.4 * b end) as top from j group by q)
select item_id as query_id, round(top, 6) as top_score, coalesce(top, 0) < 0.5 as use_web from benchmark left join t on item_id = q""",
    "web_candidates": f"with {_bm25(_PAGE, _ONE, 5, 'web')} select chunk_id, url, title, md5(content) as content_md5, round(score, 6) as score, rank from web join ({_PAGE}) using (chunk_id)",
    "authority_filter": "select page_id, page_id % 3 = 0 and contains(url, 'example.org') as authority from pages",
    "rerank_union": f"with {_RERANKED} select place as rank, doc_id, doc_name, source_type, url, round(score, 6) as score from answer_",
    "merge_dedup": "with s as (select user_id as chunk_id, event_type, round(max(value), 6) as score, case event_type when 'click' then 1 when 'purchase' then 2 else 3 end as l from events where event_type in ('click', 'purchase', 'view') group by 1, 2) select chunk_id, score from s qualify row_number() over (partition by chunk_id order by l) = 1",
    "rewrite_queries": f"with {_REWRITTEN} select cast(id as bigint) as id, rewritten from w",
    "expand_queries": f"with {_REWRITTEN} select distinct cast(id as bigint) as id, variant from (select id, question as variant from w union all select id, rewritten from w)",
    "query_keywords": f"with q(id, question) as (values {_LIST}) select cast(id as bigint) as id, array_to_string(list_filter([" + ", ".join(f"'{k}'" for k in rewrite.KEYWORDS) + "], lambda k: contains(question, k)), '|') as keywords from q",
    "chunk_documents": f"with {_chunked('select doc_id as key, text as x from documents', 300, 60)} select key as doc_id, pos, index, false as is_table, md5(content) as content_md5 from cut",
    "chunk_sentences": f"with {_chunked(f'select doc_id as key, {_SENTENCES} as x from documents', 300, 60)} select key as doc_id, pos, index, md5(content) as content_md5 from cut",
    "ingest_chunks": f"with {_PAGE_CHUNKS} select substr(md5(doc_id || '_' || i), 1, 16) as chunk_id, doc_id, page, md5(content) as content_md5 from i",
    "context_pack": f"with {_RERANKED}, b as (select place, {_BLOCK} as block from answer_), u as (select *, sum(length(block)) over (order by place) as upto from b), c as (select chr(10) || repeat('=', 50) || coalesce(string_agg(block, chr(10) order by place) filter (upto <= 6000), '') as c from u) select md5(c) as context_md5, length(c) as n_chars from c",
    "source_snippets": "select doc_id, md5(case when length(text) > 500 then substr(text, 1, 500) || '...' else text end) as snippet_md5, concat_ws(' - ', 'd' || doc_id, case when doc_id % 3 <> 0 then '第' || (doc_id % 3) || '页' end, case when doc_id % 2 = 0 then '第' || lang || '节' end) as label from documents",
    "source_lookup": f"with {_PAGES} select chunk_id, doc_id, page, content from p where chunk_id = substr(md5(substr(md5('7.md'), 1, 16) || '_0'), 1, 16)",
    "neighbours": f"with {_PAGE_CHUNKS} select substr(md5(doc_id || '_' || i), 1, 16) as chunk_id, md5(lag(content) over w) as before_md5, md5(lead(content) over w) as after_md5 from i window w as (partition by doc_id order by i)",
    "corpus_stats": f"with {_PAGES} select count(*) as total_chunks, count(distinct nullif(doc_id, '')) as total_documents from p",
    "delete_doc": f"with {_PAGES} select count(*) as total_chunks, count(distinct nullif(doc_id, '')) as total_documents from p where doc_id <> substr(md5('7.md'), 1, 16)",
    "vector_rows": "select cast(doc_id as varchar) as chunk_id, md5(substr(text, 1, 65535)) as content_md5, source as doc_id, lang as doc_name, cast(0 as bigint) as page, '' as section, 'local' as source_type, len(embedding) as dim from documents join embeddings on vec_id = doc_id",
    "cache_keys": "select conv_id, turn, md5(text || ':' || case when turn % 4 < 2 then 'True' else 'False' end) as key from conversations where role = 'user'",
    "cache_replay": """with recursive e as (select concat_ws(':', user_id, event_type) as key, ts from events where ts is not null),
r(key, made) as (select key, min(ts) from e group by key union all select r.key, min(e.ts) from r join e on e.key = r.key and e.ts > r.made + interval 1 hour group by r.key),
m as (select key, count(*) as made from r group by key)
select e.key, count(*) as requests, count(*) - any_value(m.made) as hits from e join m on e.key = m.key group by e.key""",
    "health_summary": "select * from (values ('before', 'degraded', 'bm25,vectordb'), ('after', 'healthy', '')) t(phase, status, missing)",
    "request_validation": "select turn % 4 < 2 as use_web_search, count(*) as n_valid from conversations where role = 'user' and length(text) between 1 and 1000 group by 1",
    "embedding_input": f"select doc_id, md5({_INPUT}) as input_md5, length({_INPUT}) as n_input from documents",
    "unique_documents": "select lang as query_id, source as doc_name, min(doc_id) as rank from documents group by 1, 2",
}
