"""What comes from outside: embeddings, answers, web results. Each has a deterministic offline default; none of them claims the quality of a hosted model."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions.text import blank, truncate
from plumbago.functions.tokens import tokens
from plumbago.operators import lexical
from plumbago.operators.fusion import AUTHORITIES

SYSTEM = "你是公路工程质量检测专家。请依据所给资料作答：准确、完整，能用表格时用表格，并注明文件、页码和章节。"
APOLOGY = "抱歉，未找到相关信息。"


class Embedder(Protocol):
    """Adds ``embedding`` (array<float>) to rows with ``column``; null for a blank text."""

    def embed(self, rows: DataFrame, column: str) -> DataFrame: ...


class Answerer(Protocol):
    """query_id, answer from query_id, question, context, prompt."""

    def answer(self, rows: DataFrame) -> DataFrame: ...


class WebSearch(Protocol):
    """query_id, title, content, url, score, rank from query_id, question."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class HashedTerms:
    """Signed hashed bag of tokens, on the JVM."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, rows: DataFrame, column: str) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0), self.dim)
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        add = lambda v, h: F.transform(v, lambda x, i: F.when(i == F.pmod(h, F.lit(self.dim)), x + sign(h)).otherwise(x))
        vector = F.aggregate(F.transform(tokens(truncate(F.col(column))), lambda t: F.xxhash64(t)), zero, add).cast("array<float>")
        return rows.withColumn("embedding", F.when(~blank(F.col(column)), vector))


class BatchedEmbedder:
    """A function from a list of texts to vectors, called with ``size`` texts at a time; vectors stay with their rows, and a failed batch leaves nulls."""

    def __init__(self, function, size: int = 25):
        self.function, self.size = function, size

    def embed(self, rows: DataFrame, column: str) -> DataFrame:
        function, size = self.function, self.size

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out: list = [None] * len(texts)
                some = [i for i, t in enumerate(texts) if t and t.strip()]
                for k in range(0, len(some), size):
                    part = some[k : k + size]
                    try:
                        got = function([texts.iloc[i] for i in part])
                    except Exception:  # a provider's failure is a missing vector
                        continue
                    for i, v in zip(part, got, strict=True):
                        out[i] = v
                yield pd.Series(out, dtype=object)

        return rows.withColumn("embedding", vectors(truncate(F.col(column))))


def post(url: str, body: dict, seconds: float, key: str = "") -> dict:
    """A JSON request and its JSON answer. Raises what the connection raises."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=seconds) as r:
        return json.loads(r.read())


class HttpEmbedder(BatchedEmbedder):
    """Vectors from a hosted model, ``size`` texts a request. A request that fails, or is answered without vectors, leaves nulls."""

    def __init__(self, url: str, key: str, model: str, size: int = 25, seconds: float = 60.0):
        def vectors(texts: list[str]) -> list[list[float]]:
            told = post(url, {"model": model, "input": {"texts": texts}, "parameters": {"text_type": "document"}}, seconds, key)
            return [x["embedding"] for x in told["output"]["embeddings"]]

        super().__init__(vectors, size)


class HttpSearch:
    """Results of a hosted web search, a request a query, asked for ``include`` domains (the authorities by default). Without a key, or if a request fails, a query has none."""

    def __init__(self, url: str, key: str, include: list[str] | None = None, exclude: list[str] | None = None, seconds: float = 30.0):
        self.url, self.key, self.include, self.exclude, self.seconds = url, key, include, exclude, seconds

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        url, key, seconds = self.url, self.key, self.seconds
        body = {"api_key": key, "search_depth": "advanced", "max_results": k, "include_answer": True, "include_raw_content": False, "include_domains": self.include or AUTHORITIES} | ({"exclude_domains": self.exclude} if self.exclude else {})

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for i, q in zip(batch["query_id"], batch["question"], strict=True):
                    try:
                        found = post(url, body | {"query": q}, seconds).get("results", []) if key else []
                    except (OSError, ValueError):
                        found = []
                    rows += [(i, x.get("title", ""), x.get("content", ""), x.get("url", ""), x.get("score"), n) for n, x in enumerate(found[:k], 1)]
                yield pd.DataFrame(rows, columns=["query_id", "title", "content", "url", "score", "rank"])

        return queries.select("query_id", "question").mapInPandas(work, "query_id string, title string, content string, url string, score double, rank int")


class HttpAnswerer:
    """Answers of a hosted model, a request a question. Failures are told in the answer."""

    #: What is answered without a key, to an error that the service names, and to any other.
    NOT_READY, NAMED, FAILED = "抱歉，系统暂时无法生成答案，请稍后重试。", "抱歉，生成答案时出现错误: ", "抱歉，生成答案时出现错误，请稍后重试。"

    def __init__(self, url: str, key: str, model: str, tokens: int = 1000, temperature: float = 0.1, seconds: float = 60.0):
        self.url, self.key, self.model, self.tokens, self.temperature, self.seconds = url, key, model, tokens, temperature, seconds

    def answer(self, rows: DataFrame) -> DataFrame:
        url, key, seconds, fixed = self.url, self.key, self.seconds, {"model": self.model, "max_tokens": self.tokens, "temperature": self.temperature}

        def one(prompt: str) -> str:
            if not key:
                return HttpAnswerer.NOT_READY
            try:
                told = post(url, fixed | {"messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt.removeprefix(SYSTEM).lstrip()}]}, seconds, key)
                return told["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                try:
                    return HttpAnswerer.NAMED + json.loads(e.read())["message"]
                except (ValueError, KeyError):
                    return HttpAnswerer.FAILED
            except (OSError, ValueError, LookupError):
                return HttpAnswerer.FAILED

        @F.pandas_udf("string")
        def answers(prompts: pd.Series) -> pd.Series:
            return prompts.map(one)

        return rows.select("query_id", answers("prompt").alias("answer"))


class Extract:
    """The content of the first source, cut to a length; an apology without sources."""

    def __init__(self, length: int = 1000):
        self.length = length

    def answer(self, rows: DataFrame) -> DataFrame:
        body = F.regexp_extract("context", r"(?s)内容:\n(.*?)\n(?:\n【参考资料|$)", 1)
        return rows.select("query_id", F.when(F.length(body) > 0, F.substring(body, 1, self.length)).otherwise(APOLOGY).alias("answer"))


class Evaluator(Protocol):
    """query_id, accuracy, completeness, relevance (0 to 10) from query_id, question, answer, context."""

    def evaluate(self, rows: DataFrame) -> DataFrame: ...


class Overlap:
    """Shares of tokens, as an offline stand-in for a model's judgement: of the answer's in the context, of the question's in the answer, of the question's in the context."""

    def evaluate(self, rows: DataFrame) -> DataFrame:
        held = rows.select("query_id", *(tokens(F.col(c)).alias(c) for c in ("question", "answer", "context")))
        share = lambda a, b: F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, b)) * 10.0 / F.size(F.array_distinct(a)), 1)).otherwise(0.0)
        return held.select("query_id", share("answer", "context").alias("accuracy"), share("question", "answer").alias("completeness"), share("question", "context").alias("relevance"))


class PageSearch:
    """Web search over a table of pages (page_id, url, html), by BM25 of their text. include and exclude are domains."""

    def __init__(self, pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None):
        some = pages
        if include:
            some = some.filter(F.exists(F.array(*map(F.lit, include)), lambda d: F.contains("url", d)))
        if exclude:
            some = some.filter(~F.exists(F.array(*map(F.lit, exclude)), lambda d: F.contains("url", d)))
        self.pages = some.select(F.col("page_id").cast("string").alias("chunk_id"), "url", page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("content"))
        self.index = lexical.build(self.pages)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return lexical.retrieve(queries, self.index, k).join(self.pages, "chunk_id").select("query_id", "title", "content", "url", "score", "rank")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def page_text(html: Column) -> Column:
    """Text of a page: without head, scripts, styles and tags."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style|head)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(body, r"[\x20\x09-\x0D]+", " "))
