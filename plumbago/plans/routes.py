"""The routes of a question-answering service as functions: what a web framework calls. Status and body, or an iterator of server-sent events."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from plumbago.operators import cache as caching
from plumbago.plans.answer import REQUEST, Engine, event

NAME, VERSION = "plumbago", "1"
SOURCE = "/api/v1/source/"


class Api:
    """Answers are remembered where the engine's settings say so. The cache has at most ``cache_entries`` rows, so the session holds them as they are."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._rows: list = []

    @property
    def cache(self):
        return self.engine.spark.createDataFrame(self._rows, caching.SCHEMA)

    def clear(self) -> None:
        self._rows = []

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict | Iterator[str]]:
        try:
            if (method, path) == ("GET", "/"):
                return 200, {"name": NAME, "version": VERSION}
            if (method, path) == ("GET", "/api/v1/health"):
                return 200, self._health()
            if method == "GET" and path.startswith(SOURCE):
                return self._source(unquote(path[len(SOURCE) :]))
            if (method, path) in (("POST", "/api/v1/query"), ("POST", "/api/v1/query/stream")):
                question, options = (body or {}).get("question"), (body or {}).get("options") or {}
                if not isinstance(question, str) or not 1 <= len(question) <= 1000:
                    return 422, {"detail": "the question must have 1 to 1000 characters"}
                web, k = options.get("use_web_search", True), options.get("top_k")
                if path.endswith("stream"):
                    return 200, self._stream(question, web, k)
                told = self._ask(question, web, k)
                return 200, {"code": 0, "message": "success", "data": told if options.get("include_source", True) else told | {"sources": []}}
            return 404, {"detail": "Not Found"}
        except Exception as e:  # told to the client
            return 500, {"detail": str(e)}

    def _ask(self, question: str, web: bool, k: int | None) -> dict:
        engine = self.engine
        told = engine.ask(question, web, k, self.cache if engine.conf.use_cache else None)
        if engine.conf.use_cache and not told["cached"] and told["sources"]:
            spark = engine.spark
            answered = spark.createDataFrame([("0", question, told["answer"], told["sources"], told["used_web_search"], False)], ANSWERED)
            self._rows = engine.remember(self.cache, answered, spark.createDataFrame([("0", question, web, k)], REQUEST)).collect()
        return told

    def _stream(self, question: str, web: bool, k: int | None, size: int = 200) -> Iterator[str]:
        try:
            told = self._ask(question, web, k)
            for i in range(0, len(told["answer"]), size):
                yield event("message", {"type": "answer", "content": told["answer"][i : i + size]})
            yield event("done", {x: v for x, v in told.items() if x != "answer"})
        except Exception as e:  # told to the client
            yield event("error", {"error": str(e)})

    def _source(self, chunk_id: str) -> tuple[int, dict]:
        row = self.engine.source(chunk_id, neighbours=True).first()
        return (404, {"detail": f"no such chunk: {chunk_id}"}) if row is None else (200, {"code": 0, "message": "success", "data": row.asDict()})

    def _health(self) -> dict:
        row = self.engine.health().first()
        stats = self.engine.store.stats().first().asDict() if self.engine.store.exists() else {}
        return {"status": row.status, "components": row.components, "stats": stats}


ANSWERED = "query_id string, question string, answer string, sources array<struct<rank:int,chunk_id:string,doc_id:string,doc_name:string,page:int,section:string,content:string,source_type:string,url:string>>, used_web boolean, cached boolean"
