"""Questions as a stream: every micro-batch is answered by the same plan as a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbago.plans.answer import Engine


def answer_stream(engine: Engine, questions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """questions: a streaming frame of query_id, question, use_web_search, top_k."""
    return questions.writeStream.foreachBatch(lambda batch, n: sink(engine.answer(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
