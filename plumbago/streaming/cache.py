"""The cache's time to live as keyed state: each request is told whether an entry lives, and makes one if not."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts timestamp, hit boolean"
STATE = "made double"


def hits(requests: DataFrame, seconds: float = 3600) -> DataFrame:
    """requests: a streaming frame of key, ts; key, ts, hit. A hit doesn't extend the entry. Requests of one batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t in rows["ts"]:
            at = t.timestamp()
            hit = made is not None and at - made <= seconds
            if not hit:
                made = at
            out.append((key[0], t, hit))
        state.update((made,))
        yield pd.DataFrame(out, columns=["key", "ts", "hit"])

    return requests.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
