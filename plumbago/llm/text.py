"""Vectorised text primitives shared by the Python-side operators.

A *word* is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: digits, a-z and every
character from U+0080 on. Both rules can be decided byte by byte in UTF-8, so whole Arrow batches are tokenised and hashed with
numpy, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled by one numpy pass; bounds the memory of a task whatever the batch holds.
BLOCK = 1 << 20
#: Rows of a batch whose texts are copied at a time.
SLICE = 2048

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts: byte spans in ``data``, the text each belongs to, and where each text's words begin."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word that depends on its bytes alone."""
        out = np.empty(len(self), np.uint64)
        raw = np.frombuffer(self.data, np.uint8)
        i = 0
        while i < len(self):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + BLOCK, "right")))
            power, inverse = _powers(int(self.ends[j - 1] - base) + 1)
            piece = raw[base : self.ends[j - 1]].astype(np.uint64)
            piece += np.uint64(1)
            piece *= power[: len(piece)]
            total = np.empty(len(piece) + 1, np.uint64)
            total[0] = 0
            np.cumsum(piece, out=total[1:])
            a, b = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = (total[b] - total[a]) * inverse[a]
            i = j
        return mix(out)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within one text, and the index of the first word of each."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(hashes) - n + 1
    g = hashes[:m].copy()
    for k in range(1, n):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += hashes[k : k + m]
    counts = np.diff(first)
    last_start = np.repeat(first[1:] - n, counts)[:m]  # the last place in its text where a run can begin
    at = np.flatnonzero(np.arange(m) <= last_start)
    return mix(g[at]), at


def words_of(data: bytes, offsets: np.ndarray, fold: bytes | None = LOWER, table: np.ndarray = IS_WORD) -> Words:
    """Tokenise texts stored back to back: text k is data[offsets[k]:offsets[k + 1]]. A word is a run of bytes of ``table`` after ``fold``."""
    data = data.translate(fold) if fold else data
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return Words(data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    w = table[raw]
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    cut = offsets[offsets < n]
    begin[cut] = w[cut]
    cut = offsets[offsets > 0] - 1
    end[cut] = w[cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets, "left"))


def blocks(column: pa.Array, limit: int = BLOCK, rows: int = 4096) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of at most ``rows`` rows and about ``limit`` bytes: first row, row after the last, bytes, offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for s in range(0, len(column), SLICE):  # only a slice of the batch is copied at a time
        part = pc.fill_null(column.slice(s, SLICE).cast(pa.large_string()), "")
        n = len(part)
        _, off, data = part.buffers()
        off = np.frombuffer(off, np.int64)[part.offset : part.offset + n + 1]
        data = memoryview(data) if data is not None else memoryview(b"")
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, n, i + rows)
            yield s + i, s + j, bytes(data[off[i] : off[j]]), (off[i : j + 1] - off[i]).astype(np.int64)
            i = j


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow for a function that turns a batch into column dictionaries."""
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True) for x, f in ((columns[f.name], f) for f in types)], schema=types)

    return df.mapInArrow(run, schema)
