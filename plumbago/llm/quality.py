"""Quality classifier: learned vectors of hashed words, word n-grams and character n-grams, averaged per document, softmax output, fitted by stochastic gradient descent in numpy.

A word is a run of bytes above the space, as it is written, with its punctuation; a word like the one before it is read as a ditto mark, a word of its own without characters, so that repetition is seen in words never met. Its features are the word itself, all runs of 3, 4 and 5 characters (code points) of the word between its marks of begin and end, and the pair that it makes with the next
word. Each is hashed to one of BUCKETS vectors. The mean of a document's vectors goes through a softmax of two classes. As the mean is linear, scoring adds up one number a feature, the difference of the classes' outputs for its vector, over the whole text; the
characters of a word are read once for each distinct word of a block of text.

Fitted to at most labelled.SAMPLE documents that aren't held out; labels, language, source and doc_id are never features.

Cases. Null and empty texts have no features and score by the bias alone. Without labels, or with labels of one class only, the score is the smoothed share of label 1. Very long texts and words are whole. Repeated rows score alike. An empty table gives an empty result. Other columns pass through score() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm import labelled
from plumbago.llm.cluster import fresh, read
from plumbago.llm.text import Words, arrow_schema, blocks, grams, words_of

BITS = 18
BUCKETS = 1 << BITS
DIM = 8
EPOCHS = 3
RATE = 60.0
SIZES = (3, 4, 5)
CUT = 0.3
_SOLID = np.arange(256) > 0x20
_DITTO = np.uint64(0xD177)


class _Features:
    """The features of some texts: ``words`` are the buckets of distinct words with their character n-grams in ``grams`` (word k has those from first[k]), ``said`` the words of each text, ``pairs`` the buckets of word pairs."""

    def __init__(self, data: bytes, off: np.ndarray):
        tokens = words_of(data, off, None, _SOLID)
        h = tokens.hashes()
        same = np.flatnonzero(h[1:] == h[:-1]) + 1
        h[same[~np.isin(same, tokens.first)]] = _DITTO
        known, place, self.said = np.unique(h, return_index=True, return_inverse=True)
        self.text_first = tokens.first
        self.words = _bucket(known, 1)
        self.grams, self.first = _characters([b"" if k == _DITTO else tokens.word(i) for k, i in zip(known, place.tolist(), strict=True)])
        pairs, at = grams(h, tokens.first, 2)
        self.pairs, self.pair_first = _bucket(pairs, 2), np.searchsorted(at, tokens.first)

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text k and their share of its features."""
        words, n = np.unique(self.said[self.text_first[k] : self.text_first[k + 1]], return_counts=True)
        size = self.first[words + 1] - self.first[words]
        at = np.repeat(self.first[words] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs = self.pairs[self.pair_first[k] : self.pair_first[k + 1]]
        b, index = np.unique(np.concatenate([self.words[words], self.grams[at], pairs]), return_inverse=True)
        total = np.bincount(index, np.concatenate([n, np.repeat(n, size), np.ones(len(pairs))]), len(b))
        return b.astype(np.int32), (total / max(1, total.sum())).astype(np.float32)

    def sums(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of ``out`` over the features of each text, and their number."""
        size = np.diff(self.first)
        word = out[self.words] + _sums(out[self.grams], self.first[:-1], size)
        first, n = self.text_first[:-1], np.diff(self.text_first)
        pairs = np.diff(self.pair_first)
        return _sums(word[self.said], first, n) + _sums(out[self.pairs], self.pair_first[:-1], pairs), _sums(size[self.said] + 1, first, n) + pairs


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h * np.uint64(2 * salt + 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words between their marks, and the first of each word."""
    data = b"".join([b"\x02" + w + b"\x03" for w in words])
    raw = np.frombuffer(data, np.uint8)
    chars = np.flatnonzero((raw & 0xC0) != 0x80)  # where code points begin
    last = np.searchsorted(chars, np.cumsum([len(w) + 2 for w in words]))  # the code point after each word
    first = np.append(0, last[:-1]) if len(words) else last
    chars = np.append(chars, len(raw))
    owner = np.repeat(np.arange(len(words)), last - first)
    buckets, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in SIZES:
        at = np.flatnonzero(np.arange(len(owner)) + n <= last[owner])
        spans = Words(data, chars[at], chars[at + n], np.array([0, len(at)]))
        buckets.append(_bucket(spans.hashes(), n))
        owners.append(owner[at])
    order = np.argsort(owner_of := np.concatenate(owners), kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner_of[order], np.arange(len(words) + 1))


def _sums(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values[first:first + count]."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first + counts] - total[first]


class Quality:
    """One number a bucket, and the bias."""

    def __init__(self, out: np.ndarray, bias: float):
        self.out, self.bias = out, bias

    def scores(self, data: bytes, off: np.ndarray) -> np.ndarray:
        total, number = _Features(data, off).sums(self.out)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + self.bias, -30, 30)))


def fit(texts: pa.Array, labels: list[int], seed: int = 7) -> Quality:
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Quality(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j, data, off in blocks(texts):
        features = _Features(data, off)
        rows += [features.counted(k) for k in range(j - i)]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    head = np.zeros((2, DIM), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            b, w = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(b):
                continue
            mean = w @ vectors[b]
            logit = head @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ head
            head -= 0.02 * rate * np.outer(p, mean)
            bias -= 0.0005 * rate * p
            vectors[b] -= rate * w[:, None] * back
    return Quality((vectors @ (head[1] - head[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Quality, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and ``score``."""
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score" if "score" not in [c.lower() for c in keep] else fresh(docs, "score"), T.DoubleType())])
    types = arrow_schema(schema)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in blocks(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).cast(types.field(c).type) for c in range(len(keep))), pa.array(told.value.scores(data, off))], schema=types)

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "scored"))).mapInArrow(work, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*labelled.sample(docs, read(spark, sf_dir, "labels"), "quality"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
