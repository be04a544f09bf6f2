"""Token counts under a unigram language model, by dynamic programming shared along a trie of distinct pre-tokens.

A text is cut at white space (U+0009 to U+000D and the space); every piece, with the vocabulary's word mark in front, is a pre-token. The segmentation of a
pre-token is the one of the highest sum of log probabilities; of equal sums the one of fewer tokens. A character that the vocabulary lacks costs one byte token for each of its UTF-8 bytes.

The distinct pre-tokens of a batch are walked in sorted order, which is a depth-first walk of their trie: the forward scores of a prefix stay on a
stack and are computed once for all pre-tokens that share it. The count at a terminal is kept, so a pre-token that comes again, in this or a later batch of the same worker, costs
a dictionary look-up. The store is emptied when it is full, which changes no result.

The model. The pieces are those of a SentencePiece file, whose own scores are ranks of merges and no probabilities. Their probabilities are fitted to the texts by expectation maximisation over best segmentations: all distinct pre-tokens of all documents, with their counts,
are segmented along the same trie on the executors; the pieces' counts, at most one row a piece, make the next probabilities (PRIOR is added to each). It starts from Zipf's law by rank and goes ROUNDS rounds. The driver reads the file and ships the model; executors need no file.

Cases. Null and empty texts have no tokens. Very long texts and pre-tokens are whole; time is linear in their length. Repeated rows are counted each. An empty table gives an empty result. Columns other than the text pass through count() unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm.cluster import checkpoint, fresh, read
from plumbago.llm.text import arrow_schema

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
ROUNDS, PRIOR = 2, 0.1
#: The key under which byte tokens are counted.
BYTES = ""
#: Pre-tokens whose counts a worker keeps.
KEPT = 700_000


class Unigram:
    """Log probabilities of pieces, and of a single byte."""

    def __init__(self, logp: dict[str, float], byte_logp: float):
        self.logp, self.byte_logp = logp, byte_logp
        self._ready()

    def _ready(self) -> None:
        #: Every prefix of a piece; the log probability where it is a piece itself.
        self.prefixes: dict[str, float | None] = {p[:k]: None for p in self.logp for k in range(1, len(p) + 1)} | self.logp
        self.kept: dict[str, int] = {}

    def __getstate__(self) -> tuple:
        return self.logp, self.byte_logp

    def __setstate__(self, state: tuple) -> None:
        self.logp, self.byte_logp = state
        self._ready()

    @classmethod
    def of_model(cls, path: str = MODEL) -> Unigram:
        """The pieces of a file, by Zipf's law."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        logp = {sp.id_to_piece(i): -math.log(k + 2.7) for k, i in enumerate(plain)}
        return cls(logp, -math.log(len(plain) + 2.7) - 10)

    def fitted(self, counts: dict[str, int]) -> Unigram:
        """The same pieces with the probabilities of these counts; the 256 bytes share theirs alike."""
        total = math.log(sum(counts.values()) + PRIOR * (len(self.logp) + 256))
        return Unigram({p: math.log(counts.get(p, 0) + PRIOR) - total for p in self.logp}, math.log(counts.get(BYTES, 0) / 256 + PRIOR) - total)

    def _walk(self, words: Iterable[str], at_end: Callable[[str, int, list[int]], None]) -> None:
        """Forward scores of sorted pre-tokens in one walk of their trie: at_end(pre-token, tokens, where the last piece of each prefix begins)."""
        prefixes, none = self.prefixes, -1.0
        best, tokens, starts, back, last = [0.0], [0], [[]], [0], ""  # starts: where pieces that reach this depth, or go on beyond it, may begin
        for w in words:
            depth, n = 0, min(len(last), len(w))
            while depth < n and last[depth] == w[depth]:
                depth += 1
            del best[depth + 1 :], tokens[depth + 1 :], starts[depth + 1 :], back[depth + 1 :]
            for i in range(depth + 1, len(w) + 1):
                c = w[i - 1]
                p, alive, begin = prefixes.get(c, none), [], i - 1
                if p is None or p is none:
                    k = len(c.encode("utf-8", "surrogatepass"))
                    top, fewest = best[i - 1] + k * self.byte_logp, tokens[i - 1] + k
                else:
                    top, fewest = best[i - 1] + p, tokens[i - 1] + 1
                for j in starts[i - 1]:
                    q = prefixes.get(w[j:i], none)
                    if q is not none:
                        alive.append(j)
                        if q is not None:
                            q += best[j]
                            if q > top or q == top and tokens[j] + 1 < fewest:
                                top, fewest, begin = q, tokens[j] + 1, j
                if p is not none:
                    alive.append(i - 1)
                best.append(top)
                tokens.append(fewest)
                starts.append(alive)
                back.append(begin)
            at_end(w, tokens[len(w)], back)
            last = w

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct pre-token."""
        out: dict[str, int] = {}
        self._walk(sorted(words), lambda w, n, back: out.__setitem__(w, n))
        return out

    def pieces(self, words: dict[str, int]) -> Counter:
        """How often each piece, and a byte, stands in the best segmentations of pre-tokens that occur so many times."""
        out: Counter = Counter()

        def at_end(w: str, n: int, back: list[int]) -> None:
            i, times = len(w), words[w]
            while i:
                piece, i = w[back[i] : i], back[i]
                if piece in self.logp:
                    out[piece] += times
                else:
                    out[BYTES] += times * len(piece.encode("utf-8", "surrogatepass"))

        self._walk(sorted(words), at_end)
        return out

    def totals(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text; one trie for all pre-tokens of these texts that have no count yet."""
        kept = self.kept
        cut = [PIECE.findall(text) if text else [] for text in texts]
        words = {w for c in cut for w in c}
        new = [MARK + w for w in words if w not in kept]
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = [MARK + w for w in words]
        kept.update((w[1:], k) for w, k in self.counts(new).items())
        return [sum(map(kept.__getitem__, c)) for c in cut], [len(c) for c in cut]


def fit(docs: DataFrame, start: Unigram, rounds: int = ROUNDS) -> Unigram:
    """The model with probabilities fitted to all texts."""
    cut = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(PIECE.pattern), F.lit(0))).alias("w"))
    words = checkpoint(cut.groupBy("w").agg(F.count("*").alias("n")).sortWithinPartitions("w"))
    model = start
    for _ in range(rounds):
        told = docs.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                total.update(told.value.pieces({MARK + w: n for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["piece", "n"])

        model = model.fitted({r.piece: r.n for r in words.mapInArrow(work, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()})  # at most a row a piece
    return model


def _groups(column: pa.Array, chars: int = 4 << 20) -> Iterator[list[str | None]]:
    """Texts in groups of bounded size, so that a trie is shared by many texts and memory stays bounded."""
    held, size = [], 0
    for x in column:
        text = x.as_py()
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame, model: Unigram, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default), n_tokens and n_pretokens."""
    keep = docs.columns if keep is None else keep
    held = docs.select(*keep)
    names = [fresh(held, "n_tokens"), fresh(held, "n_pretokens")]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in names)])
    types = arrow_schema(schema)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, pieces = [], []
            for group in _groups(batch.column(len(keep))):
                t, p = told.value.totals(group)
                tokens += t
                pieces += p
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(types.field(c).type) for c in range(len(keep))), pa.array(tokens, pa.int64()), pa.array(pieces, pa.int64())], schema=types)

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "counted"))).mapInArrow(work, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count(docs, fit(docs, Unigram.of_model(path)), ["doc_id"])
