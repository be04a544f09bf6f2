"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy, scoring all overlapping windows.

A text is cut into windows of WINDOW words that begin every STRIDE words and cover it whole; the last one is aligned with the end. A word enters as the learned vector of its vocabulary entry (all other words share one) beside what learned filters over its
characters find: each filter reads SPAN bytes in a row, ends marked, at all places of the word, and its best place counts. So words never seen are judged by how they are spelt. Two gated recurrent layers read the window forwards and backwards; attention weighs
their joined states, and a logistic unit scores the pooled state. The score of a text is that of its highest window after a logistic calibration.

Fitting. All vectors and filters start at random and are learned through the network. Labels say only that a document is toxic, not where. The first windows to learn from are those in which a word, or the beginning of one, has the highest log odds of a toxic document, of each
document, toxic or clean, with random clean windows, and some texts of random letters count as clean, so that what was never seen isn't taken for toxic; the log odds choose windows and are no inputs. Later rounds take the windows that the network itself ranks first. Gradients go through time in both directions and into the filters (Adam), a share of words being read by their characters alone at each step. At most
labelled.SAMPLE documents that aren't held out are used; labels, language, source and doc_id are never inputs. The vocabulary is the words of at least MIN_DOCS of them.

Cost. The input part of all gates is computed once for each distinct word of a block of text and gathered for its occurrences, so characters are read once a distinct word.

Cases. Null, empty and wordless texts have one window of padding. Without labels of both classes the score is the smoothed share of toxic documents. Very long texts and words are whole. Repeated rows score alike. An empty table gives an empty result. Other columns pass through unchanged.
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
from plumbago.llm.text import Words, arrow_schema, blocks, mix, words_of

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM = 8, 8
#: Vectors of bytes, bytes that a filter reads, filters.
CHAR_DIM, SPAN, FILTERS = 8, 6, 24
_BEGIN, _END = 256, 257
VOCABULARY, MIN_DOCS = 30_000, 3
STEMS, STEM_BITS = (4, 5, 6, 7), 18
ROUNDS, STEPS, BATCH, RATE = 3, 80, 128, 0.02
CUT = 0.5
#: Share of words that a step reads by their characters alone, as words never seen are read later.
HIDE = 0.2
#: Labelled texts to one of random letters, learnt as clean.
NOISE = 20
#: Weight of a step in the average of parameters.
AVERAGED = 0.03
#: Distinct words whose characters are read at a time.
PART = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (-1: padding) and the text of each."""
    counts = np.diff(first)
    number = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(place * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < counts[owner, None], at + first[owner, None], -1), owner


def _characters(words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SPAN bytes at each place of some words (places x SPAN), begin marked, ends marked and padded, and the first place of each word."""
    starts, lengths = words.starts[some], words.ends[some] - words.starts[some]
    places = np.maximum(lengths + 2 - SPAN, 0) + 1
    first = np.concatenate(([0], np.cumsum(places)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], places)
    raw = np.frombuffer(words.data, np.uint8)
    size, begin = np.repeat(lengths, places), np.repeat(starts, places)
    out = np.empty((first[-1], SPAN), np.int16)
    for k in range(SPAN):
        i = at + k - 1
        out[:, k] = np.where(i < 0, np.int16(_BEGIN), np.where(i < size, raw[np.clip(begin + i, 0, max(len(raw) - 1, 0))] if len(raw) else np.int16(0), np.int16(_END)))
    return out, first


def _stems(words: Words, some: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the first bytes of words (words x len(STEMS)); 0 for shorter words."""
    starts, ends = (words.starts, words.ends) if some is None else (words.starts[some], words.ends[some])
    raw = np.frombuffer(words.data, np.uint8)
    out, code = np.zeros((len(starts), len(STEMS)), np.int32), np.zeros(len(starts), np.uint64)
    for k in range(max(STEMS) if len(raw) else 0):
        code = mix(code * np.uint64(0x100) + raw[np.minimum(starts + k, len(raw) - 1)])
        if k + 1 in STEMS:
            out[:, STEMS.index(k + 1)] = np.where(ends - starts > k, (code >> np.uint64(64 - STEM_BITS)).astype(np.int32), 0)
    return out


def _scatter(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by index."""
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


class Network:
    """Parameters and both passes. Gates are ordered z, r, n; both directions are stacked on the first axis."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 4):
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + FILTERS
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes
        word = rng.normal(0, 0.1, (len(vocabulary) + 2, WORD_DIM)).astype(np.float32)  # the last two: any other word, padding
        word[-1] = 0
        self.p = {"word": word, "char": rng.normal(0, 0.5, (258, CHAR_DIM)).astype(np.float32), "filter": draw(SPAN, CHAR_DIM, FILTERS), "level": np.zeros(FILTERS, np.float32), "w": draw(2, inputs, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN), "att": draw(2 * HIDDEN) * 0.1, "out": draw(2 * HIDDEN) * 0.3, "bias": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0)
        self.constant: float | None = None

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary rows of words."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == n] = 0
        return np.where(self.vocabulary[at] == hashes, at, n)

    def forward(self, x: np.ndarray, valid: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; x(t): gates' input parts, (2, windows, 3 HIDDEN), for both directions at step t of each. Padded steps leave the state as it is."""
        n, steps = valid.shape
        u, h = self.p["u"], np.zeros((2, n, HIDDEN), np.float32)
        states, kept = np.empty((2, steps, n, HIDDEN), np.float32), []
        full = valid.all()
        for t in range(steps):
            pre = x(t)
            hu = h @ u
            zr = _sigmoid(pre[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(pre[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            ok = None
            if not full:
                ok = np.stack([valid[:, t], valid[:, steps - 1 - t]])[..., None]
                new = np.where(ok, new, h)
            if keep:
                kept.append((h, hu, z, r, c, ok))
            h = new
            states[0, t] = h[0]
            states[1, steps - 1 - t] = h[1]
        joined = np.concatenate([states[0], states[1]], axis=-1)  # steps, windows, 2 HIDDEN
        e = np.where(valid.T, joined @ self.p["att"], -30.0)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, joined)
        return pooled @ self.p["out"] + self.p["bias"][0], {"joined": joined, "a": a, "pooled": pooled, "kept": kept}

    def backward(self, d: np.ndarray, memo: dict) -> tuple[dict, np.ndarray]:
        """Gradients by parameter of forward(), and of the gates' input parts (steps as read by each direction, 2, windows, 3 HIDDEN)."""
        p, a, joined = self.p, memo["a"], memo["joined"]
        g = {"out": memo["pooled"].T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        da = np.einsum("tnh,nh->tn", joined, dp)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", de, joined)
        dj = a[..., None] * dp + de[..., None] * p["att"]
        steps = len(a)
        g["u"] = np.zeros_like(p["u"])
        dx = np.empty((steps, 2, len(d), 3 * HIDDEN), np.float32)
        dh = np.zeros((2, len(d), HIDDEN), np.float32)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, hu, z, r, c, ok = memo["kept"][t]
            dh = dh + np.stack([dj[t, :, :HIDDEN], dj[steps - 1 - t, :, HIDDEN:]])
            live = dh if ok is None else np.where(ok, dh, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (h - c) * z * (1 - z)
            dr = dc * hu[..., 2 * HIDDEN :] * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], -1)
            dhu = np.concatenate([dz, dr, dc * r], -1)
            g["u"] += h.transpose(0, 2, 1) @ dhu
            dh = live * z + dhu @ ut + (0 if ok is None else np.where(ok, 0, dh))
        return g, dx

    def spelt(self, words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the filters find in some words (words x FILTERS), with the bytes and values at all places and the first place of each word."""
        table = np.einsum("cd,kdf->kcf", self.p["char"], self.p["filter"])
        codes, first = _characters(words, some)
        value = np.tile(self.p["level"], (len(codes), 1))
        for k in range(SPAN):
            value += table[k][codes[:, k]]
        best = np.maximum.reduceat(value, first[:-1]) if len(some) else np.zeros((0, FILTERS), np.float32)
        return np.tanh(best), codes, value, first

    def inputs(self, words: Words, some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Vectors of some words, a part at a time."""
        out = np.empty((len(some), WORD_DIM + FILTERS), np.float32)
        out[:, :WORD_DIM] = self.p["word"][rows]
        for i in range(0, len(some), PART):
            out[i : i + PART, WORD_DIM:] = self.spelt(words, some[i : i + PART])[0]
        return out

    def learn_spelling(self, d: np.ndarray, found: tuple) -> dict:
        """Gradients of the filters, their levels and the bytes' vectors: each filter's best place in a word takes them."""
        out, codes, value, first = found
        d = d * (1 - out * out)
        owner = np.repeat(np.arange(len(out)), np.diff(first))
        at, f = np.nonzero(value == np.maximum.reduceat(value, first[:-1])[owner])
        _, one = np.unique(owner[at] * FILTERS + f, return_index=True)  # the first of equal places
        at, f = at[one], f[one]
        part = d[owner[at], f]
        table = np.stack([np.bincount(codes[at, k].astype(np.int64) * FILTERS + f, part, 258 * FILTERS).reshape(258, FILTERS) for k in range(SPAN)])
        return {"level": d.sum(0), "char": np.einsum("kcf,kdf->cd", table, self.p["filter"]).astype(np.float32), "filter": np.einsum("kcf,cd->kdf", table, self.p["char"]).astype(np.float32)}

    def logits(self, data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit of every window, its text, and the words' numbers of it."""
        words = words_of(data, off)
        at, owner = windows(words.first)
        hashes, place, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        x = self.inputs(words, place, self.rows(hashes))
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])  # padding
        gates = np.stack([x @ self.p["w"][k] + self.p["b"][k] for k in (0, 1)])
        back = np.append(back, len(hashes))
        out = np.empty(len(at))
        for i in range(0, len(at), 4096):
            index = np.ascontiguousarray(back[at[i : i + 4096]].T)
            step = lambda t, index=index: np.stack([gates[0][index[t]], gates[1][index[WINDOW - 1 - t]]])
            out[i : i + 4096] = self.forward(step, at[i : i + 4096] >= 0)[0]
        return out, owner, at

    def scores(self, data: bytes, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        logit, owner, _ = self.logits(data, off)
        top = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(off) - 1)))
        return _sigmoid(self.calibration[0] * top + self.calibration[1])


def _log_odds(h: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values that MIN_DOCS texts have (sorted), the clipped log odds of a toxic text for each, and the number of texts with it."""
    order = np.lexsort((owner, h))
    hs, own = h[order], owner[order]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (own[1:] != own[:-1]))) if len(hs) else np.zeros(0, bool)
    values, index = np.unique(hs[new], return_inverse=True)
    toxic = np.bincount(index, y[own[new]], len(values))
    docs = np.bincount(index, minlength=len(values))
    keep = np.flatnonzero(docs >= MIN_DOCS)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = 4 * share
    odds = np.log((toxic[keep] + prior) / (docs[keep] - toxic[keep] + 4 - prior)) - np.log(share / (1 - share))
    return values[keep], np.clip(odds, -3, 5).astype(np.float32), docs[keep]


def _unheard(n: int, rng: np.random.Generator) -> pa.Array:
    """Texts of words of random letters: to be unheard of is no sign of toxicity."""
    words = lambda: (rng.integers(97, 123, rng.integers(1, 12)).astype(np.uint8).tobytes().decode() for _ in range(rng.integers(1, 2 * WINDOW)))
    return pa.array([" ".join(words()) for _ in range(n)], pa.large_string())


def fit(texts: pa.Array, labels: list[int], seed: int = 4) -> Network:
    y = np.array(labels, np.int64)
    if not 0 < y.sum() < len(y):
        net = Network(np.zeros(0, np.uint64))
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    noise = _unheard(max(16, len(y) // NOISE), np.random.default_rng(seed + 1))
    texts, y = pa.concat_arrays([texts.cast(pa.large_string()), noise]), np.append(y, np.zeros(len(noise), np.int64))
    column = texts
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, off = bytes(memoryview(column.buffers()[2])[off[0] : off[-1]]), off - off[0]  # bounded by the sample
    words = words_of(data, off)
    hashes, owner, buckets = words.hashes(), words.owner, _stems(words)
    vocabulary, odds, docs = _log_odds(hashes, owner, y)
    keep = np.sort(np.argsort(-docs, kind="stable")[:VOCABULARY])
    vocabulary, odds = vocabulary[keep], odds[keep]
    stems = np.zeros((1 << STEM_BITS, len(STEMS)), np.float32)
    for k in range(len(STEMS)):
        values, by_stem, _ = _log_odds(buckets[:, k], owner, y)
        stems[values, k] = by_stem
    stems[0] = 0
    net = Network(vocabulary, seed)
    rows = net.rows(hashes)
    at, owner = windows(words.first)
    first = np.searchsorted(owner, np.arange(len(y)))
    value = np.maximum(np.append(odds, [0, 0])[rows], stems[buckets, np.arange(len(STEMS))].max(1))
    rank = np.where(at >= 0, np.append(value, 0)[at], -9).max(1)
    del hashes, buckets, value
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, mean = 0, None
    for turn in range(ROUNDS):
        best = np.lexsort((-rank, owner))[first]  # each text's first by rank
        some = np.concatenate([best, rng.choice(np.flatnonzero(y[owner] == 0), len(best))])
        truth = y[owner[some]].astype(np.float32)
        for _ in range(max(2, STEPS * BATCH // len(some))):
            order = rng.permutation(len(some))
            for k in range(0, len(some), BATCH):
                step += 1
                _learn(net, words, rows, at[some[order[k : k + BATCH]]], truth[order[k : k + BATCH]], moments, step, rng)
                if turn + 1 == ROUNDS:  # the last round's parameters are averaged
                    mean = {p: v.copy() for p, v in net.p.items()} if mean is None else {p: mean[p] + AVERAGED * (v - mean[p]) for p, v in net.p.items()}
        net.p = mean or net.p
        rank = np.concatenate([net.logits(d, o)[0] for _, _, d, o in blocks(texts)])  # in blocks, for the driver's memory
    top = np.maximum.reduceat(rank, first)
    net.calibration = _calibrate(top, y)
    return net


def _learn(net: Network, words: Words, known: np.ndarray, at: np.ndarray, truth: np.ndarray, moments: dict, step: int, rng: np.random.Generator) -> None:
    """One step of Adam on a batch of windows."""
    flat, back = np.unique(at, return_inverse=True)
    back = back.reshape(at.shape)
    pad = int(flat[0] == -1)
    some = flat[pad:]
    rows = np.where(rng.random(len(some)) < HIDE, len(net.vocabulary), known[some])
    found = net.spelt(words, some)
    x = np.concatenate([net.p["word"][rows], found[0]], 1)
    x = np.concatenate([np.zeros((pad, x.shape[1]), np.float32), x])
    gates = np.stack([x @ net.p["w"][k] + net.p["b"][k] for k in (0, 1)])
    index = back.T
    logit, memo = net.forward(lambda t: np.stack([gates[0][index[t]], gates[1][index[WINDOW - 1 - t]]]), at >= 0, keep=True)
    d = ((_sigmoid(logit) - truth) / len(truth)).astype(np.float32)
    g, dx = net.backward(d, memo)
    dg = np.stack([_scatter(index.ravel(), dx[:, 0].reshape(-1, 3 * HIDDEN), len(x)), _scatter(index[::-1].ravel(), dx[:, 1].reshape(-1, 3 * HIDDEN), len(x))])
    g["w"] = x.T[None] @ dg
    g["b"] = dg.sum(1)
    din = (dg[0] @ net.p["w"][0].T + dg[1] @ net.p["w"][1].T)[pad:]
    g["word"] = _scatter(rows, din[:, :WORD_DIM], len(net.p["word"]))
    g |= net.learn_spelling(din[:, WORD_DIM:], found)
    for k, v in net.p.items():
        m, s = moments[k]
        m += 0.1 * (g[k] - m)
        s += 0.001 * (g[k] * g[k] - s)
        v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _calibrate(top: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """A logistic fit of labels to the highest logits."""
    scale, shift = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(scale * top + shift)
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * top).sum() + 0.1 * (scale - 1), (p - y).sum()])
        hess = np.array([[(w * top * top).sum() + 0.1, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - np.clip(move[0], -0.5, 0.5), shift - np.clip(move[1], -1, 1)
        if abs(move).max() < 1e-6:
            break
    return float(scale), float(shift)


def score(docs: DataFrame, model: Network, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and ``score``."""
    keep = docs.columns if keep is None else keep
    name = "score" if "score" not in [c.lower() for c in keep] else fresh(docs, "score")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    types = arrow_schema(schema)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in blocks(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).cast(types.field(c).type) for c in range(len(keep))), pa.array(told.value.scores(data, off), pa.float64())], schema=types)

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "scored"))).mapInArrow(work, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below CUT, with their columns as they are."""
    scored = score(docs, fit(*labelled.sample(docs, labels, "toxic")))
    return scored.filter(F.col(scored.columns[-1]) < CUT).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*labelled.sample(docs, read(spark, sf_dir, "labels"), "toxic"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
