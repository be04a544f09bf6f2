"""Secret scans: an Aho-Corasick automaton of keywords, anchored regular expressions at its hits only, then embedded checksums.

Kinds, in the order in which spans that begin together are listed:

* assign: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, the keyword in either case, a value of 8 characters or more;
* access: ``AKIA[A-Z0-9]+`` of 16 characters or more;
* hex: ``[0-9a-f]+`` of 32 characters or more. Such a run has no keyword; it is looked for only around aligned 16-character blocks that are hexadecimal throughout, of which every run of 32 holds one;
* checked: tokens that embed a checksum (``ghp_``, ``gho_``, ``ghu_``, ``ghs_``, ``ghr_``, ``npm_``, then 30 characters and the CRC-32 of these in six base-62 digits). They are reported only if the checksum holds.

Matches of a kind are the leftmost, non-overlapping ones of its expression; those that fail a length or checksum are dropped and not retried.

Cases. A null text is empty and has no spans. Offsets count code points, the end is exclusive. Very long texts are whole; the expressions take linear time. Repeated
rows are scanned each. Columns other than the text pass through find() unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm.arrays import apart, replaced
from plumbago.llm.cluster import fresh, read
from plumbago.llm.text import arrow_schema

KINDS = ("assign", "access", "hex", "checked")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")}
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_automaton: list = []


def automaton():
    """The keywords, lower-cased; built once a worker."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in _WORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def checksum(body: str) -> str:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def _anchored(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """Where a match that begins at this place ends, and whether it holds."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= 8) if (m := ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= 16) if (m := ACCESS.match(text, at)) else None
    return (m.end(), checksum(m[2]) == m[3]) if (m := CHECKED.match(text, at)) else None


def _hex_runs(raw: bytes, text: str) -> list[tuple[int, int]]:
    """Runs of 32 or more, by probing aligned blocks."""
    codes = np.frombuffer(raw, np.uint8)
    n = len(codes) // 16 * 16
    probe = np.flatnonzero(_HEX_BYTE[codes[:n:16]] & _HEX_BYTE[codes[15:n:16]] & _HEX_BYTE[codes[7:n:16]])  # few blocks pass three of their bytes
    out, end, seen, chars = [], 0, 0, 0  # code points are counted once along the text
    for b in probe.tolist():
        at = 16 * b
        if at < end or not _HEX_BYTE[codes[at : at + 16]].all():
            continue
        while at > end and _HEX_BYTE[codes[at - 1]]:
            at -= 1
        chars += at - seen if len(raw) == len(text) else len(raw[seen:at].decode("utf-8", "surrogatepass"))
        seen, at_text = at, chars
        end_text = HEX.match(text, at_text).end()
        end = at + end_text - at_text
        if end - at >= 32:
            out.append((at_text, end_text))
    return out


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, in the order in which they are listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower() if len(raw) == len(text) else raw.lower().decode("utf-8", "surrogatepass")  # bytes.lower() is for A-Z alone
    out, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted({(e - n + 1, kind) for e, (kind, n) in automaton().iter(low)})
    for at, kind in hits:
        if at >= ends[kind] and (m := _anchored(kind, text, at)):
            ends[kind] = m[0]
            if m[1]:
                out.append((at, KINDS.index(kind), m[0]))
    out += [(a, 2, b) for a, b in _hex_runs(raw, text)]
    out.sort()
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and ``secrets``: an array of kind, start, end."""
    keep = docs.columns if keep is None else keep
    name = "secrets" if "secrets" not in [c.lower() for c in keep] else fresh(docs, "secrets")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.ArrayType(_SPAN))])
    types = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(x.as_py())] for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(types.field(c).type) for c in range(len(keep))), pa.array(rows, types.field(name).type)], schema=types)

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "scanned"))).mapInArrow(work, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with ``[KIND]`` in the place of every secret; of spans that overlap, the one that begins first is named."""
    found = find(docs)
    f, spans = found.columns[-1], fresh(found, "spans")
    marked = f"transform({f}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))"
    marked = found.withColumn(spans, F.expr(apart(marked)))
    return marked.withColumn("text", F.when(F.size(spans) > 0, F.expr(replaced("text", spans, "concat('[', upper(s.kind), ']')"))).otherwise(F.col("text"))).select(*docs.columns)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def _either(word: str) -> str:
    """A word whose ASCII letters stand in either case, and no other letter that folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_PLAIN = {
    "assign": "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "checked": "(?:gh[pousr]|npm)_[0-9A-Za-z]+",
}
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(substr(v, 5, 30), ''), lambda c: ord(c)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::ubigint)), lambda x, k: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""

#: The result by plain expressions over whole texts, with the checksum worked out bit by bit.
SQL = (
    "with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),\nf as ("
    + " union all ".join(f"select rid, '{k}' as kind, {n} as place, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as g from d" for n, (k, p) in enumerate(_PLAIN.items()))
    + r"""),
u as (select rid, kind, place, unnest(m) as v, unnest(list_slice(g, 1, len(m))) as g, generate_subscripts(m, 1) as i from f where len(m) > 0),
y as (select rid, kind, place, v, cast(sum(length(g) + length(v)) over (partition by rid, kind order by i) as bigint) as e from u),
c as (select *, """
    + _CRC
    + f""" as crc from y where kind = 'checked' and length(v) = 40),
b as (
  select rid, kind, place, e - length(v) as s, e from y
  where kind = 'assign' and length(regexp_replace(v, '^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?', '')) >= 8 or kind = 'access' and length(v) >= 16 or kind = 'hex' and length(v) >= 32
  union all select rid, kind, place, e - length(v), e from c where substr(v, 35, 6) = array_to_string(list_transform(range(5, -1, -1), lambda k: substr('{_DIGITS}', cast((crc // pow(62, k)::ubigint) % 62 as int) + 1, 1)), '')
), r as (
  select rid, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (kind <> 'checked') as base,
         """
    + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    + " from b group by rid)\nselect doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)
    + ", sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join r using (rid)"
)
