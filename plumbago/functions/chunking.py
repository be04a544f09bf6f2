"""The chunker: tables apart, paragraphs packed greedily, large paragraphs by sentences, overlap carried over.

A paragraph is added while buffer and paragraph fit (its line end isn't counted); a sentence too long for a chunk is kept whole; the overlap is the
end of the buffer, cut after its first sentence mark. Chunks are then put in the order in which their first 50 code points occur in the text; those that don't occur, as their paragraphs
were joined, come last in the order in which they were made. Tables below the least size are dropped from the text and from the chunks unless asked for.

Every step depends on the buffer that the last one left, and grown arrays are copied at each step of a fold on the JVM; so texts go to Python in Arrow batches, where a text takes time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile("[。！？；]")
_SENTENCE = re.compile("(?<=[。！？；\n])")
_PARAGRAPH = re.compile(r"\n\s*\n")
#: The place of a chunk that isn't found in the text, and the code points by which a chunk is looked for.
LAST, HEAD = 999999, 50
#: Beyond this product of chunks and text, places are found in one pass along the text.
_MANY = 1 << 24
_KEY = 16


def overlap(buffer: str, carry: int) -> str:
    """The end of a buffer that the next chunk begins with."""
    if len(buffer) <= carry:
        return buffer
    tail = buffer[-carry:]
    m = _MARK.search(tail)
    return tail[m.end() :] if m else tail


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with its mark; a blank rest without one is dropped."""
    parts = _SENTENCE.split(text)
    return parts if parts[-1].strip() else parts[:-1]


def packed(parts: Iterator[str], size: int, carry: int) -> Iterator[str]:
    """Chunks of sentences."""
    buffer = ""
    for s in parts:
        if buffer and len(buffer) + len(s) > size:
            yield buffer
            buffer = overlap(buffer, carry)
        buffer += s
    yield buffer


def paragraphs(text: str, size: int, carry: int) -> Iterator[str]:
    """Chunks of a text without tables, blank ones included."""
    buffer = ""
    for p in (x.strip() for x in _PARAGRAPH.split(text)):
        if not p:
            continue
        if len(buffer) + len(p) <= size:
            buffer += p + "\n"
            continue
        yield buffer
        if len(p) > size:
            yield from packed(iter(sentences(p)), size, carry)
            buffer = ""
        else:
            buffer = overlap(buffer, carry) + p + "\n"
    yield buffer


def tables(text: str) -> list[str]:
    """The maximal runs of lines that begin and end with a bar."""
    if "|" not in text:
        return []
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        s = line.strip()
        if len(s) > 1 and s[0] == s[-1] == "|":
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return out


def _places(text: str, heads: list[str]) -> list[int]:
    """Where each head first occurs in the text, or LAST."""
    if len(heads) * len(text) <= _MANY:
        return [at if (at := text.find(h)) >= 0 else LAST for h in heads]
    wanted: dict[str, set[str]] = {}
    for h in heads:
        wanted.setdefault(h[:_KEY], set()).add(h)
    found = {h: text.find(h) for h in heads if len(h) < _KEY}
    for i in range(len(text) - _KEY + 1):
        for h in wanted.get(text[i : i + _KEY], ()):
            if h not in found and text.startswith(h, i):
                found[h] = i
    return [at if (at := found.get(h, -1)) >= 0 else LAST for h in heads]


def cut(text: str | None, size: int = 1000, carry: int = 200, least: int = 100, drop_small_tables: bool = True) -> list[tuple[str, int, bool]]:
    """Content, index (as made) and whether it is a table of a text's chunks, in the order of the source."""
    if text is None or not text.strip():
        return []
    grids = tables(text)
    rest = text
    for g in dict.fromkeys(grids):
        rest = rest.replace(g, "")
    made = [(g, True) for g in (x.strip() for x in grids) if len(g) >= (least if drop_small_tables else 1)]
    made += [(c, False) for c in (x.strip() for x in paragraphs(rest, size, carry)) if c]
    order = sorted(range(len(made)), key=_places(text, [c[:HEAD] for c, _ in made]).__getitem__)
    return [(made[k][0], k, made[k][1]) for k in order]


def chunks(column: str, size: int = 1000, carry: int = 200, least: int = 100, drop_small_tables: bool = True) -> Column:
    """Chunks of a text column: an array of content, index (as made) and is_table, in the order of the source. Null and blank texts have none."""

    @F.pandas_udf("array<struct<content:string,index:int,is_table:boolean>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"content": c, "index": k, "is_table": t} for c, k, t in cut(x, size, carry, least, drop_small_tables)])

    return of(F.col(f"`{column}`"))
