"""Text primitives as Catalyst expressions. White space means what Unicode calls so, U+001C to U+001F included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

#: What cleaning removes, in this order: heading marks to the end of their line, bold, italics, links, fenced code, runs of white space. All take linear time: where a line's first bracket begins no link, none does, and the rest of the line is
#: kept in one step.
CLEANING = ((r"#[^\n]*+\n", "\n"), (r"\*\*|__", ""), (r"\*|_", ""), (r"\[(?>[^\n]*?\]\()[^\n]*?\)|(\[[^\n]*+)", "$1"), (r"(?s)```.*?```", ""), (rf"(?U){WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}++|(?<!{WS}){WS}++$", "")  # the look-behind keeps runs inside the text from being tried at each of their places


def blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def clean_markdown(c: Column) -> Column:
    last = F.substring_index(c, "\n", -1)  # a line without an end has no heading; left out of the search, which is linear then
    head = F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - F.length(last)), F.lit(CLEANING[0][0]), F.lit(CLEANING[0][1]))
    return strip(reduce(lambda acc, rule: F.regexp_replace(acc, F.lit(rule[0]), F.lit(rule[1])), CLEANING[1:], F.concat(head, last)))


def id16(c: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5."""
    return F.substring(F.md5(c), 1, 16)


def doc_id(file_name: Column) -> Column:
    return id16(file_name)


def doc_name(file_name: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def chunk_id(doc: Column, index: Column) -> Column:
    return id16(F.concat_ws("_", doc, index.cast("string")))


def pages(c: Column, size: int = 1000) -> Column:
    """Slices of ``size`` code points as an array of (page, content), blank ones left out but counted."""
    n = F.ceil(F.length(c) / size).cast("int")
    slices = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda p: F.struct(p.alias("page"), F.substring(c, (p - 1) * size + 1, F.lit(size)).alias("content")))
    return F.filter(slices, lambda s: ~blank(s["content"]))


def snippet(c: Column, size: int = 500) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def source_label(source_type: Column, name: Column, page: Column, section: Column, url: Column) -> Column:
    """How a source is named in a context block. Its words and their order."""
    local = F.concat_ws(" - ", name, F.when(page != 0, F.concat(F.lit("第"), page.cast("string"), F.lit("页"))), F.when(section != "", F.concat(F.lit("第"), section, F.lit("节"))))
    return F.when(source_type == "web", F.concat(F.lit("网络来源: "), F.coalesce(name, F.lit("")), F.lit(" ("), F.coalesce(url, F.lit("None")), F.lit(")"))).otherwise(local)


def truncate(c: Column, limit: int = 8000, least: float = 0.7) -> Column:
    """At most ``limit`` code points, cut back to the last full stop or line end if that lies in the last part, and stripped."""
    head = F.substring(c, 1, limit)
    last = lambda mark: F.when(F.instr(head, mark) > 0, limit - F.locate(mark, F.reverse(head)) + 1).otherwise(0)
    cut = F.greatest(last("。"), last("\n"))  # one-based place of the mark
    return F.when(F.length(c) <= limit, c).otherwise(strip(F.when(cut - 1 > limit * least, F.substring(head, F.lit(1), cut)).otherwise(head)))


def cache_key(question: Column, web: Column) -> Column:
    return F.md5(F.concat(question, F.lit(":"), F.when(web, "True").otherwise("False")))
