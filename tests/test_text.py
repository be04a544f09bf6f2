from __future__ import annotations

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbago.functions import chunking, rewrite, text, tokens

REWRITES = [
    ("粉煤灰检测项目有哪些", "粉煤灰检测项目检测项目"),
    ("锚具检测频率是多少", "锚具检测频率检测频率"),
    ("钢绞线取样方法", "钢绞线取样方法"),
    ("土方路基压实度检测频率", "土方路基压实度检测频率"),
    ("水泥混凝土试验规程", "水泥混凝土试验规程"),
    ("土方路基压实度检测频率是多少？", "土方路基压实度检测频率检测频率"),
    ("压实度怎么检", "压实度检测方法"),
    ("多久检一次", "检测频率"),
    ("粉煤灰检什么", "粉煤灰检测项目"),
    ("请问砂浆强度怎么做", "细集料浆强度检测方法"),
    ("碎石压实", "粗集料压实度"),
    ("cbr是多少", "CBR试验检测频率"),
    ("怎么检测压实度", "检测方法测压实度"),
    ("   ", "   "),
]
CLEANED = [("# T\n**a** _b_ [l](u) ![i](p)\n\n c　d\n```py\nx\n```\ne", "a b ! c d e"), ("a # b\nc", "a c"), ("x\n# last", "x # last"), ("snake_case 2*3", "snakecase 23")]
CHUNKED = [
    ("abcd\n\nefgh\n\nij", 8, 3, 3, [("abcd", 0, False), ("cd\nefgh", 1, False), ("gh\nij", 2, False)]),
    ("甲乙。丙丁\n\n戊己庚辛", 6, 4, 3, [("甲乙。丙丁", 0, False), ("丙丁\n戊己庚辛", 1, False)]),
    ("前文\n\n|a|b|\n|1|2|\n\n后文", 20, 4, 3, [("|a|b|\n|1|2|", 0, True), ("前文\n后文", 1, False)]),
    ("x\n\n|a|\n\ny", 20, 4, 10, [("x\ny", 0, False)]),
    ("一二三四五。六七。八", 4, 2, 3, [("一二三四五。", 0, False), ("六七。八", 1, False)]),
    ("  \n ", 4, 2, 3, []),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_rewrites(spark):
    rows = spark.createDataFrame(REWRITES, "q string, want string").select("want", rewrite.rewrite(F.col("q")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_variants_keywords_and_model_rewrites(spark):
    r = spark.createDataFrame([("JTG 压实度怎么检", "ab", "x")], "q string, a string, b string").select(rewrite.variants(F.col("q")).alias("v"), rewrite.keywords(F.col("q")).alias("k"), rewrite.accepted(F.col("b"), F.col("a")).alias("short"), rewrite.accepted(F.col("q"), F.col("a")).alias("long")).first()
    assert r.v == ["JTG 压实度怎么检", "JTG 压实度检测方法"] and r.k == ["JTG"] and r.short == "x" and r.long == "ab"


@pytest.mark.parametrize("raw,want", CLEANED)
def test_cleaning(spark, raw, want):
    assert one(spark, raw, text.clean_markdown(F.col("x"))) == want


def test_cleaning_takes_linear_time(spark):
    start = time.perf_counter()
    for raw, want in (("[" * 400_000, "[" * 400_000), ("[](" * 100_000, "[](" * 100_000), ("a" + " " * 400_000 + "b", "a b"), ("[a](b" * 50_000 + ")c", None)):
        got = one(spark, raw, text.clean_markdown(F.col("x")))
        assert want is None or got == want
    assert one(spark, "x" + " " * 400_000 + "y ", text.strip(F.col("x"))) == "x" + " " * 400_000 + "y"
    assert time.perf_counter() - start < 60


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["[", "]", "(", ")", "](", "a", "\n", " ", "[b](c)"]), max_size=20).map("".join), min_size=1, max_size=20))
def test_links_as_a_plain_expression_finds_them(spark, raws):
    rows = spark.createDataFrame([(x,) for x in raws], "x string").select("x", F.regexp_replace("x", *map(F.lit, text.CLEANING[3])).alias("y")).collect()
    for r in rows:
        assert r.y == re.sub(r"\[.*?\]\(.*?\)", "", r.x)


def test_ids_pages_snippets_labels(spark):
    assert one(spark, "P020240607597845867899.md", text.doc_id(F.col("x"))) == "42bcc67347e138e2"
    assert one(spark, "a.b.md", text.doc_name(F.col("x"))) == "a.b"
    assert one(spark, "42bcc67347e138e2", text.chunk_id(F.col("x"), F.lit(0))) == "a2e3e0937bdf946e"
    assert [(p.page, len(p.content)) for p in one(spark, "a" * 1000 + " " * 1000 + "b", text.pages(F.col("x")))] == [(1, 1000), (3, 1)]
    assert one(spark, "", text.pages(F.col("x"))) == []
    assert one(spark, "a" * 500, text.snippet(F.col("x"))) == "a" * 500
    assert one(spark, "a" * 501, text.snippet(F.col("x"))) == "a" * 500 + "..."
    label = lambda *a: one(spark, "n", text.source_label(*a))
    assert label(F.lit("local"), F.col("x"), F.lit(0), F.lit(""), F.lit(None)) == "n"
    assert label(F.lit("local"), F.col("x"), F.lit(2), F.lit("3"), F.lit(None)) == "n - 第2页 - 第3节"
    assert label(F.lit("web"), F.col("x"), F.lit(2), F.lit("3"), F.lit("u")) == "网络来源: n (u)"
    assert one(spark, "q", text.cache_key(F.col("x"), F.lit(True))) == "ddbf14b419340ab764708ef772a605f3"
    assert one(spark, "q", text.cache_key(F.col("x"), F.lit(False))) == "d7e83ab054d86a7e8a20995400423657"


def test_truncation(spark):
    cut = lambda x: one(spark, x, text.truncate(F.col("x"), 10))
    assert cut("abc") == "abc" and cut("12345678。abcdef") == "12345678。" and cut("12。45678901234") == "12。4567890" and cut("12345678\nabcdef") == "12345678"


@pytest.mark.parametrize("raw,size,carry,least,want", CHUNKED)
def test_chunks(spark, raw, size, carry, least, want):
    assert [(c["content"], c["index"], c["is_table"]) for c in one(spark, raw, chunking.chunks("x", size, carry, least))] == want


def test_small_tables_can_stay(spark):
    got = one(spark, "x\n\n|a|\n\ny", chunking.chunks("x", 20, 4, 10, drop_small_tables=False))
    assert ("|a|", True) in [(c["content"], c["is_table"]) for c in got]


def model(x: str, size: int, carry: int, least: int) -> list[tuple[str, int, bool]]:
    """The chunker as a plain program."""
    if not x.strip():
        return []
    grids, run = [], []
    for line in [*x.split("\n"), ""]:
        s = line.strip()
        if len(s) >= 2 and s[0] == s[-1] == "|":
            run.append(line)
        elif run:
            grids.append("\n".join(run))
            run = []
    rest = x
    for g in grids:
        rest = rest.replace(g, "")
    made = [(g.strip(), True) for g in grids if len(g.strip()) >= least]
    buffer = ""

    def emit() -> None:
        if buffer.strip():
            made.append((buffer.strip(), False))

    def carried() -> str:
        if len(buffer) <= carry:
            return buffer
        tail = buffer[-carry:]
        m = re.search("[。！？；]", tail)
        return tail[m.end() :] if m else tail

    for p in (q.strip() for q in re.split(r"\n\s*\n", rest)):
        if not p:
            continue
        if len(buffer) + len(p) <= size:
            buffer += p + "\n"
            continue
        emit()
        if len(p) <= size:
            buffer = carried() + p + "\n"
            continue
        buffer = ""
        parts = re.findall("[^。！？；\n]*[。！？；\n]", p)
        tail = p[sum(map(len, parts)) :]
        for s in parts + ([tail] if tail.strip() else []):
            if len(buffer) + len(s) > size:
                emit()
                buffer = carried()
            buffer += s
        emit()
        buffer = ""
    emit()
    order = [(x.find(c[:50]) if c[:50] in x else chunking.LAST, k) for k, (c, _) in enumerate(made)]
    return [(made[k][0], k, made[k][1]) for _, k in sorted(order)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["甲乙", "丙。", "丁！", "|a|", "\n", "\n\n", " ", "xyz", "|b|c|\n"]), max_size=25).map("".join), min_size=1, max_size=8), st.integers(3, 12), st.integers(1, 6))
def test_chunks_as_the_model(spark, raws, size, carry):
    rows = spark.createDataFrame([(x,) for x in raws], "x string").select("x", chunking.chunks("x", size, carry, 3).alias("c")).collect()
    for r in rows:
        assert [(c["content"], c["index"], c["is_table"]) for c in r.c] == model(r.x, size, carry, 3)


def test_tokens(spark):
    assert one(spark, "a JTG3.5 20% of x-y", tokens.latin(F.col("x"))) == ["a", "JTG3.5", "20%", "of", "x", "y"]
    assert tokens.han_tokens("压实度的检测频率是多少") == ["压实度", "检测频率", "是多", "多少"]
    assert one(spark, "JTG 压实度 CBR", tokens.tokens(F.col("x"))) == ["JTG", "CBR", "压实度"]
    assert tokens.han_tokens(None) == []
