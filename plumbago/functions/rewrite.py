"""Colloquial questions rewritten to the terms of the standards, as one fold over a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions.text import blank, strip

#: Colloquial form and standard term, applied in this order.
TERMS = [
    ("怎么检", "检测方法"),
    ("怎么测", "检测方法"),
    ("怎么取样", "取样方法"),
    ("取样方法", "取样方法"),
    ("检测频率", "检测频率"),
    ("检测周期", "检测频率"),
    ("多久检一次", "检测频率"),
    ("检测项目", "检测项目"),
    ("检什么", "检测项目"),
    ("有哪些检测", "检测项目"),
    ("压实度", "压实度"),
    ("压实", "压实度"),
    ("含水率", "含水率"),
    ("含水量", "含水率"),
    ("强度", "强度"),
    ("抗压强度", "抗压强度"),
    ("抗折强度", "抗折强度"),
    ("坍落度", "坍落度"),
    ("塌落度", "坍落度"),
    ("粉煤灰", "粉煤灰"),
    ("水泥", "水泥"),
    ("混凝土", "混凝土"),
    ("钢筋", "钢筋"),
    ("钢绞线", "钢绞线"),
    ("锚具", "锚具"),
    ("集料", "集料"),
    ("碎石", "粗集料"),
    ("砂", "细集料"),
    ("沥青", "沥青"),
    ("路基", "路基"),
    ("路面", "路面"),
    ("桥梁", "桥梁"),
    ("隧道", "隧道"),
    ("地基", "地基"),
    ("桩基", "桩基"),
    ("块体密度", "块体密度试验"),
    ("密度试验", "密度试验"),
    ("击实试验", "击实试验"),
    ("CBR", "CBR试验"),
    ("cbr", "CBR试验"),
    ("液限塑限", "液限塑限试验"),
    ("颗粒分析", "颗粒分析试验"),
]
#: Fillers that are removed, in this order.
FILLERS = ["请问", "我想知道", "帮我查一下", "查一下", "告诉我"]
#: How a question ends and what that becomes; the first that matches is applied.
SENTENCES = [("是多少", "检测频率"), ("怎么[做搞测检]", "检测方法"), ("有哪些", "检测项目"), ("包括哪些", "检测项目")]
#: Keywords of the standards.
KEYWORDS = ["JTG", "GB", "DB", "JT/T", "规范", "标准", "规程", "公路工程", "质量检验", "试验检测", "检测频率"]


def _terms(c: Column) -> Column:
    table = F.array(*(F.struct(F.lit(a).alias("said"), F.lit(b).alias("term")) for a, b in TERMS))
    return F.aggregate(table, c, lambda acc, p: F.when(F.contains(acc, p["said"]) & ~F.contains(acc, p["term"]), F.replace(acc, p["said"], p["term"])).otherwise(acc))


def _sentence(c: Column) -> Column:
    plain = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), FILLERS, c)
    ends = lambda tail: f"(?d)^(.+?){tail}[？?]?$"
    chosen = reduce(lambda rest, p: F.when(F.rlike(plain, F.lit(ends(p[0]))), F.regexp_replace(plain, F.lit(ends(p[0])), F.lit(f"$1{p[1]}"))).otherwise(rest), reversed(SENTENCES), plain)
    return strip(chosen)


def rewrite(c: Column) -> Column:
    """The rewritten question; a blank one stays as it is."""
    return F.when(blank(c), c).otherwise(_sentence(_terms(strip(c))))


def variants(c: Column) -> Column:
    """The question and its rewriting, once if they are equal."""
    return F.array_distinct(F.array(c, rewrite(c)))


def keywords(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(c, k))


def accepted(rewritten: Column, question: Column) -> Column:
    """A rewriting by a language model, if it isn't blank and is shorter than twice the question."""
    return F.when(~blank(rewritten) & (F.length(rewritten) < 2 * F.length(question)), strip(rewritten)).otherwise(question)
