"""Tokens for the lexical index: runs of Latin letters and digits natively, Han runs by longest match in a lexicon with pairs of characters for the rest."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that are never cut.
LEXICON = ["压实度", "含水率", "抗压强度", "抗折强度", "坍落度", "粉煤灰", "钢绞线", "锚具", "集料", "沥青", "路基", "路面", "桥梁", "隧道", "桩基", "检测频率", "取样方法", "检测项目", "块体密度", "击实试验", "CBR试验", "液限塑限", "JTG", "GB", "规范", "标准", "规程"]
#: Tokens that are left out.
STOP_WORDS = ["的", "了", "和", "是", "在", "有", "对", "为", "与", "及"]
LATIN = r"[A-Za-z0-9]+(?:\.[0-9]+)?%?"
_HAN = re.compile(r"[㐀-鿿豈-﫿]+")


def latin(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LATIN), 0)


def segment(run: str, lexicon: frozenset[str], longest: int) -> list[str]:
    """A run of Han characters: the longest lexicon term at each place; between terms overlapping pairs, or the single character of a gap of one."""
    out, gap, i = [], "", 0

    def flush() -> None:
        out.extend([gap[k : k + 2] for k in range(len(gap) - 1)] or ([gap] if gap else []))

    while i < len(run):
        n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in lexicon), 0)
        if n:
            flush()
            gap = ""
            out.append(run[i : i + n])
            i += n
        else:
            gap += run[i]
            i += 1
    flush()
    return out


def han_tokens(text: str | None) -> list[str]:
    terms = frozenset(t for t in LEXICON if _HAN.fullmatch(t))
    longest = max(map(len, terms))
    return [t for run in _HAN.findall(text or "") for t in segment(run, terms, longest) if len(t) > 1 and t not in STOP_WORDS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def han(texts: pd.Series) -> pd.Series:
    return texts.map(han_tokens)


def tokens(c: Column, with_han: bool = True) -> Column:
    """All tokens of a text; ``with_han=False`` keeps the plan free of Python for corpora without Han text."""
    plain = F.coalesce(latin(c), F.array().cast("array<string>"))
    return F.concat(plain, han(c)) if with_han else plain
