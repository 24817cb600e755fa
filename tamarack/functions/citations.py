"""Citations of articles in legal text, as arrays of structs that can be exploded and joined.

A citation's prefix (the clauses and points named before the article) needs match offsets, which Spark expressions
don't give, so the parser is an Arrow UDF; texts without the word for article never leave the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tamarack.functions.text import collapse, normalize_text

CITATION = StructType([StructField(n, StringType()) for n in ("article", "document_number", "document_type", "clause", "point", "key", "raw")])

# Forms of an article citation, of its clauses and points, of what ends their reach, and of words that amend.
ARTICLE = r"điều\s+(?P<article>\d+[a-zđ]?)(?:\s+(?P<kind>bộ\s+luật|luật|nghị\s+định|thông\s+tư(?:\s+liên\s+tịch)?|nghị\s+quyết|quyết\s+định|chỉ\s+thị|công\s+văn|pháp\s+lệnh))?(?:\s+(?:số\s*)?(?P<number>\d{1,5}/(?:\d{4}|[A-ZĐ]{1,8})(?:/[A-ZĐ0-9-]{2,30})?))?"
CLAUSE, POINT, STOP = r"khoản\s+(?P<clause>\d+[a-zđ]?)", r"điểm\s+(?P<point>[a-zđ])", r"(?P<stop>[;.:])"
AMENDS = r"(?iuU)\b(sửa đổi|bổ sung|bãi bỏ|thay thế|hết hiệu lực)\b"
#: Characters before an article in which its clauses and points may stand.
REACH = 70
_MARKS = re.compile("|".join((ARTICLE, CLAUSE, POINT, STOP)), re.IGNORECASE)


def _parse(text: str) -> list[tuple]:
    """One pass over the marks of a text: clauses and points wait for the next article within reach; a stop drops them."""
    found: dict[str, tuple] = {}
    waiting: list[tuple[int, str, str]] = []
    since = 0
    for mark in _MARKS.finditer(text):
        kind, value = mark.lastgroup, mark[mark.lastgroup].casefold()
        if kind == "stop":
            waiting, since = [], mark.end()
        elif kind in ("clause", "point"):
            waiting.append((mark.start(), kind, value))
        else:
            reach = max(since, mark.start() - REACH)
            near = {k: [v for at, name, v in waiting if name == k and at >= reach] for k in ("clause", "point")}
            article, number = mark["article"].casefold(), mark["number"] and "".join(mark["number"].split()).upper()
            point = near["point"][0] if len(near["point"]) == 1 else None
            raw = f"{text[reach : mark.start()]} {mark.group()}".strip()
            for clause in near["clause"] or [None]:
                key = "|".join(x or "" for x in (number, article, clause, point))
                found.setdefault(key, (article, number, mark["kind"], clause, point, key, raw))
    return list(found.values())


@F.pandas_udf(ArrayType(CITATION))
def _citations(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _parse(t))


def citations(text: Column) -> Column:
    """Distinct citations in order of appearance; a text without any has an empty array."""
    plain = normalize_text(text, keep_lines=False)
    found = _citations(F.when(plain.rlike(r"(?iu)điều"), plain))
    return F.coalesce(found, F.array().cast(ArrayType(CITATION)))


def reference_keys(cited: Column) -> Column:
    return F.array_distinct(F.transform(cited, lambda c: c["key"]))


def amendment_keys(text: Column, cited: Column) -> Column:
    """Reference keys of a text that amends, an empty array otherwise."""
    return F.when(text.rlike(AMENDS), reference_keys(cited)).otherwise(F.array().cast("array<string>"))


def relation(text: Column, amends: Column) -> Column:
    """How a text relates to what it cites."""
    t = F.lower(collapse(text))
    return F.when(t.rlike("bãi bỏ|hết hiệu lực"), "REPEALS").when(t.contains("thay thế"), "REPLACES").when(amends, "AMENDS").otherwise("REFERENCES")
