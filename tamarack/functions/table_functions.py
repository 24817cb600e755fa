"""Chunkers as table functions for SQL: ``SELECT d.id, c.* FROM docs d, LATERAL text_windows(d.text, 1800, 220) c``.

Each takes one text and gives its chunks as rows; null and empty texts give none. In DataFrame code the columns of
``operators.chunking`` do the same without a table function.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tamarack.operators.chunking import window_bounds


@udtf(returnType="ordinal int, start int, `end` int, body string")
class TextWindows:
    """Windows of at most ``most`` characters that end at white space where they can."""

    def eval(self, text: str, most: int, overlap: int):
        for n, (a, b) in enumerate(window_bounds(text or "", most, overlap)):
            yield n, a, b, text[a:b]


@udtf(returnType="ordinal int, article string, body string")
class LegalArticles:
    """Articles of a legal text in order; what stands before the first has no number."""

    def eval(self, text: str):
        starts = [(m.start(), m.group(1).lower()) for m in re.finditer(r"(?im)^[^\S\n]*điều\s+(\d+[a-zđ]?)\b", text or "")]
        bounds = [(0, None), *starts, (len(text or ""), None)]
        parts = [(article, text[a:b].strip()) for (a, article), (b, _) in zip(bounds, bounds[1:])] if text else []
        for n, (article, body) in enumerate(p for p in parts if p[1]):
            yield n, article, body


def register(spark: SparkSession) -> None:
    """Makes ``text_windows`` and ``legal_articles`` known to the session's SQL."""
    spark.udtf.register("text_windows", TextWindows)
    spark.udtf.register("legal_articles", LegalArticles)
