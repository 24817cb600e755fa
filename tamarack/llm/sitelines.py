"""Problem 3: lines repeated across one site's documents.

Lines are hashed in a normal form (case, white space and the digits of each digit run ignored), distinct documents
are counted per source, field and hash, and lines in a large share of a source's documents are joined back.
Null sources form one source of their own; null texts have no lines; blank lines are never cases; an id that is
delivered again counts once. Texts never enter a shuffle: only (id, line number, hash) does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.skew import lookup


def line_key(line: Column) -> Column:
    """64-bit key of a line's normal form; null for a blank line."""
    plain = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    plain = F.regexp_replace(F.trim(plain), r"(?U)\d+", "0")
    return F.when(plain != "", F.xxhash64(plain))


def line_table(docs: DataFrame, fields: list[str], key: str = "id", source: str = "source") -> DataFrame:
    """(id, source, field, line_no, line): every non-blank line as its key, without its text."""
    parts = [docs.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.lit(f).alias("field"), F.posexplode(F.split(F.col(f), "\n")).alias("line_no", "text")) for f in fields]
    lines = reduce(DataFrame.unionByName, parts)
    return lines.select("id", "source", "field", "line_no", line_key(F.col("text")).alias("line")).where("line IS NOT NULL AND id IS NOT NULL")


def frequent_lines(lines: DataFrame, sizes: DataFrame, share: float, least: int) -> DataFrame:
    """(source, field, line, docs) of the lines in at least ``share`` of a source's ids and in at least ``least`` ids.

    Counting is two-step, so that a line in a third of all rows is pre-aggregated before each shuffle.
    """
    once = lines.groupBy("source", "field", "line", "id").agg(F.lit(1).alias("one"))
    counted = once.groupBy("source", "field", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    return counted.join(sizes, "source").where(F.col("docs") >= F.ceil(F.col("total") * share - 1e-9)).select("source", "field", "line", "docs")


def repeated_lines(docs: DataFrame, fields: list[str], share: float = 0.2, least: int = 3, key: str = "id", source: str = "source") -> DataFrame:
    """(id, source, field, line_no) of each line to remove, once each."""
    sizes = docs.where(F.col(key).isNotNull()).select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(key).alias("id")).distinct().groupBy("source").agg(F.count("*").alias("total"))
    lines = line_table(docs, fields, key, source)
    often = frequent_lines(lines, sizes, share, least)
    found = lookup(lines, often, ["source", "field", "line"], "docs").select("id", "source", "field", F.col("line_no").cast("bigint").alias("line_no"))
    return found.distinct()


def _kept_lines(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i.cast("bigint")))
    return F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(text)


def without_lines(docs: DataFrame, found: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``docs`` with the found lines removed from ``fields``; rows without found lines pass unchanged."""
    numbers = found.groupBy("id").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("line_no"))).alias(f"__lines_{k}") for k, f in enumerate(fields)])
    joined = docs.join(numbers.withColumnRenamed("id", "__lines_id"), F.col(key) == F.col("__lines_id"), "left")
    rebuilt = {}
    for k, f in enumerate(fields):
        rebuilt[f] = _kept_lines(F.col(f), F.col(f"__lines_{k}"))
    return joined.withColumns(rebuilt).drop("__lines_id", *[f"__lines_{k}" for k in range(len(fields))])
