"""Data quality as relations: a rule is a DataFrame of violations (rule, key, detail); a gate passes if all are empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of the rows that break a rule, in one pass; a rule that is null for a row is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def repeated_keys(df: DataFrame, key: str, rule: str = "unique_key") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def missing_references(df: DataFrame, column: str, target: DataFrame, target_key: str, rule: str) -> DataFrame:
    """Values of a column that the target's key doesn't have; null values are left out."""
    asked = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct()
    return asked.join(target.select(F.col(target_key).alias("k")).distinct(), "k", "left_anti").select(F.lit(rule).alias("rule"), F.col("k").cast("string").alias("key"))


def overlap(a: DataFrame, b: DataFrame, column: str, rule: str) -> DataFrame:
    """Values that two tables share, as violations of their separation."""
    return a.select(column).intersect(b.select(column)).where(F.col(column).isNotNull()).select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key"))


def single_owner(df: DataFrame, child: str, owner: str, rule: str) -> DataFrame:
    return df.groupBy(child).agg(F.countDistinct(owner).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(child).cast("string").alias("key"))


def span_failures(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks (chunk_id, doc_id, start, end, body) that are not the stated span of docs (doc_id, text)."""
    joined = chunks.join(docs.select("doc_id", "text"), "doc_id", "left")
    same = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("body")
    return joined.where(~F.coalesce(same, F.lit(False))).select(F.lit("span_matches_source").alias("rule"), F.col("chunk_id").cast("string").alias("key"))


def gate(*parts: DataFrame) -> DataFrame:
    """(rule, broken) counts of all violations; an empty result passes."""
    return reduce(DataFrame.unionByName, [p.select("rule", "key") for p in parts]).groupBy("rule").agg(F.count("*").alias("broken"))


def checked(df: DataFrame, key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, violations): rows that keep all rules, and the violations of the others."""
    fine = reduce(lambda a, b: a & b, [F.coalesce(test, F.lit(False)) for test in rules.values()])
    return df.where(fine), violations(df, key, rules)


def eligible(docs: DataFrame, scopes: list[str], **filters: list[str]) -> DataFrame:
    """Documents of the allowed scopes and filters; applied before any statistics, so that hidden ones can't leak."""
    if not scopes:
        raise ValueError("at least one scope is needed")
    kept = docs.where(F.col("access_scope").isin(*scopes))
    return reduce(lambda d, item: d.where(F.col(item[0]).isin(*item[1])), filters.items(), kept)


def query_violations(queries: DataFrame, most_chars: int = 2000, most_k: int = 100) -> DataFrame:
    """(rule, key) of queries (query_id, text, k): ids without white space, text of bounded length, k in range, ids once."""
    rules = {"query_id_plain": F.col("query_id").cast("string").rlike(r"^\S+$"), "query_text_present": F.trim(F.coalesce("text", F.lit(""))) != "", "query_text_bounded": F.length(F.coalesce("text", F.lit(""))) <= most_chars, "k_in_range": F.col("k").between(1, most_k)}
    return violations(queries, "query_id", rules).unionByName(repeated_keys(queries, "query_id", "query_id_unique"))


def first_of_each(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def reconciled(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that are ``missing`` of the expected ones, and ``extra`` ones."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("extra").alias("side"), key))


def id_list_violations(answers: DataFrame, most: int = 100) -> DataFrame:
    """(rule, key) of answers (id, found): lists of ids that are missing, empty, too long, or have an id twice."""
    size = F.size(F.coalesce("found", F.array().cast("array<string>")))
    rules = {"ids_present": size > 0, "ids_bounded": size <= most, "ids_unique": size == F.size(F.array_distinct(F.coalesce("found", F.array().cast("array<string>"))))}
    return violations(answers, "id", rules).unionByName(repeated_keys(answers, "id", "answer_id_unique"))
