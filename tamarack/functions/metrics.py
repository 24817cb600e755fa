"""Metrics of generated text and of retrieval, for whole tables at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one row of the table at a time."""
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    row = np.zeros(len(y) + 1, np.int64)
    for token in x:
        take = np.where(y == token, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(take, row[1:]))
    return int(row[-1])


def rouge_l(prediction: Column, reference: Column, beta: float = 1.0) -> Column:
    """F-beta of the longest common subsequence of two token arrays; 0 where either is empty.

    A subsequence needs a table of both lengths, so this runs in an Arrow UDF.
    """
    if beta <= 0:
        raise ValueError("beta must be positive")

    @F.pandas_udf(DoubleType())
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, r):
            a, b = list(a) if a is not None else [], list(b) if b is not None else []
            common = _lcs(a, b) if a and b else 0
            precision, recall = (common / len(a), common / len(b)) if common else (0.0, 0.0)
            out.append((1 + beta**2) * precision * recall / (recall + beta**2 * precision) if common else 0.0)
        return pd.Series(out)

    return score(prediction, reference)


def meteor(pairs: DataFrame, prediction: str, reference: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """(id, meteor) of pairs (id, prediction tokens, reference tokens), exact token matches.

    The k-th occurrence of a token in the prediction matches its k-th in the reference, so matching is an equi-join of
    the two exploded sides, and breaks between matched chunks come from a window.
    """
    side = lambda column, at: (
        pairs.select("id", F.posexplode(column).alias(at, "token")).withColumn("k", F.row_number().over(Window.partitionBy("id", "token").orderBy(at)))
    )
    met = side(prediction, "p").join(side(reference, "r"), ["id", "token", "k"])
    before = F.lag("r").over(Window.partitionBy("id").orderBy("p"))
    chunks = met.withColumn("fresh", F.when(before.isNull() | (F.col("r") != before + 1), 1).otherwise(0))
    counted = chunks.groupBy("id").agg(F.count("*").alias("m"), F.sum("fresh").alias("chunks"))
    precision, recall = F.col("m") / F.size(prediction), F.col("m") / F.size(reference)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    score = mean * (1 - gamma * F.pow(F.col("chunks") / F.col("m"), beta))
    return pairs.join(counted, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("meteor"))


def f_beta(found: Column, wanted: Column, beta: float = 2.0) -> Column:
    """F-beta of two id arrays as sets; 0 where nothing is common."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    f, w = F.array_distinct(found), F.array_distinct(wanted)
    common = F.size(F.array_intersect(f, w))
    precision, recall = common / F.size(f), common / F.size(w)
    return F.when(common > 0, (1 + beta**2) * precision * recall / (beta**2 * precision + recall)).otherwise(F.lit(0.0))


def retrieval_metrics(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """(query_id, n_relevant, rr, recall_k..., hit_k..., ndcg_k...) of judged queries.

    ranking (query_id, doc_id, rank), relevant (query_id, doc_id). Queries without a hit score 0; the ideal gain has
    the relevant documents first.
    """
    judged = relevant.select("query_id", "doc_id").distinct()
    size = judged.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranking.join(judged, ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return _measured(size, hits, ks)


def class_metrics(ranking: DataFrame, asked: DataFrame, docs: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """``retrieval_metrics`` where the documents of a query's class are its relevant ones.

    asked (query_id, class), docs (doc_id, class), a document of one class. Pairs of queries and relevant documents grow
    with the square of the rows, so they are counted by class, and only ranked pairs are looked up.
    """
    asked, docs = asked.select("query_id", "class").distinct(), docs.select("doc_id", "class").distinct()
    size = asked.join(docs.groupBy("class").agg(F.count("*").alias("n")), "class").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    hits = ranking.join(asked, "query_id").join(docs, ["doc_id", "class"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return _measured(size, hits, ks)


def _measured(size: DataFrame, hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Metrics of queries (query_id, n_relevant) with hits (query_id, doc_id, rank)."""
    gain = 1 / F.log2(F.col("rank") + 1)
    sums = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.sum(F.when(inside, 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"g{k}")]
    joined = size.join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    out = ["query_id", "n_relevant", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        out += [F.coalesce(F.col(f"h{k}") / F.col("n_relevant"), F.lit(0.0)).alias(f"recall_{k}"), F.coalesce((F.col(f"h{k}") > 0).cast("int"), F.lit(0)).alias(f"hit_{k}"), F.coalesce(F.col(f"g{k}") / ideal(k), F.lit(0.0)).alias(f"ndcg_{k}")]
    return joined.select(*out)
