"""From rankings to answers: parent contexts, evidence, extractive answers, routed answers, neighbours, channel status.

Every operator takes all queries at once. Rankings are (query_id, doc_id, score, rank); a query without evidence stays,
with the answer that says so. Null and blank texts are no evidence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import ranking as R

# Answers without evidence, and words that ask for a comparison.
NO_ANSWER = "Không đủ căn cứ trong kho văn bản được cung cấp để trả lời câu hỏi."
ABSTAINS, COMPARES = "Insufficient authorized evidence to answer.", "Comparison evidence:\n"
COMPARE_TERMS = ("compare", "difference", "so sanh", "khac nhau")


def parent_contexts(ranking: DataFrame, chunks: DataFrame, k: int = 5, most_chars: int = 8000) -> DataFrame:
    """(query_id, position, chunk_id, parent_id, text): the first ``k`` parents of each query within a budget.

    chunks (doc_id, parent_id, parent_text, retrieval_text). A parent that doesn't fit is replaced by its chunk, cut to
    what is left. Which parents count depends on the budget so far, so that this is a fold over a query's sorted hits;
    it runs in the JVM, and a query has as many hits as its ranking is deep.
    """
    if k <= 0 or most_chars <= 0:
        raise ValueError("the number of parents and the budget must be positive")
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = chunks.select("doc_id", F.coalesce("parent_id", F.col("doc_id").cast("string")).alias("parent_id"), strip(F.col("parent_text")).alias("whole"), strip(F.col("retrieval_text")).alias("part"))
    hits = ranking.select("query_id", "doc_id", "rank").join(parts, "doc_id").where("whole <> ''")
    item = "struct<rank: int, doc_id: string, parent_id: string, whole: string, part: string>"
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), "parent_id", "whole", "part"))).cast(f"array<{item}>")
    state = "struct<left: int, kept: array<struct<doc_id: string, parent_id: string, text: string>>>"

    def add(acc: Column, hit: Column) -> Column:
        text = F.when(F.length(hit["whole"]) <= acc["left"], hit["whole"]).otherwise(F.substring(hit["part"], F.lit(1), acc["left"]))
        fresh = ~F.exists(acc["kept"], lambda x: x["parent_id"] == hit["parent_id"])
        taken = fresh & (acc["left"] > 0) & (F.size(acc["kept"]) < k) & (text != "")
        kept = F.struct(hit["doc_id"].alias("doc_id"), hit["parent_id"].alias("parent_id"), text.alias("text"))
        return F.when(taken, F.struct((acc["left"] - F.length(text)).alias("left"), F.concat(acc["kept"], F.array(kept)).alias("kept")).cast(state)).otherwise(acc)

    start = F.struct(F.lit(most_chars).alias("left"), F.array().cast("array<struct<doc_id: string, parent_id: string, text: string>>").alias("kept")).cast(state)
    packed = hits.groupBy("query_id").agg(F.aggregate(rows, start, add)["kept"].alias("kept"))
    return packed.select("query_id", F.posexplode("kept").alias("position", "e")).select("query_id", "position", F.col("e.doc_id").alias("chunk_id"), F.col("e.parent_id").alias("parent_id"), F.col("e.text").alias("text"))


def provided_evidence(queries: DataFrame, ranking: DataFrame, chunks: DataFrame, candidates: int = 20, k: int = 5, most_chars: int = 8000) -> DataFrame:
    """(query_id, evidence, parents, chars, considered) of all queries: evidence text and its trace."""
    first = ranking.where(F.col("rank") <= candidates)
    context = parent_contexts(first, chunks, k, most_chars)
    rows = F.array_sort(F.collect_list(F.struct("position", "text", "parent_id")))
    joined = context.groupBy("query_id").agg(rows.alias("rows"))
    considered = first.groupBy("query_id").agg(F.count("*").alias("considered"))
    out = queries.select("query_id").distinct().join(joined, "query_id", "left").join(considered, "query_id", "left")
    texts = F.transform(F.coalesce("rows", F.array().cast("array<struct<position: int, text: string, parent_id: string>>")), lambda r: r["text"])
    return out.select("query_id", T.prompt(texts).alias("evidence"), F.transform("rows", lambda r: r["parent_id"]).alias("parents"), F.coalesce(F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t)), F.lit(0)).alias("chars"), F.coalesce("considered", F.lit(0)).alias("considered"))


def extractive_answers(queries: DataFrame, evidence: DataFrame, tokens, per: int = 6, least_chars: int = 25) -> DataFrame:
    """(query_id, answer): the ``per`` sentences that share most of the query's terms, in their order.

    queries (query_id, text), evidence (query_id, position, text); ``tokens`` turns a text column into terms. Ties go to
    the earlier sentence; a query without evidence gets the fixed answer, one without a sentence an empty one.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    parts = F.transform(F.split("text", r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    cut = evidence.where("text IS NOT NULL").select("query_id", "position", F.posexplode(parts).alias("n", "sentence")).where(F.length("sentence") >= least_chars)
    scored = cut.join(asked, "query_id").withColumn("score", F.size(F.array_intersect("q", F.array_distinct(tokens(F.col("sentence"))))) / F.greatest(F.size("q"), F.lit(1)))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "n"))).where(F.col("r") <= per)
    joined = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "n", "sentence"))), lambda x: x["sentence"]), " ").alias("found"))
    known = evidence.select("query_id").distinct().withColumn("known", F.lit(True))
    out = queries.select("query_id").distinct().join(known, "query_id", "left").join(joined, "query_id", "left")
    return out.select("query_id", F.when(F.col("known").isNull(), NO_ANSWER).otherwise(F.coalesce("found", F.lit(""))).alias("answer"))


def agent_answers(queries: DataFrame, ranking: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, route, answer, citations, abstained): an answer quoted from the first ``most`` results of each query.

    queries (query_id, text), chunks (doc_id, excerpt). Without results the route is ``abstain``; a query that compares
    and has several results quotes two, any other one.
    """
    quoted = ranking.where(F.col("rank") <= most).join(chunks.select("doc_id", F.coalesce("excerpt", F.lit("")).alias("excerpt")), "doc_id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "excerpt"))), lambda r: F.struct(r["doc_id"].cast("string").alias("chunk_id"), r["excerpt"].alias("quote")))
    cited = queries.select("query_id", "text").join(quoted.groupBy("query_id").agg(rows.alias("cited")), "query_id", "left")
    cited = cited.withColumn("cited", F.coalesce("cited", F.array().cast("array<struct<chunk_id: string, quote: string>>")))
    cited = cited.withColumn("plain", T.collapse(T.strip_accents(F.coalesce("text", F.lit("")))))
    compares = F.col("plain").rlike("|".join(COMPARE_TERMS))
    route = F.when(F.size("cited") == 0, "abstain").when(compares & (F.size("cited") > 1), "compare").otherwise("lookup")
    line = lambda c: F.concat(c["quote"], F.lit(" ["), c["chunk_id"], F.lit("]"))
    listed = F.concat(F.lit(COMPARES), F.array_join(F.transform(F.slice("cited", 1, 2), lambda c: F.concat(F.lit("- "), line(c))), "\n"))
    answer = F.when(F.col("route") == "abstain", ABSTAINS).when(F.col("route") == "compare", listed).otherwise(F.transform(F.slice("cited", 1, 1), line)[0])
    return cited.withColumn("route", route).select("query_id", "route", answer.alias("answer"), F.transform("cited", lambda c: c["chunk_id"]).alias("citations"), (F.col("route") == "abstain").alias("abstained"))


def channel_status(queries: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """(query_id, channel, state, candidates): ``ok`` where a channel has candidates for a query, else ``skipped``."""
    counted = None
    for name, ranking in channels.items():
        one = ranking.groupBy("query_id").agg(F.count("*").alias("candidates")).withColumn("channel", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    every = queries.select("query_id").distinct().withColumn("channel", F.explode(F.array(*[F.lit(n) for n in channels])))
    joined = every.join(counted, ["query_id", "channel"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return joined.withColumn("state", F.when(F.col("candidates") > 0, "ok").otherwise("skipped")).select("query_id", "channel", "state", "candidates")


def search(queries: DataFrame, channels: dict[str, DataFrame], k: int = 5, depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """(results, status): channels cut to ``depth`` and fused, and what each of them gave for each query."""
    cut = {name: ranking.where(F.col("rank") <= depth) for name, ranking in channels.items()}
    return R.fuse(cut, k), channel_status(queries, cut)


def neighbour_answers(channels: dict[str, DataFrame], answered: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, neighbour_id, answer, score, channel_ranks): the answer of the nearest answered question.

    channels rank the answered questions (doc_id, answer) for each query.
    """
    fused = R.fuse(channels, 1 << 30, weights=weights).drop("rank").withColumn("score", F.round("score", 12))
    best = R.top_k(fused, 1)
    return best.join(answered.select("doc_id", "answer"), "doc_id").select("query_id", F.col("doc_id").alias("neighbour_id"), "answer", "score", "channel_ranks")


def hashed_vectors(docs: DataFrame, tokens: Column, dims: int = 64) -> DataFrame:
    """(doc_id, vector): counts of terms by the hash of the term, the stand-in for a trained encoder.

    Any column of arrays takes its place in ``ranking.nearest``; a text without terms has a zero vector. A batch's
    distinct terms are hashed once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            cells = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims for t in coded.dictionary.to_pylist()], np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            counts = np.bincount(owner * dims + cells[np.asarray(coded.indices)] if len(owner) else np.zeros(0, np.int64), minlength=batch.num_rows * dims).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dims, pa.int32()), pa.array(counts))], ["doc_id", "vector"])

    given = docs.select("doc_id", F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("t"))
    return given.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector array<double>")
