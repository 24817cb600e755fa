"""Batch ranking: every operator takes all queries at once and is one relational plan.

Documents are (doc_id, tokens) or postings (doc_id, token, tf), query tables (query_id, token, qtf); rankings are
(query_id, doc_id, score, rank). Scores are rounded to nine digits, so that sums made in another order tie; ties go to
the smaller document id. Null and empty texts have no tokens and are never ranked.

Lexical scores are products of two matrices, impacts of terms in documents and weights of terms in queries. Queries go
to the workers in blocks of bounded size; a worker makes the impacts of the block's terms for some documents at a time,
multiplies, and sends only the best ``k`` of its part, so that neither postings nor scored pairs are shuffled. Queries
of equal terms are scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.skew import bounded
from tamarack.session import materialise

#: Query vectors sent to the workers at once: a block of fixed size; more queries mean more passes.
QUERY_BLOCK = 4096


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, token, tf) of docs (doc_id, ...)."""
    return docs.select("doc_id", F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


#: Terms with their frequencies that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Cells of a matrix of documents, terms or queries that is made at once (8 bytes each), and queries in one block at least.
CELLS, BLOCK = 1 << 22, 1024
#: Scores are multiples of ``DIGIT``; one from ``LEAST`` on is above zero once it is rounded.
DIGIT, LEAST = 1e-9, 5e-10


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, token, qtf) of queries (query_id, ...)."""
    return queries.select("query_id", F.explode(tokens).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The best ``k`` documents of each group with their rank; Catalyst prunes each partition before the shuffle."""
    order = Window.partitionBy(*(by or ("query_id",))).orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens) of documents in that form or of postings (doc_id, token, tf)."""
    if "tokens" in docs.columns:
        return docs.select("doc_id", "tokens")
    return docs.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("token", F.col("tf").cast("int")))).alias("tokens"))


def frequencies(lists: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(token, df) of the wanted terms, or of all."""
    terms = lists.select(F.explode(F.array_distinct("tokens")).alias("token"))
    if wanted is not None:
        terms = terms.join(bounded(wanted, BROADCAST_TERMS), "token", "left_semi")
    return terms.groupBy("token").agg(F.count("*").alias("df"))


def _alike(asked: DataFrame, *parts: str) -> tuple[DataFrame, DataFrame]:
    """The query terms of one query of each class of queries equal in ``parts``, and (query_id, first) from each to that one."""
    asked = materialise(asked, "asked")
    lists = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("terms"))
    links = materialise(lists.join(lists.groupBy("terms").agg(F.min("query_id").alias("first")), "terms").select("query_id", "first"), "links")
    return materialise(asked.join(links.where("query_id = first").select("query_id"), "query_id"), "asked"), links


def _for_all(ranking: DataFrame, links: DataFrame) -> DataFrame:
    """The ranking of the queries of ``_alike`` for all that are equal to them."""
    return ranking.withColumnRenamed("query_id", "first").join(links, "first").select("query_id", "doc_id", "score", "rank")


def _block_count(terms: DataFrame, block: int | None) -> int:
    """Blocks of the queries of terms (query_id, token, weight), of ``block`` queries where that is given.

    Where the queries share a small vocabulary, a block takes as many as its weights allow, for each is a pass over the documents.
    """
    count, width = terms.agg(F.countDistinct("query_id"), F.countDistinct("token")).first()
    return -(-count // (block or max(BLOCK, CELLS // max(width, 1))))


def _blocks(terms: DataFrame, blocks: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Blocks of the queries of terms (query_id, token, weight): query ids, terms, and weights (terms, queries).

    A block is collected at a time; its size is bounded by the number of queries in it and the length of a query.
    """
    for n in range(blocks):
        rows = (terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else terms).select("query_id", "token", "weight").toArrow()
        if not rows.num_rows:
            continue
        coded = [rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "token")]
        weights = np.zeros((len(coded[1].dictionary), len(coded[0].dictionary)))
        np.add.at(weights, (np.asarray(coded[1].indices), np.asarray(coded[0].indices)), np.asarray(rows.column("weight")))
        yield coded[0].dictionary, coded[1].dictionary.to_pylist(), weights


def _best_of(ids: pa.Array, scores: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the best ``k`` scores above ``least`` of each column, ties by the smaller id."""
    bound = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    row, query = np.nonzero((scores >= bound) & (scores > least))
    place = np.asarray(pc.rank(ids, sort_keys="ascending", tiebreaker="first")).astype(np.int64)
    order = np.lexsort((place[row], -scores[row, query], query))
    row, query = row[order], query[order]
    start = np.searchsorted(query, np.arange(scores.shape[1]))
    kept = np.arange(len(query)) - start[query] < k
    return row[kept], query[kept]


class _Best:
    """The best ``k`` documents of each query among those seen so far, ties by the smaller id."""

    def __init__(self, queries: int, kind: pa.DataType, k: int):
        self.k, self.bound, self.filled = k, np.full(queries, LEAST), False
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.fresh, self.size = [], 0

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """Take scores (documents, queries), not rounded yet; only those that reach a bound are looked at."""
        bound = self.bound
        if not self.filled and len(scores) > self.k:
            bound = np.maximum(bound, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k] - DIGIT)
        row, query = np.divmod(np.flatnonzero(scores >= np.maximum(bound - DIGIT, LEAST / 2)), scores.shape[1])
        score = np.round(scores[row, query], 9)
        high = score >= self.bound[query]
        self.fresh.append((query[high], score[high], ids.take(pa.array(row[high]))))
        self.size += int(high.sum())
        if not self.filled or self.size > len(self.query) + CELLS // 64:
            self.shrink()

    def shrink(self) -> None:
        """Leave out what is no longer among the best, and raise the bounds."""
        query = np.concatenate([self.query, *[f[0] for f in self.fresh]])
        score = np.concatenate([self.score, *[f[1] for f in self.fresh]])
        ids = pa.concat_arrays([self.ids, *[f[2] for f in self.fresh]])
        place = np.asarray(pc.rank(ids, sort_keys="ascending", tiebreaker="first")).astype(np.int64)
        order = np.lexsort((place, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.bound)))[query]
        last = order[nth == self.k - 1]
        order = order[nth < self.k]
        self.query, self.score, self.ids = query[nth < self.k], score[order], ids.take(pa.array(order))
        self.bound[query[nth == self.k - 1]] = score[last]
        self.fresh, self.size, self.filled = [], 0, True


def _ranked(lists: DataFrame, terms: DataFrame, impact, k: int, block: int | None, measure: Callable | None = None) -> DataFrame:
    """Best ``k`` documents of every query; ``impact`` turns counts (documents, terms), lengths and norms into impacts.

    ``measure`` adds the norms to batches of documents: on the way where one pass is made, else written once.
    """
    spark, found = lists.sparkSession, []
    kinds = [f.dataType.simpleString() for f in (terms.schema["query_id"], lists.schema["doc_id"])]
    blocks = _block_count(terms, block)
    if blocks > 1 and (measure or "norm" in lists.columns):
        lists = materialise(lists.mapInArrow(measure, f"doc_id {kinds[1]}, tokens array<string>, norm double") if measure else lists, "norms")
        measure = None
    for queries, vocabulary, weights in _blocks(terms, blocks):
        sent = spark.sparkContext.broadcast((queries, pa.array(vocabulary, pa.string()), weights))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, measure=measure) -> Iterator[pa.RecordBatch]:
            (names, known, matrix), best = sent.value, None
            width = len(known)
            for batch in measure(batches) if measure else batches:
                best = best or _Best(matrix.shape[1], batch.column(0).type, k)
                offsets = np.asarray(batch.column(1).offsets, dtype=np.int64)
                code = pc.fill_null(pc.index_in(batch.column(1).values.slice(offsets[0], offsets[-1] - offsets[0]), value_set=known), -1).to_numpy(zero_copy_only=False)
                offsets = offsets - offsets[0]
                extra = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
                step = max(1, CELLS // max(width, matrix.shape[1]))
                for first in range(0, batch.num_rows, step):
                    last = min(batch.num_rows, first + step)
                    part = code[offsets[first] : offsets[last]]
                    owner = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
                    tf = np.bincount(owner[part >= 0] * width + part[part >= 0], minlength=(last - first) * width).reshape(-1, width)
                    best.add(batch.column(0).slice(first, last - first), impact(tf, np.diff(offsets[first : last + 1]), *[x[first:last] for x in extra]) @ matrix)
            if best:
                best.shrink()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), best.ids, pa.array(best.score)], ["query_id", "doc_id", "score"])

        found.append(lists.mapInArrow(score, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")
    return top_k(reduce(DataFrame.union, found), k)


def bm25(docs: DataFrame, asked: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, repeats: bool = False, variant: str = "plus_one", block: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """BM25 ranking of documents for all queries.

    ``repeats`` counts a term as often as the query has it. ``variant`` is the inverse document frequency: ``plus_one``
    is ln(1 + (N - df + .5) / (df + .5)), ``floored`` is ln((N - df + .5) / (df + .5)), at least 1e-6. ``known`` are the
    frequencies of all terms (token, df), where they have been counted.
    """
    lists = term_lists(docs).where(F.size("tokens") > 0)
    n, mean = lists.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    n, mean = n or 0, max(mean or 1.0, 1.0)
    odds = (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(1 + odds) if variant == "plus_one" else F.greatest(F.log(odds), F.lit(1e-6))
    asked, links = _alike(asked, "token", *(["qtf"] if repeats else []))
    terms = materialise(asked.join(frequencies(lists, asked.select("token").distinct()) if known is None else known, "token").select("query_id", "token", ((idf * F.col("qtf")) if repeats else idf).alias("weight")), "terms")

    def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / mean))[:, None])

    return _for_all(_ranked(lists, terms, impact, k, block), links)


def tfidf(docs: DataFrame, asked: DataFrame, k: int = 10, block: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Cosine of tf-idf vectors, idf = ln((1 + N) / (1 + df)) + 1; query terms outside the corpus weigh nothing."""
    lists = term_lists(docs).where(F.size("tokens") > 0)
    asked, links = _alike(asked, "token", "qtf")
    n = lists.count()
    idf = materialise((frequencies(lists) if known is None else known).select("token", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    wanted = materialise(asked.join(idf, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("qw"), "idf"), "wanted")
    norms = wanted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    terms = materialise(wanted.join(norms, "query_id").select("query_id", "token", (F.col("qw") * F.col("idf") / F.col("qn")).alias("weight")), "terms")
    lists, measure = _with_norms(lists, idf)
    return _for_all(_ranked(lists, terms, lambda tf, length, norm: tf / norm[:, None], k, block, measure), links)


def _with_norms(lists: DataFrame, idf: DataFrame) -> tuple[DataFrame, Callable | None]:
    """(doc_id, tokens, norm), the length of each document's tf-idf vector, or (doc_id, tokens) and what adds it to batches."""
    if idf.count() > BROADCAST_TERMS:
        counted = lists.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
        norms = counted.join(idf, "token").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
        return lists.join(norms, "doc_id").select("doc_id", "tokens", "norm"), None
    rows = idf.toArrow()
    sent = lists.sparkSession.sparkContext.broadcast((rows.column("token").combine_chunks(), np.asarray(rows.column("idf"))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = sent.value
        for batch in batches:
            offsets = np.asarray(batch.column(1).offsets, dtype=np.int64)
            code = pc.index_in(batch.column(1).values.slice(offsets[0], offsets[-1] - offsets[0]), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            pair, tf = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * len(known) + code, return_counts=True)
            owner, code = np.divmod(pair, max(len(known), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.bincount(owner, (tf * weight[code]) ** 2, minlength=batch.num_rows)))], ["doc_id", "tokens", "norm"])

    return lists, measure


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest vectors by inner product of unit vectors.

    vectors (doc_id, vector) and queries (query_id, vector). The queries go to the workers in blocks of fixed size; a
    worker multiplies a batch with a block and sends the best ``k`` of the batch only. Null vectors take no part, a
    zero vector has inner product 0 with all.
    """
    spark, found = vectors.sparkSession, []
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", "vector")
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()]
    blocks = max(1, -(-asked.count() // block))

    given = vectors.where("doc_id IS NOT NULL AND vector IS NOT NULL").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    for part in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part) if blocks > 1 else asked).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((pa.array([r.query_id for r in rows]), _unit(np.array([r.vector for r in rows], float)).T))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = np.round(_unit(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)) @ matrix, 12)
                row, query = _best_of(batch.column(0), scores, k, least=-np.inf)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), batch.column(0).take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "doc_id", "score"])

        found.append(given.mapInArrow(scan, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")
    return top_k(reduce(DataFrame.union, found).withColumn("score", F.round("score", 12)), k)


#: Rows that the cells of ``nearest_in_cells`` are fitted on at most, rounds of the fit, and rows of a cell in one task.
FIT, ROUNDS, CELL_ROWS = 20_000, 12, 50_000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_cells(vectors: DataFrame, cells: int, limit: int = FIT) -> np.ndarray:
    """Unit centres of ``cells`` cells, fitted on about ``limit`` vectors chosen by a hash of their id."""
    given = vectors.where("doc_id IS NOT NULL AND vector IS NOT NULL").select("vector", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("h"))
    share = min(1.0, limit / max(given.count(), 1))
    rows = given.where(F.col("h") < int(share * (1 << 32))).orderBy("h").select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _unit(np.stack([np.asarray(v, float) for v in rows.column("vector").to_pylist()]))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(np.bincount(home, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 64, probes: int = 8, centres: np.ndarray | None = None) -> DataFrame:
    """Nearest vectors by an inverted file: every row is indexed under its nearest centre, a query visits ``probes`` cells.

    Work grows with queries x rows x probes / cells instead of with queries x rows; what lies in cells that a query
    doesn't visit is missed, so recall has to be measured against ``nearest``. Large cells are cut into parts that all
    their queries visit, so that no task holds a whole cell.
    """
    spark = vectors.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()]
    centres = fit_cells(vectors, cells) if centres is None else centres
    if not len(centres):
        return spark.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")
    sent = spark.sparkContext.broadcast(centres.T)

    def placed(many: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _unit(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)) @ sent.value
                    cell = np.argsort(-near, axis=1, kind="stable")[:, :many]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel(), pa.int32())], ["id", "vector", "cell"])

        return place

    doubles = F.col("vector").cast("array<double>").alias("vector")
    rows = vectors.where("doc_id IS NOT NULL AND vector IS NOT NULL").select("doc_id", doubles).mapInArrow(placed(1), f"id {kinds[1]}, vector array<double>, cell int")
    rows = materialise(rows, "cells")
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", doubles).mapInArrow(placed(probes), f"id {kinds[0]}, vector array<double>, cell int")
    parts = materialise(rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")), "parts")
    rows = rows.join(F.broadcast(parts), "cell").select("id", "vector", F.col("cell").alias("c"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"))
    asked = asked.join(F.broadcast(parts), "cell").select("id", "vector", F.col("cell").alias("qc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qp"))

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        matrix = _unit(np.stack(held["vector"].to_list()))
        found = []
        for first in range(0, len(asked), QUERY_BLOCK):
            block = asked.iloc[first : first + QUERY_BLOCK]
            scores = np.round(matrix @ _unit(np.stack(block["vector"].to_list())).T, 12)
            row, query = _best_of(pa.array(held["id"]), scores, k, least=-np.inf)
            found.append(pd.DataFrame({"query_id": block["id"].to_numpy()[query], "doc_id": held["id"].to_numpy()[row], "score": scores[row, query]}))
        return pd.concat(found)

    met = asked.groupBy("qc", "qp").cogroup(rows.groupBy("c", "p")).applyInPandas(score, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(met.withColumn("score", F.round("score", 12)), k)


def fuse(channels: dict[str, DataFrame], k: int = 50, constant: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, score, rank), with each channel's score and rank as maps.

    A document that stands twice in a channel counts once, at its best rank; it still uses up its other ranks.
    """
    weights = weights or {}
    if any(w < 0 for w in weights.values()) or constant <= 0:
        raise ValueError("weights must not be negative, the constant must be positive")
    parts = []
    for name, ranking in channels.items():
        best = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
        parts.append(best.withColumns({"channel": F.lit(name), "weight": F.lit(float(weights.get(name, 1.0)))}))
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "score")))).alias("channel_scores"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"),
    )
    return top_k(fused, k)


def boost(ranking: DataFrame, cited: DataFrame, meta: DataFrame, factor: float = 0.12) -> DataFrame:
    """Ranking with scores raised by (1 + factor x matches) for citations of the query that a document meets.

    cited (query_id, document_number, article, clause), meta (doc_id, document_number, article, clause): a number
    counts 2, an article 1, a clause 1. Null or empty parts never match.
    """
    part = lambda name, value: F.when((F.col(f"c.{name}") != "") & (F.col(f"c.{name}") == F.col(f"m.{name}")), value).otherwise(0)
    met = ranking.select("query_id", "doc_id").join(meta.alias("m"), "doc_id").join(cited.alias("c"), "query_id")
    matches = met.groupBy("query_id", "doc_id").agg(F.sum(part("document_number", 2) + part("article", 1) + part("clause", 1)).alias("matches"))
    joined = ranking.drop("rank").join(matches, ["query_id", "doc_id"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return top_k(joined.withColumn("score", F.col("score") * (1 + factor * F.col("matches"))), 1 << 30)


def lexical_rerank(ranking: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` of a ranking scored anew by overlap of token sets: queries (query_id, tokens), docs (doc_id, tokens)."""
    first = ranking.where(F.col("rank") <= k).select("query_id", "doc_id")
    met = first.join(queries.select("query_id", F.array_distinct("tokens").alias("q")), "query_id").join(docs.select("doc_id", F.array_distinct("tokens").alias("d")), "doc_id")
    score = F.size(F.array_intersect("q", "d")) / F.greatest(F.lit(1.0), F.sqrt(F.size("q") * F.size("d")))
    return top_k(met.select("query_id", "doc_id", score.alias("score")), k)


def model_rerank(ranking: DataFrame, queries: DataFrame, docs: DataFrame, score, k: int = 50) -> DataFrame:
    """The first ``k`` of a ranking scored anew by a model: ``score`` takes pairs (query, text) and gives numbers.

    queries (query_id, text), docs (doc_id, text). Scores go through a logistic function; the model is loaded where
    ``score`` first runs on a worker. Null texts are empty ones.
    """
    first = ranking.where(F.col("rank") <= k).select("query_id", "doc_id")
    met = first.join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("q")), "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("d")), "doc_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.asarray(score(batch.column(2).to_pylist(), batch.column(3).to_pylist()), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(raw, -60, 60))))], ["query_id", "doc_id", "score"])

    kinds = [met.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")]
    scored = met.select("query_id", "doc_id", "q", "d").mapInArrow(judge, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(scored.withColumn("score", F.round("score", 12)), k)


# Words that mark entities, conditions and conjunctions in questions.
ENTITIES = r"(?iuU)\b(?:người\s+lao\s+động|người\s+sử\s+dụng\s+lao\s+động|người|cá\s+nhân|tổ\s+chức|doanh\s+nghiệp|cơ\s+quan|đơn\s+vị|bên\s+mua|bên\s+bán|người\s+vi\s+phạm|người\s+nộp\s+thuế)\b"
CONDITIONS = r"(?iuU)\b(?:nếu|khi|trong\s+trường\s+hợp|trừ\s+trường\s+hợp|với\s+điều\s+kiện|tùy\s+theo|đồng\s+thời|ngoại\s+trừ)\b"
CONJUNCTIONS = r"(?iuU)\b(?:và|hoặc|nhưng|cũng\s+như|hay)\b"


def complexity(text: Column, citation_count: Column, low: float = 2.2, high: float = 5.0, ks: tuple[int, int, int] = (3, 5, 8)) -> dict[str, Column]:
    """Columns ``complexity`` and ``base_k`` of a question on one line and the number of its citations."""
    entities = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENTITIES), F.lit(0)), F.lower)))
    conditions, conjunctions = F.regexp_count(text, F.lit(CONDITIONS)), F.regexp_count(text, F.lit(CONJUNCTIONS))
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    length = F.greatest(F.lit(0.0), F.least(F.lit(3.0), (words - 12) / F.lit(20.0)))
    at_most = lambda c, m: F.least(c, F.lit(m))
    score = 0.8 * at_most(entities, 4) + 1.2 * at_most(conditions, 4) + 1.0 * at_most(citation_count, 3) + 0.6 * at_most(conjunctions, 5) + 0.8 * length
    return {"complexity": F.round(score, 6), "base_k": F.when(score < low, ks[0]).when(score < high, ks[1]).otherwise(ks[2])}


def confidence(ranking: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, concentration, ambiguity, top_gap, tail_mass, elbow) from the gaps of the first scores.

    Scores outside [0, 1] go through a logistic function first; the first of equal gaps is the elbow.
    """
    whole = Window.partitionBy("query_id")
    order = whole.orderBy("rank")
    first = ranking.where(F.col("rank") <= most).withColumn("inside", F.min(((F.col("score") >= 0) & (F.col("score") <= 1)).cast("int")).over(whole))
    logistic = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("score")))))
    scaled = first.withColumn("s", F.when(F.col("inside") == 1, F.col("score")).otherwise(logistic))
    gaps = scaled.withColumn("gap", F.greatest(F.lit(0.0), F.col("s") - F.lead("s").over(order)))
    agg = gaps.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("gap").alias("largest"), F.min_by("rank", F.struct(-F.coalesce("gap", F.lit(-1.0)), "rank")).alias("elbow"),
        F.max(F.when(F.col("rank") == 1, F.col("gap"))).alias("top_gap"), F.sum(F.greatest("s", F.lit(0.0))).alias("total"), F.sum(F.when(F.col("rank") > 3, F.greatest("s", F.lit(0.0))).otherwise(0.0)).alias("tail"),
    )
    one = F.col("n") == 1
    largest, total = F.when(one, 1.0).otherwise(F.col("largest")), F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return agg.select("query_id", F.round(largest, 6).alias("concentration"), F.round(1 - largest, 6).alias("ambiguity"), F.round(F.when(one, 1.0).otherwise(F.col("top_gap")), 6).alias("top_gap"), F.round(F.when(one, 0.0).otherwise(F.col("tail") / total), 6).alias("tail_mass"), F.when(one, 1).otherwise(F.col("elbow")).alias("elbow"))


def dynamic_k(base: Column, concentration: Column, elbow: Column, confident: float = 0.20, least: int = 2, reach: int = 3, ambiguous: float = 0.05, more: int = 5) -> Column:
    """Documents to keep: few behind a clear gap, more where scores are close."""
    return F.when(elbow == 0, base).when((concentration >= confident) & (elbow <= reach), F.greatest(F.lit(least), F.least(base, elbow))).when(concentration <= ambiguous, F.greatest(base, F.lit(more))).otherwise(base)


def parents_of(ranking: DataFrame, parent: DataFrame) -> DataFrame:
    """The first hit of each parent: parent (doc_id, parent_id)."""
    order = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    return ranking.join(parent, "doc_id").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def graph_expand(seeds: DataFrame, edges: DataFrame, per_seed: int = 2, decay: float = 0.72) -> DataFrame:
    """Neighbours of seeds (query_id, node, score, rank) over edges (src, dst, relation, ord), seeds left out.

    Each seed gives its first ``per_seed`` neighbours; a neighbour of several seeds comes from the best-ranked one.
    """
    relations = ("REFERENCES", "AMENDS", "AMENDED_BY", "REPEALS", "REPEALED_BY", "REPLACES", "REPLACED_BY")
    first = Window.partitionBy("src").orderBy("ord", "dst")
    near = edges.where(F.col("relation").isin(*relations)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_seed)
    met = seeds.join(near, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (F.col("score") * decay).alias("score"), "relation", "rank", "n")
    best = Window.partitionBy("query_id", "node").orderBy("rank", "n")
    fresh = met.join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti")
    return fresh.withColumn("b", F.row_number().over(best)).where("b = 1").select("query_id", "node", "score", "relation")


def pack_evidence(pool: DataFrame, most_chars: int = 12_000, per_document: int = 3, least_ratio: float = 0.35) -> DataFrame:
    """Greedy packing of pool (query_id, id, document_id, score, text) under a budget of characters per query.

    A row that its document's cap leaves out uses no budget, so the fold is sequential; it runs as an aggregate over a
    query's sorted rows in the JVM. The last text is cut to what is left.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "document_id", "text")))
    grouped = pool.where("length(trim(text)) > 0").groupBy("query_id").agg(rows.alias("rows"), F.max("score").alias("best"))
    item = "struct<neg: double, id: string, document_id: string, text: string>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{item}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.size(F.filter(acc["kept"], lambda k: k["document_id"] == x["document_id"]))
        room = F.lit(most_chars) - acc["used"]
        text = F.substring(x["text"], F.lit(1), room)
        fits = (taken < per_document) & (room > 0) & (F.length(F.trim(text)) > 0)
        kept = F.struct(x["neg"].alias("neg"), x["id"].alias("id"), x["document_id"].alias("document_id"), text.alias("text"))
        return F.when(fits, F.struct((acc["used"] + F.length(text)).alias("used"), F.concat(acc["kept"], F.array(kept)).alias("kept"))).otherwise(F.struct(acc["used"].alias("used"), acc["kept"].alias("kept")))

    usable = F.filter(F.col("rows").cast(f"array<{item}>"), lambda x: (F.col("best") <= 0) | (-x["neg"] >= F.col("best") * least_ratio))
    packed = grouped.select("query_id", F.aggregate(usable, start, step)["kept"].alias("kept"))
    return packed.select("query_id", F.posexplode("kept").alias("position", "e")).select("query_id", "position", F.col("e.id").alias("id"), F.col("e.document_id").alias("document_id"), (-F.col("e.neg")).alias("score"), F.col("e.text").alias("text"))


def citation_graph(parents: DataFrame) -> DataFrame:
    """(src, dst, relation) of parents (id, document_id, document_number, article, refs, amends, text).

    Containment edges both ways; a reference goes to the article of the cited number, or of the same document where no
    number is cited; changes have a reverse edge. No self loops, no repeats.
    """
    from tamarack.functions.citations import relation

    doc = F.concat(F.lit("doc:"), F.col("document_id"))
    holds = parents.select(doc.alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("relation"))
    held = parents.select(F.col("id").alias("src"), doc.alias("dst"), F.lit("CONTAINED_BY").alias("relation"))
    refs = parents.select("id", "document_id", "text", "amends", F.explode("refs").alias("ref")).withColumn("p", F.split("ref", r"\|"))
    refs = refs.select("id", "document_id", F.col("p")[0].alias("number"), F.col("p")[1].alias("cited"), relation(F.col("text"), F.array_contains("amends", F.col("ref"))).alias("relation")).where("cited <> ''")
    by_number = parents.where("article IS NOT NULL AND document_number IS NOT NULL").select(F.col("id").alias("dst"), F.upper(F.regexp_replace("document_number", r"\s+", "")).alias("n"), F.lower("article").alias("a"))
    by_doc = parents.where("article IS NOT NULL").select(F.col("id").alias("dst"), F.col("document_id").alias("d"), F.lower("article").alias("a"))
    far = refs.where("number <> ''").join(by_number, (F.col("number") == F.col("n")) & (F.col("cited") == F.col("a")))
    near = refs.where("number = ''").join(by_doc, (F.col("document_id") == F.col("d")) & (F.col("cited") == F.col("a")))
    out = far.select("id", "dst", "relation").union(near.select("id", "dst", "relation")).toDF("src", "dst", "relation")
    reverse = F.create_map(*[F.lit(x) for x in ("AMENDS", "AMENDED_BY", "REPEALS", "REPEALED_BY", "REPLACES", "REPLACED_BY")])
    back = out.where(F.col("relation").isin("AMENDS", "REPEALS", "REPLACES")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), reverse[F.col("relation")].alias("relation"))
    return holds.union(held).union(out).union(back).where("src <> dst").distinct()
