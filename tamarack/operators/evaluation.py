"""Evaluation of runs: complementarity of channels, paired comparison, grid search, submissions, token lengths."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import metrics as M
from tamarack.functions import text as T
from tamarack.operators import ranking as R


def complementarity(a: DataFrame, b: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row (both, only_a, only_b, neither): judged queries by which channel has a relevant document in its top k."""
    judged = relevant.select("query_id", "doc_id").distinct()
    hit = lambda r, name: r.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(True))
    every = judged.select("query_id").distinct().join(hit(a, "in_a"), "query_id", "left").join(hit(b, "in_b"), "query_id", "left")
    x, y = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return every.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def paired(candidate: DataFrame, parent: DataFrame, score: str = "score", tolerance: float = 1e-12) -> DataFrame:
    """(slice, n, wins, losses, ties, delta) of two runs (id, slices, score) over their common ids."""
    joined = candidate.select("id", F.explode("slices").alias("slice"), F.col(score).alias("new")).join(parent.select("id", F.col(score).alias("old")), "id")
    d = F.col("new") - F.col("old")
    return joined.groupBy("slice").agg(F.count("*").alias("n"), F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.avg(d).alias("delta"))


def pareto(trials: DataFrame, cost: str, gain: str, key: str) -> DataFrame:
    """Trials that no cheaper or equally cheap trial reaches in gain, of equal ones the first by ``key``.

    The trials are one small table, so that one ordered window goes over them.
    """
    before = Window.orderBy(F.asc(cost), F.desc(gain), F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    return trials.withColumn("_best", F.max(gain).over(before)).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def grid(spark, lows=(1.6, 2.0, 2.2, 2.6), highs=(4.0, 5.0, 6.0), confident=(0.15, 0.20, 0.25, 0.30), ambiguous=(0.03, 0.05), more=(5, 6)) -> DataFrame:
    """The parameter grid of ``grid_search``: all combinations with low < high."""
    rows = [(i, *map(float, p[:4]), int(p[4])) for i, p in enumerate(q for q in product(lows, highs, confident, ambiguous, more) if q[0] < q[1])]
    return spark.createDataFrame(rows, "trial int, low double, high double, confident double, ambiguous double, more int")


def grid_search(questions: DataFrame, ranking: DataFrame, relevant: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial, avg_k, recall) of every trial in one job.

    questions (query_id, complexity), ranking (query_id, doc_id, score, rank), relevant (query_id, doc_id). The grid is
    a fixed small table that is broadcast beside each judged question.
    """
    judged = relevant.select("query_id", "doc_id").distinct()
    first = ranking.join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = judged.select("query_id").distinct().join(questions, "query_id").join(R.confidence(ranking), "query_id", "left").join(first, "query_id", "left")
    every = rows.crossJoin(F.broadcast(trials))
    base = F.when(F.col("complexity") < F.col("low"), 3).when(F.col("complexity") < F.col("high"), 5).otherwise(8)
    elbow, gap = F.coalesce("elbow", F.lit(0)), F.coalesce("concentration", F.lit(0.0))
    k = F.when(elbow == 0, base).when((gap >= F.col("confident")) & (elbow <= 3), F.greatest(F.lit(2), F.least(base, elbow))).when(gap <= F.col("ambiguous"), F.greatest(base, F.col("more"))).otherwise(base)
    return every.withColumn("k", k).groupBy("trial").agg(F.avg("k").alias("avg_k"), F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))


def validate_answers(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts for predictions (id, question, answer) against expected (id, question)."""
    p, e = predicted.select(F.col("id").alias("pid"), F.col("question").alias("pq"), "answer"), expected.select(F.col("id").alias("eid"), F.col("question").alias("eq"))
    both = p.join(e, F.col("pid") == F.col("eid"), "full_outer")
    matched = F.col("pid").isNotNull() & F.col("eid").isNotNull()
    words = F.when(F.col("pid").isNotNull(), F.size(F.filter(F.split(F.trim(F.coalesce("answer", F.lit(""))), r"\s+"), lambda w: w != "")))
    return both.agg(F.count("eid").alias("expected"), F.count("pid").alias("predicted"), F.count_if(F.col("pid").isNull()).alias("missing"), F.count_if(F.col("eid").isNull()).alias("extra"), F.count_if(matched & ~F.col("pq").eqNullSafe(F.col("eq"))).alias("mismatched"), F.count_if(F.col("pid").isNotNull() & F.coalesce("answer", F.lit("")).rlike(r"(?U)^\s*$")).alias("blank"), F.min(words).alias("min_words"), F.max(words).alias("max_words"))


def truncations(lengths: DataFrame, column: str, limits: tuple[int, ...]) -> DataFrame:
    """(limit, truncated): values longer than each limit, counted in one pass."""
    one = lengths.agg(*[F.count_if(F.col(column) > m).alias(str(m)) for m in limits])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("limit"), F.col(f"`{m}`").alias("truncated")) for m in limits])).alias("x")).select("x.*")


def generate(questions: DataFrame, answer, schema: str) -> DataFrame:
    """Runs a pluggable generator over batches: ``answer`` takes and gives pandas frames, loaded once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield answer(batch)

    return questions.mapInPandas(run, schema)


def resume(asked: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is still to do: rows whose key is not done yet."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def floor_percentiles(df: DataFrame, by: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """(by..., share, value): the value at the place floor((n - 1) * share) of each group's ordered values, nulls left out.

    Values are counted first, so that no group is gathered: a window goes over the distinct values of a group.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(column).alias("_value")).agg(F.count("*").alias("_c"))
    keys = [f"_by{i}" for i in range(len(by))]
    whole = Window.partitionBy(*keys)
    upto = F.sum("_c").over(whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(whole)}).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    place = F.floor((F.col("_n") - 1) * F.col("share"))
    return placed.where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "share", F.col("_value").alias("value"))


def answer_cases(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, prediction, reference, slices, errors) of expected answers (id, question, answer); a missing prediction is empty."""
    e = expected.select("id", "question", F.coalesce("answer", F.lit("")).alias("reference"))
    joined = e.join(predicted.select("id", F.coalesce("answer", F.lit("")).alias("prediction")), "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    return joined.select("id", "prediction", "reference", T.slice_labels(F.coalesce("question", F.lit("")), F.col("reference")).alias("slices"), T.error_labels(F.col("prediction"), F.col("reference")).alias("errors"))


def scored_cases(cases: DataFrame) -> DataFrame:
    """``answer_cases`` with ``meteor`` and ``rouge_l``."""
    tokens = cases.select("id", T.word_tokens(F.col("prediction")).alias("p"), T.word_tokens(F.col("reference")).alias("r"))
    scores = M.meteor(tokens, "p", "r").join(tokens.select("id", M.rouge_l(F.col("p"), F.col("r"), 1.2).alias("rouge_l")), "id")
    return cases.join(scores, "id")


def answer_report(scored: DataFrame) -> DataFrame:
    """(section, name, n, meteor, rouge_l): macro averages of all cases and of each slice, counts of errors and empty answers."""
    means = [F.count("*").alias("n"), F.avg("meteor").alias("meteor"), F.avg("rouge_l").alias("rouge_l")]
    slices = scored.select(F.explode("slices").alias("name"), "meteor", "rouge_l").groupBy("name").agg(*means).select(F.lit("slice").alias("section"), "name", "n", "meteor", "rouge_l")
    empty = F.when(F.trim("prediction") == "", F.array(F.lit("EMPTY_RATE"))).otherwise(F.array().cast("array<string>"))
    labels = scored.select(F.explode(F.concat("errors", empty)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    return slices.unionByName(labels.select(F.lit("error").alias("section"), "name", "n", none.alias("meteor"), none.alias("rouge_l")))


def best_and_worst(candidate: DataFrame, parent: DataFrame, score: str = "score", top: int = 20) -> DataFrame:
    """(side, position, id, delta): the ``top`` best gains and worst losses of a run against another, ties by id."""
    deltas = candidate.select("id", F.col(score).alias("new")).join(parent.select("id", F.col(score).alias("old")), "id").select("id", F.round(F.col("new") - F.col("old"), 12).alias("delta"))
    sides = []
    for side, order in (("gain", F.desc("delta")), ("loss", F.asc("delta"))):
        first = deltas.orderBy(order, "id").limit(top)
        sides.append(first.withColumn("position", F.row_number().over(Window.orderBy(order, "id"))).select(F.lit(side).alias("side"), "position", "id", "delta"))
    return sides[0].unionByName(sides[1])


def relevant_hits(ranking: DataFrame, gold: DataFrame, gold_parents: DataFrame, parents: DataFrame) -> DataFrame:
    """``ranking`` with ``relevant``: its document is gold, or its parent is; two joins instead of one with an OR.

    gold (query_id, doc_id), gold_parents (query_id, parent_id), parents (doc_id, parent_id).
    """
    yes = F.lit(True)
    marked = ranking.join(gold.select("query_id", "doc_id").distinct().withColumn("_d", yes), ["query_id", "doc_id"], "left")
    marked = marked.join(parents.select("doc_id", "parent_id").distinct(), "doc_id", "left").join(gold_parents.select("query_id", "parent_id").distinct().withColumn("_p", yes), ["query_id", "parent_id"], "left")
    return marked.withColumn("relevant", F.coalesce("_d", F.lit(False)) | F.coalesce("_p", F.lit(False))).drop("_d", "_p")


def agent_metrics(queries: DataFrame, ranking: DataFrame, answers: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall and reciprocal rank of answerable queries (query_id, answerable), how often abstaining was right,
    and how often all citations of an answer (query_id, citations, abstained) stand in the ranking."""
    top = ranking.where(F.col("rank") <= k)
    first = top.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    held = top.groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("held"))
    rows = queries.join(first, "query_id", "left").join(held, "query_id", "left").join(answers.select("query_id", "citations", "abstained"), "query_id", "left")
    whole = F.size(F.array_except(F.coalesce("citations", F.array().cast("array<string>")), F.coalesce("held", F.array().cast("array<string>")))) == 0
    can = F.col("answerable")
    return rows.agg(
        F.count("*").alias("queries"), F.count_if(can).alias("answerable"), F.avg(F.when(can, F.col("first").isNotNull().cast("double"))).alias("recall"), F.avg(F.when(can, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        F.avg((F.coalesce("abstained", F.lit(True)) != can).cast("double")).alias("abstention_accuracy"), F.avg(whole.cast("double")).alias("citation_integrity"),
    )


def retrieval_report(ranking: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """(scope, queries, mrr, recall_k..., hit_k..., ndcg_k..., first_ndcg) over the labels of high confidence and over all.

    labels (query_id, doc_id, confidence). Unlabelled queries are left out; ``first_ndcg`` is the gain of the first hit.
    """
    scopes = []
    for scope, part in (("HIGH", labels.where("confidence = 'HIGH'")), ("ALL", labels)):
        m = M.retrieval_metrics(ranking, part, ks)
        first = F.when(F.col("rr") > 0, 1 / F.log2(1 / F.col("rr") + 1)).otherwise(0.0)
        means = [F.round(F.avg(c), 6).alias(n) for c, n in [("rr", "mrr"), *[(f"{x}_{k}", f"{x}_{k}") for k in ks for x in ("recall", "hit", "ndcg")]]]
        scopes.append(m.agg(F.lit(scope).alias("scope"), F.count("*").alias("queries"), *means, F.round(F.avg(first), 6).alias("first_ndcg")))
    return scopes[0].unionByName(scopes[1])


def token_report(df: DataFrame, by: str, tokens, limits: tuple[int, ...], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, name, value): number, mean and percentiles of token counts of each group, and how many exceed each limit.

    ``tokens`` is a column of token counts: of words, or of any tokenizer as a function over batches.
    """
    counted = df.select(by, tokens.cast("bigint").alias("n"))
    sums = counted.groupBy(by).agg(F.count("n").cast("double").alias("count"), F.round(F.avg("n"), 4).alias("mean"), *[F.count_if(F.col("n") > m).cast("double").alias(f"over_{m}") for m in limits])
    names = [c for c in sums.columns if c != by]
    flat = sums.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("x")).select(by, "x.name", "x.value")
    places = floor_percentiles(counted, [by], "n", shares).select(by, F.concat(F.lit("p"), F.round(F.col("share") * 100).cast("int").cast("string")).alias("name"), F.col("value").cast("double").alias("value"))
    return flat.unionByName(places)


def file_report(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """``answer_report`` of prediction and reference records (id, question, answer) as ``readers.read_qa`` gives them."""
    return answer_report(scored_cases(answer_cases(predictions, references)))
