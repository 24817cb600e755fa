"""Problem 9: mixing sources to target weights.

Soft-membership mixing. A classifier of word counts, trained on documents of known source (the labelled table),
predicts for every document a posterior over the sources of the target table. Document rates (expected copies) between
0 and the source's repeat cap are fitted by projected-gradient least squares, so that the largest mix that the caps
allow meets two sets of totals: the tokens drawn from each source, which have to have the target shares, and the
expected tokens of each domain, by posterior, which should have them. Within a source, documents whose text looks like
a wanted domain thus get higher rates. Where both can't be met the sources count ``LABEL_WEIGHT`` times as much, and at
last the rates of each source are shifted to its total. A document without a source in the target table is drawn for
the most likely one. Whole copies are then drawn systematically along the running total of the rates within each source, so
that drawn and expected tokens differ by little.

No document state is kept between gradient steps: the projection is of the sum of all steps so far (dual averaging), so
the rates after any number of steps follow from one multiplier for each total, and a step is one pass over (source,
tokens, posterior) that sends one sum for each total. Null and empty texts have no tokens and are not drawn. Sources
without documents have a target that can't be met: it is left out, and the shares of the others are scaled. Without
targets the mix is empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.words import word_hashes
from tamarack.operators.skew import bounded
from tamarack.session import materialise

#: Folder of the public tokenizers' files and the vocabulary used to measure size.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents that the classifier is trained on, its hashed word counts, and the gradient steps.
FIT, BUCKETS, STEPS = 20_000, 1 << 14, 20
#: Weight of a source's own total against that of its domain, and the largest error, as a share of the mix, at which
#: the fit ends; it also ends after two steps that hardly better it.
LABEL_WEIGHT, CLOSE = 4.0, 1e-3
#: Parts of the labelled sample that the temperature of the posteriors is fitted on: one in so many.
HELD_OUT = 5
#: Buckets of a size class in the running total of a source at least, size classes, and documents for which there is one
#: bucket more: no task orders more than a bucket.
STRATA, SIZES_PER_E, STRATUM = 64, 16, 1_000_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; null has none."""
    encode = _encoding(path).encode_ordinary
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, hashes = word_hashes(texts)
    return offsets, (hashes % np.uint64(BUCKETS)).astype(np.int64)


class Classifier:
    """Multinomial naive Bayes of hashed words; ``sharpness`` scales the evidence so that posteriors are calibrated."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray, sharpness: float = 1.0) -> None:
        smooth = counts + 0.5
        self.weights = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T)
        self.weights -= self.weights.mean(axis=1, keepdims=True)
        self.prior, self.sharpness = np.log((documents + 1.0) / (documents + 1.0).sum()), sharpness

    def evidence(self, offsets: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """(documents, sources): summed log weights of each document's words."""
        out = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        some = np.flatnonzero(np.diff(offsets))
        for first in range(0, len(some), 64):  # the looked-up weights of some documents at a time
            part = some[first : first + 64]
            a, b = offsets[part[0]], offsets[part[-1] + 1]
            out[part] = np.add.reduceat(self.weights[bucket[a:b]], offsets[part] - a, axis=0)
        return out

    def posteriors(self, evidence: np.ndarray) -> np.ndarray:
        score = self.prior + self.sharpness * evidence
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train_classifier(docs: DataFrame, sources: list[str], limit: int = FIT) -> tuple[Classifier, dict[str, float]]:
    """(classifier, quality) from ``limit`` documents of known source, chosen by a hash of the key (of more documents
    each is chosen with the same chance, so that their number keeps to the limit but for a few in a thousand).

    The evidence is scaled on a held-out part of the sample, where the quality is measured too: accuracy, the mean
    probability of the predicted source (equal to the accuracy if posteriors are calibrated), and the share of the
    most frequent source. What reaches the driver is one count for each source and hashed word, and one vector for each
    held-out document.
    """
    index = {s: k for k, s in enumerate(sources)}
    labelled = docs.where(F.col("source").isin(sources) & F.col("text").isNotNull()).select("source", "text", F.xxhash64("key").alias("h"))
    share = min(1.0, limit / max(labelled.count(), 1))
    taken = F.shiftrightunsigned("h", 32) < int(share * (1 << 32))
    chosen = materialise(labelled.where(taken).select("source", "text", (F.pmod("h", F.lit(HELD_OUT)) == 0).alias("held")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros((len(sources), BUCKETS), np.int64), np.zeros(len(sources), np.int64)
        for batch in batches:
            offsets, bucket = _counts(batch.column(1))
            named = np.array([index[s] for s in batch.column(0).to_pylist()], np.int64)
            total += np.bincount(np.repeat(named, np.diff(offsets)) * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
            documents += np.bincount(named, minlength=len(sources))
        for k in np.flatnonzero(documents):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int(documents[k])]), pa.array([total[k].tolist()], pa.list_(pa.int64()))], ["k", "n", "counts"])

    sums, seen = np.zeros((len(sources), BUCKETS)), np.zeros(len(sources))
    for row in chosen.where("NOT held").select("source", "text").repartition(8).mapInArrow(count, "k int, n bigint, counts array<bigint>").collect():
        sums[row.k] += row.counts
        seen[row.k] += row.n
    model = Classifier(sums, seen)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.evidence(*_counts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([index[s] for s in batch.column(0).to_pylist()], pa.int32()), _rows(found)], ["k", "e"])

    rows = chosen.where("held").select("source", "text").mapInArrow(weigh, "k int, e array<double>").toArrow()
    if not rows.num_rows:
        return model, {"accuracy": 0.0, "confidence": 0.0, "most_frequent": 0.0, "documents": 0.0}
    truth, evidence = np.asarray(rows["k"]), np.stack(rows["e"].to_pylist())

    def surprise(sharpness: float) -> float:
        model.sharpness = sharpness
        return float(-np.log(np.maximum(model.posteriors(evidence)[np.arange(len(truth)), truth], 1e-12)).mean())

    model.sharpness = min((0.0, *np.geomspace(1e-3, 2.0, 60)), key=surprise)
    p = model.posteriors(evidence)
    quality = {"accuracy": float((p.argmax(axis=1) == truth).mean()), "confidence": float(p.max(axis=1).mean()), "most_frequent": float(np.bincount(truth).max() / len(truth)), "documents": float(len(truth))}
    return model, quality


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def memberships(docs: DataFrame, sources: list[str], model: Classifier, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, s, tokens, posterior) of docs (key, source, text): the number of the known source, -1 without one, and the
    posterior of every document over all sources."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    index, path = {s: k for k, s in enumerate(sources)}, f"{tokenizers}/{vocabulary}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, named = batch.column(2).to_pylist(), [index.get(s, -1) for s in batch.column(1).to_pylist()]
            p = sent.value.posteriors(sent.value.evidence(*_counts(batch.column(2)))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.int32()), pa.array(count_tokens(texts, path)), _rows(p)], ["key", "s", "tokens", "posterior"])

    kind = docs.schema["key"].dataType.simpleString()
    measured = docs.select("key", "source", "text").mapInArrow(measure, f"key {kind}, s int, tokens bigint, posterior array<float>")
    return materialise(measured.where("tokens > 0"), "members")


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, matrix) of columns s and posterior: the source a document is drawn for, which is its own or else the most
    likely one, and its parts in the totals of the sources and of the domains."""
    named = batch.column(0).to_numpy(zero_copy_only=False)
    posterior = np.asarray(batch.column(1).flatten(), float).reshape(-1, k)
    home = np.where(named >= 0, named, posterior.argmax(axis=1))
    return home, np.concatenate([np.eye(k)[home], posterior], axis=1)


def rates(home: np.ndarray, matrix: np.ndarray, caps: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Document rates: all steps so far along the memberships and by source, projected to the caps."""
    return np.clip(1.0 + matrix @ multipliers + shifts[home], 0, caps[home])


def fit_rates(members: DataFrame, shares: np.ndarray, caps: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(multipliers, shifts, quality) of the projected-gradient fit.

    The objective is the squared error of the drawn tokens of each source and the expected tokens of each domain. The
    gradient is scaled by its curvature, the matrix of the products of memberships over the documents within their
    bounds, which the same pass sums up.
    """
    k, spark = len(shares), members.sparkSession

    def expected(multipliers: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the documents: drawn tokens by source and domain, products of memberships, all tokens, and for the
        source that each document is drawn for its drawn tokens, the most that can be drawn, and those within bounds."""
        sent = spark.sparkContext.broadcast((multipliers, shifts))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2 * k + 4, 2 * k))
            for batch in batches:
                home, matrix = _matrix(batch.select(["s", "posterior"]), k)
                tokens = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                r = rates(home, matrix, caps, *sent.value)
                inside = (r > 0) & (r < caps[home])
                weighted = matrix * tokens[:, None]
                sums[0] += r @ weighted
                sums[1] += weighted.sum(axis=0)
                sums[2, :k] += np.bincount(home, r * tokens, minlength=k)
                sums[2, k:] += np.bincount(home, caps[home] * tokens, minlength=k)
                sums[3, :k] += np.bincount(home, inside * tokens, minlength=k)
                sums[3, k:] += np.bincount(home, tokens, minlength=k)
                sums[4:] += matrix[inside].T @ weighted[inside]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), _rows(sums)], ["k", "v"])

        parts = members.select("s", "tokens", "posterior").mapInArrow(gather, "k int, v array<double>")
        summed = parts.select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((2 * k + 4, 2 * k))
        for row in summed:
            out[row.k, row.i] = row.v
        return out[0], out[4:], out[1], out[2:4].reshape(4, k)

    multipliers, shifts = np.zeros(2 * k), np.zeros(k)
    drawn, curvature, tokens, homes = expected(multipliers, shifts)
    present = homes[1] > 0
    shares = np.where(present, shares, 0)
    if not shares.sum():
        return multipliers, shifts, {"total": 0.0, "steps": 0.0, "domain_error": 0.0}
    shares = shares / shares.sum()
    total = float(np.min(np.where(shares > 0, homes[1] / np.maximum(shares, 1e-12), np.inf)))
    target, weight = np.tile(shares * total, 2), np.repeat([LABEL_WEIGHT, 1.0], k)
    used, stalled, best = 0, 0, (np.inf, multipliers)
    for used in range(1, steps + 1):
        error = target - drawn
        loss = float((weight * error**2).sum())
        stalled = 0 if loss < best[0] * (1 - 5e-2) else stalled + 1
        if loss < best[0]:
            best = (loss, multipliers)
        if np.abs(weight * error).max() <= CLOSE * total or stalled == 2:
            break
        scaled = curvature * np.sqrt(weight)[:, None] * np.sqrt(weight)[None, :]
        damped = scaled + np.diag(0.02 * weight * tokens + 1.0)  # totals whose documents are all at their bounds have no curvature
        multipliers = multipliers + np.clip(np.sqrt(weight) * np.linalg.solve(damped, np.sqrt(weight) * error), -1.0, 1.0)
        drawn, curvature, _, _ = expected(multipliers, shifts)
    multipliers = best[1]
    for _ in range(steps):  # a source's total rises with its shift, so that this meets every total the caps allow
        drawn, _, _, homes = expected(multipliers, shifts)
        error = shares * total - homes[0]
        if np.abs(error).max() <= CLOSE * total:
            break
        shifts = shifts + np.where(present, error / np.maximum(homes[2], 0.2 * np.maximum(homes[3], 1)), 0)
    return multipliers, shifts, {"total": total, "steps": float(used), "domain_error": float(np.abs(target[k:] - drawn[k:]).max() / total)}


def mix(docs: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) of docs (key, source, text) and targets (source, target_share, max_repeats).

    drawn: (key, source, tokens, rate, copies), copies at least 1; shares: (source, target_share, tokens, share,
    repeats), with the drawn tokens of each source and its most copies of one document.
    """
    spark = docs.sparkSession
    wanted = sorted(((r.source, r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL AND target_share > 0").collect()), key=lambda x: x[0])
    sources = [w[0] for w in wanted]
    if not wanted:
        key = docs.schema["key"].dataType.simpleString()
        nothing = targets.select("source", "target_share", "max_repeats", F.lit(0).cast("bigint").alias("tokens"), F.lit(0.0).alias("share"), F.lit(0).alias("repeats"))
        return spark.createDataFrame([], f"key {key}, source string, tokens bigint, rate double, copies int"), nothing.where("source IS NOT NULL")
    caps = np.array([max(int(w[2] or 1), 0) for w in wanted], float)
    model, _ = train_classifier(docs, sources)
    members = memberships(docs, sources, model, tokenizers, vocabulary)
    multipliers, shifts, _ = fit_rates(members, np.array([w[1] for w in wanted], float), caps)
    sent = spark.sparkContext.broadcast((multipliers, shifts))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, matrix = _matrix(batch.select(["s", "posterior"]), len(caps))
            r = rates(home, matrix, caps, *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home, pa.int32()), batch.column(1), pa.array(r), pa.array(caps[home].astype(int), pa.int32())], ["key", "s", "tokens", "rate", "most"])

    kind = members.schema["key"].dataType.simpleString()
    rated = members.select("key", "tokens", "s", "posterior").mapInArrow(rate, f"key {kind}, s int, tokens bigint, rate double, most int")
    rated = materialise(rated.withColumn("h", F.xxhash64("key")), "rated")
    # Systematic drawing along the running total of rates, shorter documents first, so that each draw spans all sizes
    # and drawn tokens follow expected tokens: the total before each bucket, then within the bucket.
    size = F.floor(F.ln("tokens") * SIZES_PER_E).cast("int")
    strata = max(STRATA, -(-rated.count() // STRATUM))
    rated = rated.withColumn("bucket", size.cast("bigint") * strata + F.pmod(F.shiftright("h", 20), F.lit(strata)))
    sums = rated.groupBy("s", "bucket").agg(F.sum("rate").alias("r"))
    sums = sums.select("s", "bucket", F.coalesce(F.sum("r").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inner = Window.partitionBy("s", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rated.withColumn("upto", F.sum("rate").over(inner)).join(bounded(sums), ["s", "bucket"])
    end = F.floor(F.col("before") + F.col("upto") + 0.5 + 1e-9)
    start = F.floor(F.col("before") + F.col("upto") - F.col("rate") + 0.5 + 1e-9)
    names = F.create_map(*[x for k, s in enumerate(sources) for x in (F.lit(k), F.lit(s))])
    drawn = placed.select("key", names[F.col("s")].alias("source"), "tokens", "rate", F.least((end - start).cast("int"), "most").alias("copies")).where("copies > 0")
    drawn = materialise(drawn, "drawn")
    by = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"))
    asked = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats")
    whole = Window.partitionBy()
    shares = asked.join(by, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    shares = shares.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)))
    return drawn, shares.select("source", "target_share", "max_repeats", "tokens", "share", "repeats")
