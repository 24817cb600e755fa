"""Problem 10: reading level of each document.

Regularised ordinal regression (proportional odds) on features of lexical diversity, word rarity, connectives, a proxy
for clause depth, and lengths, calibrated to the bands of rated documents. Word rarity comes from word counts over all
documents, in a sketch of fixed size. The model is fitted on at most ``FIT`` ratings, chosen by a hash.

Null and empty texts have zero words and come out in the easiest band. A document rated several times counts once per
rating. Without any rating every document comes out in band 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.words import consistent_array, words_of
from tamarack.session import materialise

#: Ratings that the model is fitted on at most; counters of the word sketch (2**18 eight-byte numbers, 2 MB).
FIT, SKETCH_BITS = 20_000, 18
#: Parts of the sketch that are summed apart.
SLICES = 64
#: Weight of the squared coefficients in the fit, per rating.
RIDGE = 0.002

# Connectives of Vietnamese and English, by kind.
CONNECTIVES = {
    "condition": "nếu khi trừ if unless when before after until provided where",
    "relative": "mà thì rằng which that whom whose such",
    "cause": "do vì bởi nhằm để because since therefore so",
    "addition": "và cùng với hoặc and or also",
    "contrast": "nhưng tuy dù mặc song but although notwithstanding however despite not",
    "reference": "theo căn cứ khoản điều trên tại under of by in",
}
_SENTENCES = r"[.!?;…]+(?:\s+|$)|\n+"
_LENGTHS = np.array([5, 8, 11, 15, 20, 26, 34, 44, 58])
_RARITY = np.array([5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0])
_DEPTHS = np.array([0, 1, 2, 3, 5])
_GROUPS = {k: np.array(sorted(xxhash.xxh3_64_intdigest(w) for w in v.split()), np.uint64) for k, v in CONNECTIVES.items()}


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def word_sketch(texts: DataFrame) -> np.ndarray:
    """Counts of words over all texts (column 0).

    Each task sends its sketch in slices, and a slice is summed in one task, so that no task reads all sketches.
    """
    width = (1 << SKETCH_BITS) // SLICES
    kind = "slice int, counts binary"

    def rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = [k for k in range(SLICES) if total[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in used], pa.binary())], ["slice", "counts"])

    def add_all(total: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k * width : (k + 1) * width] += np.frombuffer(zlib.decompress(counts), np.int64)
        return total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            words = words_of(batch.column(0))[1].dictionary_encode()
            each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
            np.add.at(total, _bucket(each), np.bincount(np.asarray(words.indices), minlength=len(each)) if len(each) else 0)
        yield from rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(add_all(np.zeros(1 << SKETCH_BITS, np.int64), batches))

    summed = texts.mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).toArrow()
    return add_all(np.zeros(1 << SKETCH_BITS, np.int64), iter(summed.to_batches()))


def features(texts: pa.Array, sketch: np.ndarray) -> np.ndarray:
    """(texts, features), row by row independent of the other texts of the batch."""
    texts = consistent_array(texts)
    n = len(texts)
    lists = pc.split_pattern_regex(texts, _SENTENCES)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    so = np.asarray(lists.offsets, dtype=np.int64)
    sentences = lists.values.slice(so[0], so[-1] - so[0])
    so = so - so[0]
    offsets, words = words_of(sentences, form=False)
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, np.asarray(coded.indices)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    size = np.asarray(pc.utf8_length(vocabulary)).astype(float)
    rarity = -np.log((sketch[_bucket(each)] + 1.0) / (sketch.sum() + 1.0))
    per = np.diff(offsets)
    doc_of_sentence = np.repeat(np.arange(n), np.diff(so))
    doc = np.repeat(doc_of_sentence, per)
    total = np.bincount(doc, minlength=n).astype(float)
    safe = np.maximum(total, 1)
    count = np.maximum(np.bincount(doc_of_sentence[per > 0], minlength=n), 1).astype(float)
    cols = [np.log1p(total), total / count]

    def shares(bins: np.ndarray, owner: np.ndarray, weight: np.ndarray | None, k: int) -> None:
        cols.extend(np.bincount(owner * k + bins, weight, minlength=n * k).reshape(n, k).T / safe)

    def mean(value: np.ndarray) -> np.ndarray:
        return np.bincount(doc, value[code], minlength=n) / safe

    weight = per.astype(float)
    shares(np.searchsorted(_LENGTHS, per), doc_of_sentence, weight, len(_LENGTHS) + 1)
    commas = np.asarray(pc.count_substring(sentences, ",")).astype(float)
    deep = np.zeros(len(vocabulary))
    for name, group in _GROUPS.items():
        hit = np.isin(each, group).astype(float)
        cols.append(mean(hit))
        if name in ("condition", "relative", "contrast", "cause"):
            deep += hit
    marks = commas + np.bincount(np.repeat(np.arange(len(per)), per), deep[code], minlength=len(per))
    cols.append(np.bincount(doc_of_sentence, commas, minlength=n) / safe)
    shares(np.searchsorted(_DEPTHS, marks), doc_of_sentence, weight, len(_DEPTHS) + 1)
    cols.append(mean(rarity))
    shares(np.searchsorted(_RARITY, rarity)[code], doc, None, len(_RARITY) + 1)
    cols += [mean(size), mean((size >= 7).astype(float))]
    pairs = np.sort(doc * max(len(vocabulary), 1) + code)
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    distinct = np.bincount(pairs[first] // max(len(vocabulary), 1), minlength=n)
    cols += [distinct / safe, distinct / np.sqrt(safe)]
    ascii_share = np.asarray(pc.binary_length(texts.cast(pa.large_binary()))) / np.maximum(np.asarray(pc.utf8_length(texts)), 1)
    english = (ascii_share < 1.05) & (mean((size >= 8).astype(float)) > 0.02)
    x = np.stack(cols, axis=1)
    return np.concatenate([x, x * english[:, None], english[:, None].astype(float)], axis=1)


class OrdinalModel:
    """Proportional odds: P(band <= k) = logistic(cut_k - x w), fitted with ridge by accelerated gradient descent."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.cuts = mean, scale, weights, cuts

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bands: int, ridge: float = RIDGE, steps: int = 3000) -> OrdinalModel:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.clip((x - mean) / scale, -6, 6)
        n, d = z.shape
        shares = np.clip(np.cumsum(np.bincount(y, minlength=bands)[:-1]) / n, 0.005, 0.995)
        cuts = np.log(shares / (1 - shares))
        p = np.concatenate([np.zeros(d), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
        v, rate = np.zeros_like(p), 0.02
        m2 = np.zeros_like(p)
        for step in range(1, steps + 1):
            w, c = p[:d], np.concatenate([[p[d]], p[d] + np.cumsum(np.exp(p[d + 1 :]))])
            eta = z @ w
            hi = np.where(y < bands - 1, 1 / (1 + np.exp(-np.clip(np.append(c, 0)[y] - eta, -40, 40))), 1.0)
            lo = np.where(y > 0, 1 / (1 + np.exp(-np.clip(np.insert(c, 0, 0)[y] - eta, -40, 40))), 0.0)
            prob = np.maximum(hi - lo, 1e-12)
            dh, dl = hi * (1 - hi) / prob, lo * (1 - lo) / prob
            grad_w = z.T @ (dh - dl) / n + ridge * w
            gc = np.array([(dl[y == k + 1].sum() - dh[y == k].sum()) / n for k in range(bands - 1)])
            tail = np.cumsum(gc[::-1])[::-1]
            g = np.concatenate([grad_w, [tail[0]], tail[1:] * np.exp(p[d + 1 :])])
            v, m2 = 0.9 * v + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            p = p - rate * (1 - step / (steps + 1)) * (v / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(mean, scale, p[:d], np.concatenate([[p[d]], p[d] + np.cumsum(np.exp(p[d + 1 :]))]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        eta = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - eta[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)


def fit_levels(docs: DataFrame, ratings: DataFrame, sketch: np.ndarray, key: str = "doc_id", text: str = "text", band: str = "band", limit: int = FIT) -> tuple[OrdinalModel | None, list[int]]:
    """The model of ratings (key, band) of docs (key, text), and the bands it knows in ascending order."""
    rated = ratings.select(F.col(key).alias("k"), F.col(band).cast("int").alias("band")).where("k IS NOT NULL AND band IS NOT NULL")
    chosen = materialise(rated.orderBy(F.xxhash64("k", "band"), "k", "band").limit(limit), "ratings")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi")
    width = features(pa.array(["x"], pa.large_string()), sketch).shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))], ["k", "x"])

    kind = texts.schema["k"].dataType.simpleString()
    rows = texts.mapInArrow(measure, f"k {kind}, x array<double>").join(chosen, "k").select("x", "band").toArrow()
    if rows.num_rows == 0:
        return None, []
    y = np.asarray(rows["band"])
    known = sorted({int(b) for b in y})
    x = np.asarray(rows["x"].combine_chunks().values if isinstance(rows["x"], pa.ChunkedArray) else rows["x"].values).reshape(-1, width)
    order = np.lexsort((*x.T[:4], y))
    if len(known) < 2:
        return None, known
    return OrdinalModel.fit(x[order], np.searchsorted(known, y[order]), len(known)), known


def reading_levels(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", band: str = "band") -> DataFrame:
    """(key, band, level) of every document: the most likely band, and the expected band as a finer scale."""
    sketch = word_sketch(docs.select(text))
    model, known = fit_levels(docs, ratings, sketch, key, text, band)
    known = known or [1]
    sent = docs.sparkSession.sparkContext.broadcast((sketch, model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, fitted = sent.value
            if fitted is None:
                probs = np.ones((batch.num_rows, 1)) if len(known) == 1 else np.eye(len(known))[np.zeros(batch.num_rows, int)]
            else:
                probs = fitted.probabilities(features(batch.column(1), counts))
            bands = np.array(known)
            blank = np.asarray(pc.fill_null(pc.equal(pc.utf8_trim_whitespace(pc.fill_null(batch.column(1), "")), ""), True))
            level = np.where(blank, bands[0], probs @ bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(blank, bands[0], bands[probs.argmax(axis=1)]), pa.int64()), pa.array(level)], [key, "band", "level"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(judge, f"{key} {kind}, band bigint, level double")
