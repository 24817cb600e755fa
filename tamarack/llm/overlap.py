"""Problem 4: records of evaluation splits that recur, equal or nearly so, in the training split.

All evaluation records are cut into shards of bounded size, and each shard is written once as a compressed full-text
index of its words: the transform as steps between the positions of each symbol, and a sample of the suffix array.
Training records are streamed through backward search of the shards that can hold a match, which gives their matches
with each evaluation record; matches on one diagonal are merged to maximal spans, and spans are counted as shared runs
of words. The likeness that follows from the counts is exact.

Which shards a training record visits comes from the partitioned byte index of ``setjoin``: without that routing each
training record would visit every shard, which grows with the square of the input.

Null and empty answers, and answers without words, count as missing: then questions alone are compared. Records with
fewer than three words have no match. An id that is delivered again counts once. Equal records are searched once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import setjoin
from tamarack.llm.words import distinct_sorted, list_array, list_parts, mix, run_hashes, word_hashes
from tamarack.session import materialise

#: Words of a run; evaluation records in one shard; visits in one task of a shard; places of the text per kept place
#: of the suffix array.
RUN, SHARD, VISITS, SAMPLE = 3, 256, 2048, 16


def record_words(records: DataFrame) -> DataFrame:
    """(id, side, kind, has, sig, words, row) of records (id, side, question, answer).

    kind 1 is question and answer, kind 0 the question alone; a record with an answer (``has``) has both, as it may
    meet records without one. side 0 is training, 1 evaluation. ``sig`` is a hash of the words, the kind and ``has``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            oq, hq = word_hashes(batch.column(2))
            oa, ha = word_hashes(batch.column(3))
            has = np.diff(oa) > 0
            lengths = np.diff(oq) + np.diff(oa)
            both = np.concatenate([[0], np.cumsum(lengths)])
            joined = np.empty(both[-1], np.uint64)
            from_q = np.repeat(both[:-1] - oq[:-1], np.diff(oq)) + np.arange(len(hq))
            joined[from_q] = hq
            joined[np.repeat(both[:-1] + np.diff(oq) - oa[:-1], np.diff(oa)) + np.arange(len(ha))] = ha
            for kind, offsets, hashes, kept in ((0, oq, hq, np.diff(oq) >= RUN), (1, both, joined, has & (lengths >= RUN))):
                chosen = pa.array(kept)
                sig = _sequence_hash(offsets, hashes) ^ np.where(has, 0x5851F42D4C957F2D, 0) ^ np.int64(kind * 0x2545F4914F6CDD1D)
                columns = [batch.column(0), batch.column(1), pa.array(np.full(n, kind), pa.int32()), pa.array(has), pa.array(sig), list_array(offsets, hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays([c.filter(chosen) for c in columns], ["id", "side", "kind", "has", "sig", "words"])

    given = records.select(F.col("id").cast("string").alias("id"), F.col("side").cast("int").alias("side"), F.col("question").alias("q"), F.col("answer").alias("a")).where("id IS NOT NULL AND side IS NOT NULL")
    return given.mapInArrow(read, "id string, side int, kind int, has boolean, sig bigint, words array<bigint>").withColumn("row", F.monotonically_increasing_id())


def _sequence_hash(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each record's sequence of words."""
    at = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    with np.errstate(over="ignore"):
        placed = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + mix((at + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(placed, dtype=np.uint64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, entry, side) of a batch (row, side, kind, has, words).

    The entry also says which texts may meet. Texts of kind 1 meet kind 1. Of kind 0, training texts without an answer
    meet all, others meet evaluation texts without an answer only, so each pair meets in one class of entries.
    """
    offsets, values = list_parts(batch.column(4))
    keys = setjoin.entries(setjoin.signatures(*run_hashes(offsets, values.view(np.uint64), RUN)))
    row, side, kind, has = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    classes = ((kind == 0) & ((side == 0) | ~has), (kind == 0) & (((side == 0) & ~has) | ((side == 1) & has)), kind == 1)
    for k, members in enumerate(classes):
        at = np.repeat(np.flatnonzero(members), keys.shape[1])
        with np.errstate(over="ignore"):
            entry = mix(keys[members].ravel().view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        yield row[at], entry, side[at].astype(np.int64)


class FmIndex:
    """Full-text index of word sequences: backward search gives all places of a run of words.

    Written (``to_bytes``) it holds the symbols, the sequences' lengths, the steps between the positions of each symbol
    in the transform, and every ``SAMPLE``-th place of the suffix array. Read (``from_bytes``) the other places are
    found by walking from the kept ones, all at once.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, suffixes: np.ndarray) -> None:
        self.symbols, self.lengths, self.suffixes = symbols, lengths, suffixes
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.size = int(self.starts[-1]) + 1
        self.ranks = ranks  # symbol * (size + 1) + position in the transform, ascending
        self.first = np.searchsorted(ranks, np.arange(len(symbols) + 2) * (self.size + 1))

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> FmIndex:
        symbols = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(int(starts[-1]) + 1, np.int64)  # 0 ends a sequence; the last 0 is the text's end
        for start, s in zip(starts, sequences):
            text[start : start + len(s)] = np.searchsorted(symbols, s) + 1
        suffixes = cls._suffixes(text)
        bwt = text[suffixes - 1]
        order = np.argsort(bwt, kind="stable")
        whole = int(np.flatnonzero(order == np.flatnonzero(suffixes == 0)[0])[0])
        order[: whole + 1] = np.roll(order[: whole + 1], 1)  # what stands before the whole text is its end, the least suffix
        return cls(symbols, lengths, bwt[order] * (len(text) + 1) + order, suffixes)

    def to_bytes(self) -> bytes:
        symbol, position = np.divmod(self.ranks, self.size + 1)
        steps = np.diff(position, prepend=0)
        kept = np.flatnonzero(self.suffixes % SAMPLE == 0)
        parts = (self.symbols, self.lengths.astype(np.int32), np.bincount(symbol, minlength=len(self.symbols) + 1).astype(np.int32), steps.astype(np.int32), np.diff(kept, prepend=0).astype(np.int32), (self.suffixes[kept] // SAMPLE).astype(np.int32))
        return np.array([len(p) for p in parts], np.int64).tobytes() + zlib.compress(b"".join(p.tobytes() for p in parts), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> FmIndex:
        sizes, flat = np.frombuffer(data[:48], np.int64), zlib.decompress(data[48:])
        parts, at = [], 0
        for k, size in enumerate(sizes):
            kind = np.dtype(np.int64 if k == 0 else np.int32)
            parts.append(np.frombuffer(flat, kind, int(size), at).astype(np.int64))
            at += int(size) * kind.itemsize
        symbols, lengths, counts, steps, kept, places = parts
        position = np.cumsum(steps)
        n = len(position)
        suffixes = np.full(n, -1, np.int64)
        row, place = np.cumsum(kept), places * SAMPLE
        suffixes[row] = place
        for _ in range(SAMPLE - 1):  # the suffix after the one of row r is that of row position[r]
            row, place = position[row], place + 1
            inside = place < n
            row, place = row[inside], place[inside]
            suffixes[row] = place
        return cls(symbols, lengths, np.repeat(np.arange(len(counts)), counts) * (n + 1) + position, suffixes)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        rank, step, n = text.copy(), 1, len(text)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + nxt if rank.max(initial=0) < (1 << 62) // (n + 2) else None
            if key is None:
                rank = np.unique(rank, return_inverse=True)[1]
                continue
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if fresh.max(initial=0) == n - 1 or step >= n:
                return order
            rank, step = fresh, step * 2

    def _rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place of the transform."""
        base = symbol * (self.size + 1)
        return np.searchsorted(self.ranks, base + upto) - np.searchsorted(self.ranks, base)

    def search(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of each row of words at once: intervals [low, high) of the suffix array."""
        low, high = np.zeros(len(runs), np.int64), np.full(len(runs), self.size)
        for k in range(runs.shape[1] - 1, -1, -1):
            at = np.minimum(np.searchsorted(self.symbols, runs[:, k]), max(len(self.symbols) - 1, 0))
            known = self.symbols[at] == runs[:, k]
            symbol = at + 1
            low = np.where(known, self.first[symbol] + self._rank(symbol, low), 0)
            high = np.where(known, self.first[symbol] + self._rank(symbol, high), 0)
            high = np.maximum(low, high)
        return low, high

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, sequence, place in it) of every occurrence in the intervals."""
        counts = high - low
        run = np.repeat(np.arange(len(low)), counts)
        row = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        at = self.suffixes[row]
        sequence = np.searchsorted(self.starts, at, side="right") - 1
        return run, sequence, at - self.starts[sequence]


def shared_runs(index: FmIndex, training: list[np.ndarray]) -> pd.DataFrame:
    """(t, e, common, longest): distinct shared runs of words of each pair with a match, and its longest span."""
    held = len(index.lengths)
    lengths = np.array([max(len(t) - RUN + 1, 0) for t in training])
    owner = np.repeat(np.arange(len(training)), lengths)
    offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, RUN) for t in training if len(t) >= RUN]) if lengths.sum() else np.zeros((0, RUN), np.int64)
    low, high = index.search(flat)
    out = []
    step = max(1, int(4_000_000 // max(1.0, float((high - low).mean()) if len(low) else 1.0)))
    bounds = [0]
    ends = np.cumsum(lengths)
    for t in range(len(training)):  # whole training records in each part
        if ends[t] - bounds[-1] >= step or t == len(training) - 1:
            bounds.append(int(ends[t]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        run, seq, place = index.places(low[a:b], high[a:b])
        if not len(run):
            continue
        t, pos = owner[a:b][run], offset[a:b][run]
        # A run of the training record counts once per evaluation record: by its interval, equal for equal runs.
        pair = t * held + seq
        distinct = np.unique(np.stack([pair, low[a:b][run]]), axis=1)[0]
        pairs, common = np.unique(distinct, return_counts=True)
        # Matches on one diagonal and next to each other are one maximal span.
        order = np.lexsort((pos, place - pos, pair))
        p, d, x = pair[order], (place - pos)[order], pos[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)])
        span = np.diff(np.concatenate([np.flatnonzero(new), [len(p)]])) + RUN - 1
        longest = np.zeros(len(pairs), np.int64)
        np.maximum.at(longest, np.searchsorted(pairs, p[new]), span)
        out.append(pd.DataFrame({"t": pairs // held, "e": pairs % held, "common": common, "longest": longest}))
    return pd.concat(out) if out else pd.DataFrame({"t": [], "e": [], "common": [], "longest": []}, dtype=np.int64)


def _distinct_runs(sequences: list[np.ndarray]) -> np.ndarray:
    """Number of distinct runs of words of each sequence."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    flat = np.concatenate(sequences).view(np.uint64) if sequences else np.zeros(0, np.uint64)
    return np.diff(distinct_sorted(*run_hashes(offsets, flat, RUN))[0])


def _indexed(shard: pd.DataFrame) -> pd.DataFrame:
    """The written index of the evaluation records of one shard, with their rows."""
    sequences = [np.asarray(s) for s in shard.words]
    lists = {"rows": shard.row.tolist(), "kinds": shard.kind.tolist(), "answered": shard.has.tolist(), "sizes": _distinct_runs(sequences).tolist()}
    return pd.DataFrame({"shard": [int(shard.shard.iloc[0])], "index": [FmIndex.of(sequences).to_bytes()]} | {k: [v] for k, v in lists.items()})


def _search(visits: pd.DataFrame, shard: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Matches of the training records that visit one shard, above the threshold."""
    kind = {"a": np.int64, "b": np.int64, "likeness": np.float64, "longest": np.int32}
    if not len(visits) or not len(shard):
        return pd.DataFrame({k: pd.Series([], dtype=v) for k, v in kind.items()})
    held = shard.iloc[0]
    training = [np.asarray(s) for s in visits.words]
    met = shared_runs(FmIndex.from_bytes(held["index"]), training)
    own, other = _distinct_runs(training), np.asarray(held["sizes"])
    t, e, common = met["t"].to_numpy(), met["e"].to_numpy(), met["common"].to_numpy()
    likeness = common / (own[t] + other[e] - common)
    # kind 0 texts are compared only where either record has no answer.
    fits = (likeness >= threshold - 1e-9) & (visits.kind.to_numpy()[t] == np.asarray(held["kinds"])[e])
    fits &= (visits.kind.to_numpy()[t] == 1) | ~(visits.has.to_numpy()[t] & np.asarray(held["answered"])[e])
    return pd.DataFrame({"a": visits.row.to_numpy()[t[fits]], "b": np.asarray(held["rows"])[e[fits]], "likeness": likeness[fits], "longest": met["longest"].to_numpy()[fits].astype(np.int32)})


def overlaps(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(train_id, eval_id, likeness, longest) of all cross-split pairs of records (id, side, question, answer)."""
    spark = records.sparkSession
    words = materialise(record_words(records), "words")
    keys = ["side", "kind", "sig"]
    repeated = words.groupBy(*keys).agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").select(*keys, "first")
    texts = words.join(setjoin.small(repeated), keys, "left").where("first IS NULL OR first = row").drop("first", "id")
    total, evaluated = words.count(), texts.where("side = 1")
    routed = setjoin.candidates(texts.select("row", "side", "kind", "has", "words"), _entries, total, sides=True)

    shards = max(1, -(-words.where("side = 1").count() // SHARD))
    home = lambda row: F.pmod(F.xxhash64(row), F.lit(shards)).cast("int")
    tasks = max(shards // 16, spark.sparkContext.defaultParallelism)
    built = evaluated.select(home("row").alias("shard"), "row", "kind", "has", "words").repartition(tasks, "shard").groupBy("shard").applyInPandas(_indexed, "shard int, index binary, rows array<bigint>, kinds array<int>, answered array<boolean>, sizes array<bigint>")
    index = materialise(built, "index")
    visits = materialise(routed.select("a", home("b").alias("shard")).distinct(), "visits")
    parts = setjoin.small(visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts")))
    visiting = texts.where("side = 0").join(visits.join(parts, "shard").select(F.col("a").alias("row"), "shard", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), "row")
    asked = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    tasks = max(-(-visits.count() // VISITS), 2 * spark.sparkContext.defaultParallelism)
    left = visiting.select("shard", "part", "row", "kind", "has", "words").repartition(tasks, "shard", "part").groupBy("shard", "part")
    found = left.cogroup(asked.repartition(tasks, "shard", "part").groupBy("shard", "part")).applyInPandas(lambda x, y: _search(x, y, threshold), "a bigint, b bigint, likeness double, longest int")
    found = materialise(found, "found")

    rows = setjoin.small(found.select(F.col("a").alias("row")).union(found.select(F.col("b").alias("row"))).distinct())
    sigs = materialise(words.join(rows, "row", "left_semi").select("row", *keys), "sigs")
    pairs = found.join(sigs.select(F.col("row").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("row").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = materialise(pairs.select(F.col("sa").alias("a"), F.col("sb").alias("b"), "likeness", "longest"), "pairs")
    members = materialise(words.join(setjoin.small(sigs.select(*keys).distinct()), keys, "left_semi").select("id", "side", "sig").distinct(), "members")
    train, held = members.where("side = 0").select(F.col("sig").alias("a"), F.col("id").alias("x")), members.where("side = 1").select(F.col("sig").alias("b"), F.col("id").alias("y"))
    best = setjoin.expanded(pairs, train, held)
    return best.groupBy(F.col("x").alias("train_id"), F.col("y").alias("eval_id")).agg(F.max("likeness").alias("likeness"), F.max("longest").alias("longest"))
