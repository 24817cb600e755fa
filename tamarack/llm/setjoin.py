"""Candidate search for similarity joins over sets: a byte-position inverted index with count filtering.

Each set gets a signature of ``POSITIONS`` bytes: byte p is a byte of the set's smallest hash in the p-th of as many
orders (one-permutation min-hashing in ``ROUNDS`` rounds of ``BINS`` bins, empty bins filled from others). Two sets of
likeness t agree in a share t of the positions. The inverted index maps (position, bytes) to records by words of
``WIDTH`` neighbouring bytes; pairs that share an entry are candidates, their shared positional bytes are tallied, and
pairs below ``guaranteed_bytes`` are dropped before anything larger than a signature is read.

With 84 entries of 7 bytes a pair of likeness 0.70 shares an entry with probability 0.9993, of 0.75 with 0.99999.

The index is partitioned by entry and never sent anywhere: each record's entries go, packed to some six bytes each, to
the bucket that owns them, and a bucket finds the entries of several records by sorting. The number of buckets follows
the number of records, so that a bucket has the same size whatever the input is. Entries that many records share leave
their bucket as rows and are split into pairs of blocks, so that no task holds all records of an entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.words import mix
from tamarack.session import materialise

ROUNDS, BINS, WIDTH = 21, 28, 7
POSITIONS = ROUNDS * BINS
#: Entries of one record.
ENTRIES = POSITIONS // WIDTH
#: Values of one part in computing signatures.
_PART = 1 << 17
#: Entries of one bucket on average, and entries a bucket holds before it lets those of many records go.
BUCKET, HELD = 1 << 21, 1 << 23
#: Records of one index entry in one block; larger entries become several blocks.
BLOCK = 256
#: Rows up to which a helper table of a few columns is broadcast.
BROADCAST_ROWS = 200_000
_LOW = 40


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written and counted, with a broadcast hint if it has at most ``rows`` rows."""
    df = materialise(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def guaranteed_bytes(threshold: float) -> int:
    """Shared positional bytes that a pair at the threshold has but for a chance below one in a billion."""
    return int(np.floor(POSITIONS * threshold - 9 * np.sqrt(POSITIONS * threshold * (1 - threshold))))


def signatures(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(records, POSITIONS) bytes; an empty set has the signature of zeros."""
    count = len(offsets) - 1
    out = np.zeros((count, POSITIONS), np.uint8)
    first = 0
    while first < count:  # parts whose arrays stay in the processor's cache
        last = min(count, max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PART, side="right")) - 1))
        _signatures(offsets[first : last + 1] - offsets[first], values[offsets[first] : offsets[last]].view(np.uint64), out[first:last])
        first = last
    return out


def _signatures(offsets: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    count, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(count), sizes) * BINS
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    some = (sizes > 0)[:, None]
    h, spare = np.empty_like(values), np.empty_like(values)
    for r in range(ROUNDS):
        with np.errstate(over="ignore"):
            np.multiply(values, np.uint64(0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D * 2 * r & 0xFFFFFFFFFFFFFFFF), out=h)
            np.right_shift(h, np.uint64(32), out=spare)
            np.bitwise_xor(h, spare, out=h)
            np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
        least = np.full(count * BINS, most, np.uint64)
        np.right_shift(h, np.uint64(32), out=spare)
        np.multiply(spare, np.uint64(BINS), out=spare)
        np.right_shift(spare, np.uint64(32), out=spare)
        np.minimum.at(least, owner + spare.view(np.int64), h)
        least = least.reshape(count, BINS)
        own = least != most
        rows, bins = np.nonzero(~own & some)
        for step in range(1, 5):  # an empty bin takes the value of a full one, tried in the same sequence for all records
            if not len(rows):
                break
            donor = (bins * 5 + step * 13 + (bins * step) % 11 + r) % BINS
            full = own[rows, donor]
            least[rows[full], bins[full]] = _borrowed(least[rows[full], donor[full]], step, bins[full])
            rows, bins = rows[~full], bins[~full]
        if len(rows):  # else that of the next full one to the right
            some_rows, at = np.unique(rows, return_inverse=True)
            place = np.where(np.concatenate([own[some_rows]] * 2, axis=1), np.arange(2 * BINS), 4 * BINS)
            nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
            donor = nearest[at, bins] % BINS
            least[rows, bins] = _borrowed(least[rows, donor], 5, bins)
        out[:, r * BINS : (r + 1) * BINS] = (mix(least) >> np.uint64(40)).astype(np.uint8)
    out[sizes == 0] = 0


def _borrowed(value: np.ndarray, step: int, bins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(value + np.uint64(step * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) + bins.astype(np.uint64))


def entries(signature: np.ndarray) -> np.ndarray:
    """(records, ENTRIES) keys of (position, bytes)."""
    wide = np.zeros((len(signature), ENTRIES, 8), np.uint8)
    wide[:, :, :WIDTH] = signature.reshape(len(signature), ENTRIES, WIDTH)
    words = wide.view(np.uint64)[:, :, 0]
    with np.errstate(over="ignore"):
        return mix(words * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Row numbers as their first and the steps between them, in the narrowest type."""
    steps = np.diff(ids)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if not len(steps) or (steps.min() >= np.iinfo(k).min and steps.max() <= np.iinfo(k).max))
    return bytes([np.dtype(kind).itemsize]) + int(ids[0]).to_bytes(8, "little", signed=True) + steps.astype(kind).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, f"<i{data[0]}", offset=9).astype(np.int64)
    return np.cumsum(np.concatenate([[int.from_bytes(data[1:9], "little", signed=True)], steps]))


def buckets_of(records: int) -> int:
    """Buckets of the index of so many records."""
    return max(1, -(-records * ENTRIES // BUCKET))


def packed(df: DataFrame, entries_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """(place, bucket, side, ids, low): the index entries of ``df``, a row for each bucket, side and batch.

    ``entries_of`` gives parts (row number, entry, side) of the entries of a batch; ``place`` sends a bucket to a
    partition.
    """
    places = partition_keys(buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rec, entry, side in (part for batch in batches for part in entries_of(batch)):
            entry = entry.view(np.uint64)
            home = (entry % np.uint64(buckets)).astype(np.int64) * 2 + side
            low = (entry // np.uint64(buckets)) & np.uint64((1 << _LOW) - 1)
            order = np.argsort(home.astype(np.uint16) if 2 * buckets <= 1 << 16 else home, kind="stable")
            rec, low, home = rec[order], low[order], home[order]
            first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(home))
            words = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8])
            ids = [pack_ids(rec[a:b]) for a, b in zip(first, ends)]
            columns = [pa.array(x, pa.int32()) for x in (places[home[first] // 2], home[first] // 2, home[first] % 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array([words[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["place", "bucket", "side", "ids", "low"])

    return df.mapInArrow(pack, "place int, bucket int, side int, ids binary, low binary")


class Bucket:
    """The entries of one task: collects rows, lets entries of many records go, and pairs the rest."""

    def __init__(self, sides: bool) -> None:
        self.sides = sides
        self.key, self.rec, self.side = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.hot = np.zeros(0, np.uint64)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, bucket: int, side: int, ids: bytes, low: bytes) -> None:
        rec = unpack_ids(ids)
        wide = np.zeros((len(rec), 8), np.uint8)
        wide[:, : _LOW // 8] = np.frombuffer(low, np.uint8).reshape(len(rec), -1)
        self.waiting.append((wide.view("<u8")[:, 0] | np.uint64(bucket << _LOW), rec, np.full(len(rec), side, np.int8)))
        self.held += len(rec)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, rec, side) of the entries that have many records; the others stay, sorted."""
        key, rec, side = (np.concatenate([own, *(w[k] for w in self.waiting)]) for k, own in enumerate((self.key, self.rec, self.side)))
        self.waiting = []
        order = np.argsort(key, kind="stable")
        key, rec, side = key[order], rec[order], side[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(start, len(key)))
        many = (counts > BLOCK) | np.isin(key[start], self.hot)
        self.hot = np.union1d(self.hot, key[start[many]])
        out = np.repeat(many, counts)
        self.key, self.rec, self.side = key[~out], rec[~out], side[~out]
        self.held = len(self.key)
        return key[out], rec[out], side[out]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b) of records that share an entry: a < b of one side, or a of side 0 and b of side 1."""
        key, rec, side = self.key, self.rec, self.side
        at = np.arange(len(key))
        for step in range(1, BLOCK):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                return
            a, b = at, at + step
            if self.sides:
                kept = side[a] != side[b]
                a, b = a[kept], b[kept]
                a, b = np.where(side[a] == 0, a, b), np.where(side[a] == 0, b, a)
                yield rec[a], rec[b]
            else:
                x, y = rec[a], rec[b]
                yield np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]


def _meet(sides: bool) -> Callable:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(sides)

        def rows(kind: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000], t) for c, t in ((kind, pa.int32()), (x, pa.int64()), (y, pa.int64()))], ["kind", "x", "y"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bucket.add(*row)
                if bucket.held > HELD:
                    key, rec, side = bucket.settle()
                    yield from rows(side.astype(np.int32), key.view(np.int64), rec)
        key, rec, side = bucket.settle()
        yield from rows(side.astype(np.int32), key.view(np.int64), rec)
        met: list[np.ndarray] = []
        for a, b in bucket.pairs():
            met.append(np.stack([a, b]))
            if sum(m.shape[1] for m in met) > 2_000_000:
                met = [np.unique(np.concatenate(met, axis=1), axis=1)]
                yield from rows(np.full(met[0].shape[1], 2, np.int32), *met[0])
                met = []
        if met:
            both = np.unique(np.concatenate(met, axis=1), axis=1)
            yield from rows(np.full(both.shape[1], 2, np.int32), *both)

    return meet


def partition_keys(partitions: int) -> np.ndarray:
    """For each of so many partitions an integer that Spark's hash partitioning sends there.

    Only the balance of the partitions rests on this: integers that are hashed otherwise would still meet their equals.
    """
    k = np.arange(max(64, int(partitions * (np.log(partitions) + 12))), dtype=np.uint32)
    with np.errstate(over="ignore"):
        turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
        h = turn(turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    home, first = np.unique(np.mod(h.view(np.int32).astype(np.int64), partitions), return_index=True)
    keys = np.arange(partitions)
    keys[home] = k[first]
    return keys


def candidates(df: DataFrame, entries_of: Callable, records: int, sides: bool = False) -> DataFrame:
    """(a, b): pairs of row numbers that share an index entry, once each, written.

    Without ``sides`` all records are of one side and a < b; with it, a is of side 0 and b of side 1.
    """
    buckets = max(buckets_of(records), df.sparkSession.sparkContext.defaultParallelism)
    index = packed(df, entries_of, buckets).repartition(buckets, "place")
    met = materialise(index.drop("place").mapInArrow(_meet(sides), "kind int, x bigint, y bigint"), "met")
    pairs = met.where("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))
    hot = met.where("kind <> 2").select(F.col("x").alias("entry"), F.col("y").alias("rec"), F.col("kind").alias("side"))
    if not hot.isEmpty():
        pairs = pairs.union(hot_pairs(hot, sides))
    return materialise(pairs.distinct(), "candidates")


def hot_pairs(postings: DataFrame, sides: bool) -> DataFrame:
    """(a, b) of postings (entry, rec, side) whose entries have many records, joined block by block."""
    spread = blocks(postings, left=(F.col("side") == 0) if sides else None)
    a, b = (spread.where("side = 0").alias("a"), spread.where("side = 1").alias("b")) if sides else (spread.alias("a"), spread.alias("b"))
    same = (F.col("a.entry") == F.col("b.entry")) & (F.col("a.bi") == F.col("b.bi")) & (F.col("a.bj") == F.col("b.bj"))
    if not sides:
        same = same & (F.col("a.rec") < F.col("b.rec")) & ((F.col("a.bi") == F.col("a.bj")) | (F.col("a.b") != F.col("b.b")))
    return a.join(b, same).select(F.col("a.rec").alias("a"), F.col("b.rec").alias("b"))


def blocks(postings: DataFrame, left: Column | None = None) -> DataFrame:
    """Postings with the columns ``bi`` and ``bj``: entries of many records are spread over pairs of blocks.

    ``left`` says which rows are of the left side in a join of two sides; without it the join is of one side with
    itself and a row goes to every pair of blocks that its own block is part of.
    """
    heavy = postings.groupBy("entry").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("entry", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    marked = postings.join(small(heavy), "entry", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    marked = marked.withColumn("b", F.pmod(F.xxhash64("rec"), F.col("nb")).cast("int"))
    spread = marked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    if left is None:
        return spread.withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("nb", "o")
    return spread.withColumn("bi", F.when(left, F.col("b")).otherwise(F.col("o"))).withColumn("bj", F.when(left, F.col("o")).otherwise(F.col("b"))).drop("nb", "o", "b")


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, ...) for each pair of classes (a, b, ...): members x of a, from left (a, x), and y of b, from right (b, y).

    Classes of many members are cut into blocks; a pair of blocks is one cell, so that no task holds a whole class.
    """

    def cut(members: DataFrame, key: str, member: str, block: str) -> tuple[DataFrame, DataFrame]:
        large = small(members.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select(key, F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")))
        one = F.coalesce("nb", F.lit(1))
        return members.join(large, key, "left").select(key, member, F.pmod(F.xxhash64(member), one).cast("int").alias(block)), large

    (left, many_a), (right, many_b) = cut(left, "a", "x", "ia"), cut(right, "b", "y", "ib")
    more = [c for c in pairs.columns if c not in ("a", "b")]
    cells = pairs
    for key, many, block in (("a", many_a, "ia"), ("b", many_b, "ib")):
        cells = cells.join(many, key, "left").withColumn(block, F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1))).drop("nb")
    keys = ["a", "ia", "b", "ib"]
    return cells.join(left, ["a", "ia"]).join(cells.select(*keys).join(right, ["b", "ib"]), keys).select("x", "y", *more)


def shared_enough(n_a: Column, n_b: Column, shared: Column, threshold: float) -> Column:
    """Whether sets of sizes ``n_a`` and ``n_b`` with ``shared`` common entries reach the likeness."""
    return shared >= F.lit(threshold) * (n_a + n_b - shared) - 1e-9
