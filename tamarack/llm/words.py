"""Vectorised word sequences: texts to 64-bit word hashes and to hashed runs of words, a batch at a time.

A word is a maximal run of letters and digits of the lower-cased text in consistent form (problem 2). Arrow
kernels lower, split and dictionary-encode a whole batch; only distinct words are hashed one by one, so that the
cost per word is a few nanoseconds. Null counts as empty; texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tamarack.llm.forms import SUSPECT_RE2, transducer

SEPARATORS = r"[^\p{L}\p{Nd}]+"
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def consistent_array(texts: pa.Array) -> pa.Array:
    """Texts in consistent form, null as empty; the transducer runs on suspect texts only."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    suspect = pc.match_substring_regex(texts, SUSPECT_RE2)
    where = np.flatnonzero(suspect.to_numpy(zero_copy_only=False))
    if len(where):
        run = transducer().run
        mended = pa.array([run(t) for t in texts.take(pa.array(where)).to_pylist()], pa.large_string())
        texts = pc.replace_with_mask(texts, suspect, mended)
    return texts


def words_of(texts: pa.Array, form: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): words[offsets[i]:offsets[i + 1]] are the words of text i."""
    if form:
        texts = consistent_array(texts)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), SEPARATORS)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    return before[offsets], flat.filter(pa.array(kept))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[np.asarray(coded.indices)] if len(coded.dictionary) else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array, form: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the words of each text."""
    offsets, words = words_of(texts, form)
    return offsets, hash_words(words)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


def run_hashes(offsets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of all runs of ``n`` consecutive words of each record, repeats included."""
    hashes = hashes.astype(np.uint64, copy=False)
    total = len(hashes) - n + 1
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(lengths)])
    if total <= 0:
        return out, np.zeros(0, np.uint64)
    acc = hashes[:total].copy()
    for k in range(1, n):
        acc = mix(acc * _P1 + hashes[k : k + total])
    starts = np.repeat(offsets[:-1] - out[:-1], lengths) + np.arange(out[-1])
    return out, acc[starts]


def distinct_sorted(offsets: np.ndarray, hashes: np.ndarray, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the distinct values of each record, cut to ``bits`` bits, in ascending order."""
    n = len(offsets) - 1
    values = hashes >> np.uint64(64 - bits)
    if n < 1 << (64 - bits):
        keys = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets)) << np.uint64(bits)) | values
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        owner = (keys >> np.uint64(bits)).astype(np.int64)
        values = keys & np.uint64((1 << bits) - 1)
    else:
        owner = np.repeat(np.arange(n), np.diff(offsets))
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        first = np.ones(len(values), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        owner, values = owner[first], values[first]
    return np.searchsorted(owner, np.arange(n + 1)), values.astype(np.int64)


def set_hash(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each record's set of values."""
    with np.errstate(over="ignore"):
        spread = values.astype(np.uint64) * _P1
        spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(spread ^ (spread >> np.uint64(27)), dtype=np.uint64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column from offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of an Arrow list column without nulls."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return offsets - offsets[0], np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
