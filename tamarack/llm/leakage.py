"""Problem 8: passages of evaluation items inside training texts.

One Aho-Corasick automaton holds aligned blocks of the items' words; each text is scanned once, a hit is extended in
both directions to its maximal run of equal words, and runs of at least ``least`` words are reported with their
offsets in the original text. Every run of ``least`` words holds a whole aligned block of (least + 1) // 2 words, so
no run is missed.

The items are a stated query set: they go to the workers in blocks of bounded size, one pass over the texts for
each block. Null and empty texts have no matches; items of fewer than ``least`` words can have none; repeated items
are reported each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.forms import transducer
from tamarack.llm.words import SEPARATORS, consistent_array, words_of

#: Most characters of item texts in one automaton; more items mean more passes.
BLOCK_CHARS = 8_000_000

_built: dict[str, tuple] = {}


def _automaton(name: str, items: list[tuple[int, str]], least: int):
    if name in _built:
        return _built[name]
    size = (least + 1) // 2
    offsets, words = words_of(pa.array([t for _, t in items], pa.large_string()))
    flat = words.to_pylist()
    texts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    blocks: dict[str, list[tuple[int, int]]] = {}
    for k, ws in enumerate(texts):
        if len(ws) >= least:
            for p in range(0, len(ws) - size + 1, size):
                blocks.setdefault(f" {' '.join(ws[p : p + size])} ", []).append((k, p))
    auto = ahocorasick.Automaton()
    for pattern, places in blocks.items():
        auto.add_word(pattern, (len(pattern), places))
    if blocks:
        auto.make_automaton()
    _built.clear()
    _built[name] = (auto if blocks else None, texts, size)
    return _built[name]


def _original_spans(text: str) -> list[tuple[int, int]]:
    """Start and end, in ``text``, of each word of its consistent form."""
    machine, form, at, last = transducer(), [], [], 0
    for m in [*machine.token.finditer(text), None]:
        start = m.start() if m else len(text)
        form.append(text[last:start])
        at.extend(range(last, start))
        if m:
            out = m.group() if m.group().isascii() else machine.word(m.group())
            form.append(out)
            at.extend(min(m.start() + i, m.end() - 1) for i in range(len(out)))
            last = m.end()
    joined = "".join(form)
    return [(at[w.start()], at[w.end() - 1] + 1) for w in re.finditer(r"[^\W_]+", joined) if w.end() <= len(at)]


def _runs(text: str, built: tuple, least: int) -> dict[int, tuple[int, int]]:
    """Item number to (first word in the text, words) of its longest run."""
    auto, items, size = built
    best: dict[int, tuple[int, int]] = {}
    words: list[str] | None = None
    upto = spaces = 0
    for end, (length, places) in auto.iter(text):
        if words is None:
            words = text.split(" ")[1:-1]
        spaces += text.count(" ", upto, end + 1)  # hits come in the order of their ends
        upto = end + 1
        at = spaces - size - 1
        for k, p in places:
            item = items[k]
            a, b = at, p
            while a > 0 and b > 0 and words[a - 1] == item[b - 1]:
                a, b = a - 1, b - 1
            x, y = at + size, p + size
            while x < len(words) and y < len(item) and words[x] == item[y]:
                x, y = x + 1, y + 1
            if x - a >= least and x - a > best.get(k, (0, 0))[1]:
                best[k] = (a, x - a)
    return best


def leaked_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 15, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, words, start, end): each item with a run of ``least`` words in a text, and its longest run."""
    asked = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    spark, kind = docs.sparkSession, "doc_id bigint, item_id bigint, words int, start int, end int"
    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    found = []
    for n in range(blocks):
        block = [(r.i, r.t) for r in (asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n) if blocks > 1 else asked).collect()]
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            built = _automaton(name, sent.value, least)
            for batch in batches:
                raw = batch.column(1)
                rows: list[tuple] = []
                if built[0] is not None:
                    plain = pc.replace_substring_regex(pc.utf8_lower(consistent_array(raw)), pattern=SEPARATORS, replacement=" ")
                    for row, t in enumerate(plain.to_pylist()):
                        best = _runs(f" {t.strip(' ')} ", built, least)
                        if best:
                            spans = _original_spans(raw[row].as_py())
                            for k, (a, length) in best.items():
                                rows.append((batch.column(0)[row].as_py(), sent.value[k][0], length, spans[min(a, len(spans) - 1)][0], spans[min(a + length, len(spans)) - 1][1]))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "words", "start", "end"])

        found.append(texts.mapInArrow(scan, kind))
    return reduce(DataFrame.unionByName, found)
