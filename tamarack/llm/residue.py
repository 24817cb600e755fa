"""Problem 6: template residue, filler text, and error or scripts-required messages.

Texts are cut into units (sentences and lines). Seeds are trusted: a short list of whole messages (``EXEMPLARS``) and a
grammar of unfilled slots, codes and filler. Near-duplicates of seeds are found through an index of each unit's rarest
words, verified by likeness of their text, and labels spread along verified links until no unit is new, which labels
the connected components that hold a seed. A record with a labelled unit is residue.

The search is exact: two units of likeness ``LIKENESS`` or more share one of the n - ceil(LIKENESS * n) + 1 words that
come first among the n of each in any order that is the same for all units. SimHashes of single sentences cannot do
this: one changed word of ten moves nine of 64 bits on average.

Slots label their unit but do not spread, for the rest of such a unit is content. Null and empty texts are no
residue here; an id that is delivered again counts once; equal units are compared once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import setjoin
from tamarack.llm.words import consistent_array, words_of
from tamarack.session import materialise

#: Likeness of two units' words that a link needs.
LIKENESS = 0.8
#: The words counted for the order of the index: at most so many, in one of ``SAMPLE`` units. They change what the search costs, not what it finds.
COUNTED, SAMPLE = 20_000, 16

# Forms of unfilled template slots.
SLOTS = (
    r"\{\{[^{}\n]*\}\}", r"\{%[^%\n]*%\}", r"<%=?[^%\n]*%>", r"[$#]\{[^{}\n]+\}", r"\{(?:\d+|[A-Za-z]+_\w+|[A-Za-z]{3,})\}", r"%[A-Z][A-Z0-9_]{2,}%", r"(?<!\w)%\(?\w*\)?[sd](?!\w)", r"@@\w+@@", r"\$\$\w+\$\$",
    r"\[\[[^\[\]\n]+\]\]", r"(?<!\w)__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?!\w)", r"[«‹]\s?[A-Za-z]\w*\s?[»›]", r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>", r"[<\[](?:điền|nhập|chèn|ghi rõ|ghi|thêm|insert|enter|your|tên|số|họ tên)\s[^<>\[\]\n]{2,}[>\]]", r"\[[A-ZÀ-ỸĐ]{2,}(?:[ _][A-ZÀ-ỸĐ]{2,})+\]",
)

# Whole messages of a site in place of content; units alike to one, or to one of those, are labelled too.
EXEMPLARS = (
    "Noscript mode is not supported.", "This page needs JavaScript and cookies.", "Please enable scripts in your browser to continue.", "You need to enable JavaScript to run this app.", "Reload when you are done.", "Checking your browser before accessing this site.",
    "Đang kiểm tra trình duyệt của bạn trước khi truy cập.", "Trình duyệt của bạn đang tắt chức năng chạy kịch bản.", "Trình duyệt của bạn không hỗ trợ JavaScript.", "Vui lòng bật JavaScript để xem nội dung này.", "Trang web yêu cầu cookie và mã lệnh phía trình duyệt.", "Sau khi bật, hãy tải lại trang.",
    "Đã xảy ra lỗi khi tải nội dung văn bản.", "Có lỗi xảy ra, vui lòng thử lại sau.", "Kết nối tới cơ sở dữ liệu thất bại.", "Không thể đọc tệp nguồn.", "Máy chủ đang quá tải, vui lòng thử lại sau ít phút.", "Hệ thống đang bảo trì, vui lòng quay lại sau.", "Object reference not set.", "The upstream server did not respond in time.", "Too many requests from your address.",
    "Bạn không có quyền xem trang này.", "Vui lòng đăng nhập lại để tiếp tục.", "Trang bạn yêu cầu không tồn tại hoặc đã bị di chuyển.", "Quay về trang chủ",
)

# Codes and headings of such messages, which differ in numbers or stand before one; from the start of a unit.
MESSAGES = (
    r"(?:http(?: status)?|error|lỗi|mã lỗi)\s*:?\s*[1-5]\d\d\b(?!.*\b(?:quá|thì)\b)", r"[1-5]\d\d\s*[-–:|]?\s*(?:bad|gateway|not found|forbidden|internal|service|unauthor|error|request|too many|không tìm thấy|lỗi)", r"(?:404 )?(?:page )?not found\b", r"bad gateway", r"(?:(?:internal )?server error|service unavailable|access denied|gateway time-?out|forbidden)\b",
    r"traceback\b", r"undefined is not a function", r"(?:uncaught )?\w*(?:exception|error) (?:in|at|:) ?\w+", r"request id [0-9a-f]{6,}", r"mã tham chiếu: ?[0-9a-f]{6,}", r"checking [0-9a-f]{3,}\.\.\.", r"không tìm thấy trang", r"truy cập bị từ chối", r"phiên (?:làm việc|đăng nhập)(?: của bạn)? đã hết hạn", r"oops\b", r"(?:enable|bật) (?:javascript|cookies?)\b[^.]*$",
)
FILLERS = (
    r"todo\b", r"fixme\b", r"tbd$", r"lorem ipsum\b", r"(?:-{3,} ?)?(?:nội dung|toàn văn|bài viết|phần này|phần trả lời|câu trả lời|văn bản|tài liệu|trang|mục này|chương này|điều này)(?: này)? (?:đang (?:được )?(?:cập nhật|bổ sung|biên soạn|hoàn thiện|xây dựng|trong quá trình \w+ \w+)|chưa có dữ liệu|chưa được (?:cập nhật|nhập)|sẽ (?:được )?(?:bổ sung|cập nhật) sau)\s*(?:[.…!,(]|$)",
    r"(?:đang cập nhật|đang biên soạn|sẽ cập nhật sau)\s*[.…]*$", r"(?:placeholder|sample|dummy) text\b", r"insert (?:text|content) here", r"\(?bản nháp số \d+\)?$", r"(?:nội dung giả|văn bản mẫu|văn bản giả|nội dung mẫu)[.…]*$",
)

# Frequent words that gibberish does not have.
_COMMON = frozenset("the of and to in is for on with by from at as a an be or not this that must may shall can her his it no if le la les de des du et un une en est pour par dans ne der die das und ist von zu mit den dem ein eine im".split())
_SYLLABLE = re.compile(r"(?:b|ch|c|d|đ|gh|gi|g|h|kh|k|l|m|ngh|ng|nh|n|ph|p|qu|r|s|th|tr|t|v|x)?[aăâeêioôơuưyáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]{1,3}(?:ch|c|m|ng|nh|n|p|t)?")


_SLOT_SIGNS = re.compile(r"[{}\[\]<>%$@_«‹]")
_CUT = re.compile(r"\n|(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")
_ROWS = tuple(frozenset(r) for r in ("qwertyuiop", "asdfghjkl", "zxcvbnm"))


@lru_cache(maxsize=1)
def _grammar() -> tuple[re.Pattern, re.Pattern]:
    return re.compile("|".join(SLOTS)), re.compile("|".join(f"(?:{p})" for p in (*MESSAGES, *FILLERS)))


def units_of(text: str) -> list[str]:
    """Lines cut into sentences, white space collapsed, blank ones left out."""
    return [u for u in (" ".join(s.split()) for s in _CUT.split(text)) if u]


def _gibberish(words: list[str]) -> bool:
    """Random letters or invented words: none is a syllable or a frequent word of the corpus' languages."""
    letters = [w for w in words if w.isalpha()]
    if len(letters) < 2 or len(letters) < 0.8 * len(words) or not all(w.isascii() for w in letters):
        return False
    odd = [w for w in letters if not _SYLLABLE.fullmatch(w)]
    if len(odd) < 0.6 * len(letters) or any(w in _COMMON for w in letters):
        return False
    rows = sum(1 for w in odd if len(w) >= 4 and any(row.issuperset(w) for row in _ROWS))
    return len(letters) >= 4 or rows == len(letters)


def _repeats(words: list[str]) -> bool:
    """Whether a group of one to four words stands at least four times in a row."""
    if 2 * len(set(words)) > len(words):
        return False
    for period in range(1, 5):
        row = 0
        for x, y in zip(words, words[period:]):
            row = row + 1 if x == y else 0
            if row >= 3 * period:
                return True
    return False


def seed_label(unit: str) -> str | None:
    """Trusted label of a unit: ``slot``, ``message``, ``filler``, or none."""
    slots, phrases = _grammar()
    if _SLOT_SIGNS.search(unit) and slots.search(unit):
        return "slot"
    low = unit.lower()
    if m := phrases.match(low):
        return "message" if _message(m.group(), low) else "filler"
    words = _WORD.findall(low)
    if len(words) >= 4 and _repeats(words) or unit.isascii() and _gibberish(words):
        return "filler"
    return None


@lru_cache(maxsize=10_000)
def _message(start: str, low: str) -> bool:
    return any(re.match(p, low) for p in MESSAGES)


def skeletons(units: pa.Array) -> pa.Array:
    """Lower-cased units with numbers and hexadecimal codes masked."""
    low = pc.utf8_lower(units)
    low = pc.replace_substring_regex(low, pattern=r"\b[0-9a-f]*[0-9][0-9a-f]*\b", replacement="0")
    return pc.replace_substring_regex(low, pattern=r"[0-9]+", replacement="0")


def _unit_ids(bare: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b) for b in bare.to_pylist()], np.uint64).view(np.int64)


def exemplars() -> list[tuple[int, str, str]]:
    """(unit, label, text) of the trusted messages."""
    bare = skeletons(pa.array([u for text in EXEMPLARS for u in units_of(text)], pa.large_string()))
    return [(int(u), "message", t) for u, t in zip(_unit_ids(bare), bare.to_pylist())]


def _unit_table(records: DataFrame) -> DataFrame:
    """(table_name, record_id, unit, label, text): each unit once per record; text is its skeleton."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = [units_of(t) for t in consistent_array(batch.column(2)).to_pylist()]
            flat = [u for us in per for u in us]
            owner = np.repeat(np.arange(len(per)), [len(us) for us in per])
            labels = pa.array([seed_label(u) for u in flat], pa.string())
            bare = skeletons(pa.array(flat, pa.large_string()))
            sizes = np.diff(words_of(bare, form=False)[0])
            named = labels.is_valid().to_numpy(zero_copy_only=False)
            units = _unit_ids(bare)
            kept = np.flatnonzero(named | (sizes > 0))
            kept = kept[np.unique(np.stack([owner[kept], units[kept], named[kept]]), axis=1, return_index=True)[1]] if len(kept) else kept
            at, row = pa.array(kept), pa.array(owner[kept])
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(units[kept]), labels.take(at), bare.take(at).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["table_name", "record_id", "unit", "label", "text"])

    return records.select("table_name", F.col("record_id").cast("string"), "text").mapInArrow(cut, "table_name string, record_id string, unit bigint, label string, text string")


def _word_order(units: DataFrame) -> dict[str, int]:
    """Frequent words of the units with their place; words without one are rarer and come first."""
    sample = units.where(F.pmod("unit", F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    counted = sample.groupBy("word").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "word").limit(COUNTED).collect()
    return {r.word: len(counted) - k for k, r in enumerate(counted)}


def _first_words(units: DataFrame, order: Broadcast) -> DataFrame:
    """(unit, n, entry) of units (unit, text): those of the n distinct words of each that an alike unit must share one of."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = order.value
        for batch in batches:
            sizes, counts, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = sorted(set(text.split(" ")), key=lambda w: (place.get(w, 0), w))
                first = words[: len(words) - ceil(LIKENESS * len(words) - 1e-9) + 1]
                sizes.append(len(words))
                counts.append(len(first))
                found += [xxhash.xxh3_64_intdigest(w) for w in first]
            owner = np.repeat(np.arange(len(sizes)), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.array(sizes, np.int32)[owner]), pa.array(np.array(found, np.uint64).view(np.int64))], ["unit", "n", "entry"])

    return units.select("unit", "text").mapInArrow(index, "unit bigint, n int, entry bigint")


def _shared_words(a, b):
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def residue_units(records: DataFrame, spread: bool = True) -> tuple[DataFrame, DataFrame]:
    """(units, labels) of records (table_name, record_id, text); labels: (unit, label) of all labelled units.

    Without ``spread`` the labels are those of the seeds only.
    """
    spark = records.sparkSession
    given = records.where("text IS NOT NULL AND record_id IS NOT NULL")
    units = materialise(_unit_table(given), "units")
    trusted = spark.createDataFrame(exemplars(), "unit bigint, label string, text string")
    seeds = units.where("label IS NOT NULL").select("unit", "label", "text").union(trusted)
    seeds = setjoin.small(seeds.groupBy("unit").agg(F.min("label").alias("label"), F.first("text").alias("text")))
    labels = seeds.select("unit", "label")
    if not spread:
        return units, labels
    others = units.where("label IS NULL").select("unit", "text").join(labels, "unit", "left_anti")
    order = spark.sparkContext.broadcast(_word_order(others))
    index = materialise(_first_words(others, order).distinct(), "index")
    front = seeds.where("label <> 'slot'")
    while True:
        asked = setjoin.small(_first_words(front, order).select(F.col("unit").alias("seed"), F.col("n").alias("seed_n"), "entry"))
        near = index.join(asked, "entry").where(F.least("n", "seed_n") >= F.lit(LIKENESS) * F.greatest("n", "seed_n") - 1e-9)
        links = materialise(near.select("unit", "seed").distinct(), "links")
        texts = units.where("label IS NULL").join(setjoin.small(links.select("unit").distinct()), "unit", "left_semi").groupBy("unit").agg(F.first("text").alias("text"))
        seeded = front.select(F.col("unit").alias("seed"), F.col("text").alias("seed_text"), "label")
        alike = links.join(texts, "unit").join(seeded, "seed").where(_shared_words(F.col("text"), F.col("seed_text")) >= LIKENESS)
        fresh = alike.groupBy("unit").agg(F.min("label").alias("label"), F.first("text").alias("text"))
        fresh = setjoin.small(fresh.join(labels, "unit", "left_anti"))
        if fresh.isEmpty():
            return units, labels
        labels = setjoin.small(labels.unionByName(fresh.select("unit", "label")))
        front = fresh


def residue_records(records: DataFrame) -> DataFrame:
    """(table_name, record_id) of the records (table_name, record_id, text) that hold a labelled unit."""
    units, labels = residue_units(records)
    return units.join(labels.select("unit"), "unit", "left_semi").select("table_name", "record_id").distinct()
