"""Problem 1: broken question and answer pairs.

Each pair gets its first defect of: ``empty``, ``refusal``, ``echo``, ``wrong_language``, ``truncated``.

* empty: nothing but white space, marks, markup, or a stand-in for an answer; a null answer is empty.
* refusal: a grammar of refusals, sentence by sentence; an answer refuses if it has a refusal and no other content.
* echo: greedy string tiling of the answer with runs of the question's words; what the tiles leave is no answer.
* wrong_language: scripts, letters and frequent words of question and answer; Vietnamese without accents counts as
  Vietnamese.
* truncated: a pushdown parser over fences, brackets, quotations, lists and markup, and the end of the last sentence.

Null questions are empty questions: they are never echoed and have no language. Texts are processed whole. A row that
is delivered again has the same defect and comes out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.words import consistent_array

#: Words of the shortest tile; share of the answer's words under tiles from which an answer is an echo.
TILE, ECHOED = 3, 0.75

# Stand-ins for an answer (lower case, marks at the ends left out).
STAND_INS = frozenset((
    "", "trả lời", "đáp", "câu trả lời", "answer", "response", "a", "tbd", "tba", "todo", "n/a", "na", "n a", "null", "none", "nil", "nan", "undefined", "unknown", "empty", "blank", "no answer", "not available", "không có", "không rõ", "chưa có", "trống", "để trống", "bỏ trống", "chưa trả lời", "không có câu trả lời", "chưa có câu trả lời",
    "đang cập nhật", "đang cập nhật câu trả lời", "câu trả lời đang được cập nhật", "nội dung đang được cập nhật", "sẽ cập nhật sau", "đang chờ trả lời", "chờ trả lời", "xem sau", "coming soon", "pending", "placeholder", "xxx", "lorem ipsum", "đang xử lý", "không có dữ liệu", "chưa có dữ liệu", "no data", "không có nội dung", "chưa có nội dung", "đang soạn",
))

# Grammar of refusals; what may stand before, the refusal itself, and sentences that are no content.
_OPENINGS = r"(?:(?:thành thật |rất |vô cùng |chân thành )?(?:xin lỗi|tiếc)(?: (?:bạn|quý khách|anh chị|anh|chị))?|rất tiếc|chào (?:bạn|anh|chị|quý khách)|hiện (?:tại|nay)|tôi e rằng|với tư cách (?:là )?(?:một )?(?:trợ lý|mô hình|công cụ|chatbot)[^,]*|i'?m (?:really |very )?sorry|sorry|unfortunately|as an? (?:automated |ai |virtual )?(?:assistant|language model|model|ai)|i am (?:afraid|sorry)|i apologi[sz]e)"
_WE = r"(?:tôi|mình|em|chúng tôi|ban tư vấn|hệ thống|trợ lý|bên tôi|bên mình)"
REFUSALS = (
    rf"{_WE} (?:hiện )?(?:không thể|chưa thể|không đủ khả năng|không có khả năng|không tiện) (?:trả lời|giải đáp|hỗ trợ|tư vấn|giúp|cung cấp|bình luận|đưa ra|đáp ứng)",
    rf"{_WE} (?:xin phép )?(?:xin )?(?:từ chối|không (?:được phép )?(?:giải đáp|trả lời|bình luận|đưa ra ý kiến|tư vấn))", rf"{_WE} xin phép không", rf"{_WE} không có (?:đủ )?thông tin", rf"{_WE} (?:chưa|không) đủ (?:dữ liệu|thông tin|thẩm quyền|cơ sở)", rf"{_WE} không được phép",
    r"(?:yêu cầu|câu hỏi|nội dung|vấn đề)(?: này| trên| của bạn)? (?:nằm )?(?:ngoài|vượt quá|không thuộc) (?:phạm vi|khả năng|lĩnh vực)", r"xin (?:phép )?(?:được )?từ chối (?:trả lời|bình luận|tư vấn)", r"không thể (?:trả lời|hỗ trợ|giải đáp) (?:câu hỏi|yêu cầu|nội dung)",
    r"(?:i|we) (?:am|are|was|were)? ?(?:cannot|can'?t|can not|could not|couldn'?t|unable to|not able to|not allowed to|not permitted to|won'?t|will not|must decline|decline to|do not have|don'?t have)", r"(?:this|that|it|your (?:question|request)) (?:is|falls|lies) (?:outside|beyond|out of)", r"(?:i|we) (?:have to|must) (?:decline|refuse)", r"outside (?:of )?what i can",
)
_RESTATES = r"(?:bạn (?:hỏi|đang hỏi|có hỏi|muốn hỏi|vừa hỏi) về|về câu hỏi|câu hỏi của bạn|you (?:asked|ask|are asking) about|regarding your question|cảm ơn (?:bạn|anh|chị|quý khách)|thank you for|mong bạn thông cảm|bạn (?:nên|vui lòng|hãy) (?:gặp|liên hệ|tham khảo|hỏi)|please (?:contact|consult)|vui lòng liên hệ|trân trọng|thân mến|ban tư vấn|chào bạn|xin chào)"

# What a clause that says again what was asked begins with, and what joins a refusal to it.
_TOPIC = re.compile(rf"(?:về|đối với|liên quan (?:đến|tới)|với (?:câu hỏi|yêu cầu|nội dung|vấn đề)|trước (?:câu hỏi|yêu cầu)|như bạn hỏi|as (?:for|to)|about|regarding|concerning|with (?:regard|respect) to|in response to|{_RESTATES})\b")
_JOINS = re.compile(r"(?:vì vậy|vì thế|do đó|do vậy|nên|thì|rằng|nhưng|tuy nhiên|hiện|hiện tại|hiện nay|that|so|but|and|therefore|however|at this time|currently)[\s,:]*")

# Closing phrases and captions that may follow a complete answer, and words that announce a list.
CLOSINGS = frozenset((
    "trân trọng", "trân trọng cảm ơn", "trân trọng kính chào", "thân mến", "thân ái", "thân", "kính thư", "kính chào", "ban tư vấn", "ban biên tập", "chào bạn", "cảm ơn", "cảm ơn bạn", "xin cảm ơn",
    "regards", "best regards", "kind regards", "sincerely", "yours truly", "yours sincerely", "hình từ internet", "ảnh minh họa", "hình minh họa", "nguồn internet", "ảnh internet", "internet",
))
INTROS = ("như sau", "bao gồm", "gồm", "sau đây", "dưới đây", "cụ thể", "as follows", "following", "including")

# Frequent words by language; the accents of Vietnamese are left out for its unaccented form.
_FREQUENT = {
    "vi": "va cua la co khong duoc cho trong theo tai ve voi cac mot nay khi thi phai do nguoi den tu hoac neu nhu dieu khoan thong tu nghi dinh quyet luat ban viec sau truoc ngay dong hop quan thoi han muc chi duoc quyen nghia vu hai ban bang tren dien so nha cong ty hang thue co quan don vi".split(),
    "en": "the of and to in is for on with by from at as a an be or not this that must may shall can has have it its are was were will would should under within before after when which where after each any all their your you we our".split(),
    "fr": "le la les de des du et un une en est pour par dans ne pas que qui se sur au aux ce cette avec reste sont être à il elle son sa ses lieu délai si dont ou".split(),
    "de": "der die das und ist von zu mit den dem ein eine im nicht wird werden auf bei sind oder nach des sich als auch einer eines beide bleibt innerhalb vor durch für über".split(),
    "es": "el los las y del que por con una para no se es al lo como más su sus".split(),
    "it": "il gli che di della per con una non si è alla nel sono dei delle".split(),
}
_FREQUENT = {k: frozenset(v) for k, v in _FREQUENT.items()}
_VIETNAMESE = re.compile(r"[ăđơưĂĐƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


_TAG, _UNSEEN = re.compile(r"<[^<>]*>"), re.compile("&\\w+;|[​-‏﻿⁠­]")
_LABEL = re.compile(r"^(?:trả lời|đáp|answer)\b\W*")


def _bare(text: str) -> str:
    """Lower case, without tags, white space, and marks at the ends."""
    text = _UNSEEN.sub(" ", _TAG.sub(" ", text)).lower()
    first = next((i for i, c in enumerate(text) if c.isalnum()), len(text))
    last = next((i for i in range(len(text) - 1, first - 1, -1) if text[i].isalnum()), first - 1)
    return " ".join(text[first : last + 1].split())


def is_empty(answer: str | None) -> bool:
    """Null, marks only, or a stand-in for an answer, with or without a leading label."""
    if answer is None:
        return True
    bare = _bare(answer)
    return bare in STAND_INS or _LABEL.sub("", bare) in STAND_INS


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_REFUSAL = re.compile("|".join(REFUSALS))
_OPEN = re.compile(rf"^(?:{_OPENINGS}[\s,.!]*(?:but |nhưng |and |thì |rằng )*)+")
_RESTATE = re.compile(rf"^(?:{_RESTATES})")
_OPEN_ONLY = re.compile(rf"^(?:{_OPENINGS}[\s,.!:]*)+$")


def _leads_to_refusal(before: str) -> bool:
    """Whether what stands before a refusal in its sentence only says what was asked, or joins the refusal on."""
    before = before.rstrip()
    if not before or _JOINS.fullmatch(before):
        return True
    return before[-1] in ",:;-–—" and _TOPIC.match(before) is not None


def is_refusal(answer: str) -> bool:
    """Whether the answer holds a refusal and, but for openings and restatements, nothing else."""
    refused, other = False, 0
    for sentence in _SENTENCE.split(answer.strip().lower().replace("’", "'")):
        rest = _OPEN.sub("", sentence.strip(" -*>\"“”"))
        if (m := _REFUSAL.search(rest)) and _leads_to_refusal(rest[: m.start()]):
            refused = True
        elif rest and not _RESTATE.match(rest) and not _OPEN_ONLY.match(sentence.strip()):
            other += len(_WORD.findall(rest))
            if other > 6:
                return False
    return refused and other <= 6


def tiled(answer: list[str], question: list[str], least: int = TILE) -> int:
    """Words of the answer under a greedy tiling with runs of the question's words, longest runs first.

    The question may give a run more than once; each word of the answer is under one tile at most.
    """
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(question) - least + 1):
        places.setdefault(tuple(question[i : i + least]), []).append(i)
    runs = []
    for i in range(len(answer) - least + 1):
        best = 0
        for j in places.get(tuple(answer[i : i + least]), ()):
            if i and j and answer[i - 1] == question[j - 1]:
                continue  # a part of the run that began before
            n = least
            while i + n < len(answer) and j + n < len(question) and answer[i + n] == question[j + n]:
                n += 1
            best = max(best, n)
        if best:
            runs.append((-best, i))
    free = [True] * len(answer)
    for length, i in sorted(runs):
        left = [k for k in range(i, i - length) if free[k]]
        if len(left) >= least:
            for k in left:
                free[k] = False
    return free.count(False)


def is_echo(answer: str, question: str) -> bool:
    """Whether the answer is only the question, or a part of it, even slightly changed."""
    a = _WORD.findall(re.sub(r"^\s*(?:hỏi|câu hỏi|nội dung|trả lời|question|đáp)\s*:\s*", "", answer.lower()))
    q = _WORD.findall(question.lower())
    if len(a) < 3 or not q:
        return False
    known = set(q)
    if sum(w in known for w in a) < ECHOED * len(a):
        return False
    covered = tiled(a, q)
    return covered >= ECHOED * len(a) or (len(a) <= 8 and covered >= len(a) - 1)


def language(text: str) -> str | None:
    """``vi``, ``en``, ``fr``, ``de``, ``es``, ``it``, ``other`` for another script, or none if it can't be told."""
    if len(_VIETNAMESE.findall(text)) > 0.06 * len(text):
        return "vi"
    words = _WORD.findall(text.lower())
    letters = [w for w in words if not w.isdigit()]
    if not letters:
        return None
    joined = "".join(letters)
    other = sum(1 for c in joined if c.isalpha() and ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF)
    if other > 0.5 * len(joined):
        return "other"
    accented = sum(1 for w in letters if _VIETNAMESE.search(w))
    counts = {k: sum(1 for w in letters if w in v) for k, v in _FREQUENT.items()}
    counts["vi"] = max(counts["vi"], 0) + 2 * accented
    best = max(counts, key=lambda k: (counts[k], k == "vi"))
    return best if counts[best] >= max(1, 0.12 * len(letters)) else None


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_SIGN = re.compile(r"(?m:(?P<item>(?:^|(?<=[;:.]\s))[ \t]*(?:[a-zđ]\)|\d{1,2}[.)]|[-–*•+])(?=\s|$)))|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(?P<single>/?)>|```|[()\[\]{}“”«»\"]")
_VOID = frozenset("br hr img input meta link wbr".split())


def open_structures(text: str) -> list[str]:
    """Pushdown parser: what is still open at the end of the text.

    Fences, tags, brackets and quotations, curly or straight, are pushed and popped; within a fence only its end
    counts. A list item is open until a word follows its marker, and an announced list until its first item. A closing
    sign whose opening one lies deeper closes what was opened since; one without an opening sign is ignored, and so
    are apostrophes and inches.
    """
    stack: list[str] = []
    marked = -1
    for m in _SIGN.finditer(text):
        sign = m.group()
        if stack and stack[-1] == "```" and sign != "```":
            continue
        if m["item"] is not None:
            marked = m.end()
            continue
        if m["tag"] is not None:
            name = m["tag"].lower()
            opener = f"<{name}>" if m["close"] else None
            if not m["close"] and not m["single"] and name not in _VOID:
                stack.append(f"<{name}>")
        elif sign in "([{“«":
            opener = None
            stack.append(sign)
        elif sign in _PAIRS:
            opener = _PAIRS[sign]
        elif sign in stack:
            opener = sign
        else:
            opener = None
            if sign != '"' or not text[m.start() - 1 : m.start()].isdigit():
                stack.append(sign)
        if opener is not None and opener in stack:
            while stack.pop() != opener:
                pass
    if marked >= 0 and not any(c.isalnum() for c in text[marked:]):
        stack.append("item")
    elif text.rstrip(" \t\n:").lower().endswith(INTROS):
        stack.append("list")
    return stack


_ENDING = re.compile(r"\n|(?<=[.!?…;:\])”\"])\s")
_STOP = re.compile(r"[.!?]\s+")


def _last(pattern: re.Pattern, text: str) -> re.Match | None:
    found = None
    for found in pattern.finditer(text):
        pass
    return found


def _without_closing(text: str) -> str:
    """The text without closing phrases and captions after its end."""
    while True:
        end = len(text.rstrip(" \t\n)]*.!,…"))
        cut = _last(_ENDING, text[:end])
        if cut is None or text[cut.end() : end].lstrip(" \t\n([*–-").lower() not in CLOSINGS:
            return text
        text = text[: cut.start()].rstrip()


def is_truncated(answer: str) -> bool:
    """Whether the answer breaks off before its sentence, list or structure is complete."""
    text = _without_closing(answer.rstrip())
    if not text:
        return False
    if open_structures(text):
        return True
    end = text.rstrip("*_`\"'”’»)] \t\n")
    if not end:
        return True
    last = end[-1]
    if last in ".!?":
        return end.endswith("...")
    if last in ",;:-–—…/&+=":
        return True
    # A complete sentence with a few words after its end, in lower case, is an inserted phrase and no new sentence.
    stop = _last(_STOP, end)
    return not (stop and end[stop.end() : stop.end() + 1].islower() and len(end[stop.end() :].split()) <= 4)


def defect(question: str | None, answer: str | None) -> str | None:
    """The first defect of a pair, or none."""
    if is_empty(answer):
        return "empty"
    question = question or ""
    if is_refusal(answer):
        return "refusal"
    if is_echo(answer, question):
        return "echo"
    asked, given = language(question), language(answer)
    if given and asked and given != asked and len(_WORD.findall(answer)) >= 3:
        return "wrong_language"
    if is_truncated(answer):
        return "truncated"
    return None


def defective_pairs(pairs: DataFrame, key: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, defect) of the pairs with a defect, once per id."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            questions, answers = consistent_array(batch.column(1)).to_pylist(), consistent_array(batch.column(2)).to_pylist()
            found = [defect(q, a) for q, a in zip(questions, answers)]
            kept = pa.array([f is not None for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), pa.array(found, pa.string()).filter(kept)], ["id", "defect"])

    given = pairs.select(F.col(key).cast("string").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a")).where("id IS NOT NULL")
    return given.mapInArrow(judge, "id string, defect string").groupBy("id").agg(F.min("defect").alias("defect"))
