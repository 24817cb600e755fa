"""Problem 2: one consistent character form.

A compiled longest-match transducer runs once over the grapheme clusters of a text. Its mapping is computed before
from rules (widths, spaces, invisible characters, and every way to write a composed letter with its accents) and from
one short table of look-alike letters, and is checked for conflicts when it is compiled: no input may have two
outputs, and no output may be an input again. Clusters that the mapping does not hold, such as three accents or
invisible characters between them, are composed one by one. Look-alikes are resolved by word, for a word wholly in
another alphabet stays as it is; a word's result is kept for its next occurrences.

Null stays null and empty stays empty; texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import permutations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other alphabets and the Latin letter each looks like.
LOOKALIKES = {
    "Latin": {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i"},
    "Cyrillic": {
        "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
        "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "к": "k", "м": "m", "т": "t", "ӏ": "l",
    },
    "Greek": {
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
        "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    },
    "Armenian": {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L"},
}

# Characters that need no look at all: plain ASCII, composed Latin letters but for the look-alikes among them,
# dashes, curly quotes, and common signs. Everything else makes a text a candidate for the transducer.
_PLAIN = "\\t\\n\\r\\x20-\\x7E\\xA1-\\xAC\\xAE-\\xCF\\xD1-\\xEF\\xF1-\\u0130\\u0132-\\u0188\\u018A-\\u024F\\u1E00-\\u1EFF\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF"
SUSPECT = f"[^{_PLAIN}]"
SUSPECT_RE2 = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", SUSPECT)


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0].title() if ch.isalpha() else ""


def _compositions() -> dict[str, str]:
    """Every way to write a composed letter of the basic plane as a letter and accents, in any order and part-composed."""
    out: dict[str, str] = {}
    for cp in (*range(0xC0, 0x2000), *range(0x3040, 0x3100), *range(0xFB1D, 0xFB50)):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) < 2 or unicodedata.normalize("NFC", ch) != ch:
            continue
        for order in permutations(parts[1:]):
            marks = "".join(order)
            for cut in range(len(marks) + 1):
                form = unicodedata.normalize("NFC", parts[0] + marks[:cut]) + marks[cut:]
                if form != ch and unicodedata.normalize("NFC", form) == ch:
                    out[form] = ch
    signs = (chr(cp) for cp in (*range(0x340, 0x3000), *range(0xF900, 0xFB50)))
    return out | {ch: form for ch in signs if (form := unicodedata.normalize("NFC", ch)) != ch and unicodedata.category(ch) != "Zs"}


def _singles() -> dict[str, str]:
    """Context-free rules: width, space and invisible characters."""
    out: dict[str, str] = {}
    for cp in (*range(0x80, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[ch] = " "
        elif kind in ("Zl", "Zp"):
            out[ch] = "\n"
        elif kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or ch in "\u034f\u115f\u1160\u3164\uffa0":
            out[ch] = ""
        elif 0xFF01 <= cp <= 0xFFEE or (0x1D400 <= cp <= 0x1D7FF and kind[0] in "LN"):
            wide = unicodedata.normalize("NFKC", ch)
            if wide[:1] == " ":  # a wide sign of a space and an accent: the sign itself
                wide = chr(int(unicodedata.decomposition(ch).split()[-1], 16))
            if wide != ch:
                out[ch] = wide
    out |= {chr(c): "" for c in range(0x20) if chr(c) not in "\t\n\r"} | {"\x7f": ""}
    return out


_MARK = re.compile(r"[\u1100-\u11ff\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]")


class Transducer:
    """The compiled mapping; ``run`` gives the consistent form of one text."""

    def __init__(self) -> None:
        self.single, self.composed = _singles(), _compositions()
        self.to_latin = {k: v for script in LOOKALIKES.values() for k, v in script.items()}
        self.from_latin: dict[str, dict[str, str]] = {s: {} for s in LOOKALIKES if s != "Latin"}
        for script, letters in LOOKALIKES.items():
            for other, latin in letters.items():
                if script != "Latin":
                    self.from_latin[script].setdefault(latin, other)
        self._check()
        self.machine = ahocorasick.Automaton()
        for form, value in (self.single | self.composed).items():
            self.machine.add_word(form, (len(form), value))
        self.machine.make_automaton()
        self.bases: dict[str, str] = {}
        self.scripts: dict[str, str] = {}
        self.invisible = {k for k, v in self.single.items() if v == ""}
        inner = "".join(sorted(re.escape(c) for c in self.invisible if ord(c) < 0x10000))
        self.token = re.compile(rf"(?:[^\W_]|[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff{inner}])+|[^\x20-\x7e\n]")
        self.word = lru_cache(maxsize=200_000)(self._word)

    def _check(self) -> None:
        """No input has two outputs, no output is an input again, and every output is composed."""
        every = self.single | self.to_latin | self.composed
        both = (self.single.keys() & self.to_latin.keys()) | (self.composed.keys() & (self.single.keys() | self.to_latin.keys()))
        again = {k for k, v in every.items() if v in self.composed or any(c in self.single for c in v)} | {k for k, v in self.to_latin.items() if v in self.to_latin}
        unstable = {k for k, v in every.items() if unicodedata.normalize("NFC", v) != v}
        if wrong := both | again | unstable:
            raise ValueError(f"conflicting mapping: {sorted(wrong)[:20]}")

    def _clusters(self, token: str) -> str:
        """One pass of the compiled machine: the longest cluster that it holds at each place."""
        out, last, seen = [], 0, True
        for end, (length, value) in self.machine.iter_long(token):
            out += (token[last : end + 1 - length], value)
            last = end + 1
            seen = seen and value != ""
        form = "".join(out) + token[last:]
        if seen and not _MARK.search(form):
            return form
        return unicodedata.normalize("NFC", form)  # accents that a dropped character or their number kept apart

    def _base(self, ch: str) -> str:
        """The letter below the accents."""
        if ch not in self.bases:
            self.bases[ch] = unicodedata.normalize("NFD", ch)[0]
            self.scripts[ch] = _script(self.bases[ch])
        return self.bases[ch]

    def _word(self, token: str) -> str:
        plain = self._clusters(token)
        if plain.isascii():
            return plain
        return re.sub(r"(?:[^\W\d_]|[\u0300-\u036f])+", lambda m: self._letters(m.group()), plain)

    def _letters(self, word: str) -> str:
        bare = {c: self._base(c) for c in word}
        scripts = self.scripts
        own: dict[str, int] = {}
        for c in word:
            if scripts[c] and bare[c] not in self.to_latin and not (scripts[c] == "Latin" and any(bare[c] in m for m in self.from_latin.values())):
                own[scripts[c]] = own.get(scripts[c], 0) + 1
        present = {scripts[c] for c in word} - {""}
        if present <= {"Latin"}:
            return unicodedata.normalize("NFC", "".join(self.to_latin.get(c, c) for c in word))
        if len(present) == 1:
            return word
        sure = {s: n for s, n in own.items() if s == "Latin" or s in self.from_latin}
        aim = max(sorted(sure), key=lambda s: (sure[s], s == "Latin")) if sure else "Latin"
        table = self.to_latin if aim == "Latin" else self.from_latin[aim]
        mapped = []
        for c in word:
            if bare[c] in table and (aim == "Latin" or scripts[c] == "Latin"):
                mapped.append(table[bare[c]] + unicodedata.normalize("NFD", c)[1:])
            else:
                mapped.append(c)
        return unicodedata.normalize("NFC", "".join(mapped))

    def run(self, text: str) -> str:
        return self.token.sub(lambda m: t if (t := m.group()).isascii() else self.word(t), text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent_text(text: str | None) -> str | None:
    """The consistent form of one text; null stays null."""
    return None if text is None else transducer().run(text)


@F.pandas_udf(StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    run = transducer().run
    return texts.map(lambda t: None if t is None else run(t))


def consistent(text: Column) -> Column:
    """Column in consistent form. Only texts with a suspect character travel to Python."""
    return F.coalesce(_consistent(F.when(text.rlike(SUSPECT), text)), text)


def with_consistent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``source: target`` of ``columns``, the consistent form of source in target."""
    return df.withColumns({target: consistent(F.col(source)) for source, target in columns.items()})


def inconsistent_records(df: DataFrame, key: str, text: str, table_name: str) -> DataFrame:
    """(table_name, record_id) of the records whose ``text`` differs from its consistent form, once per id.

    Null keys and null texts are never cases. The filter on suspect characters runs in the scan's stage, so
    that only candidates reach Python, and a shuffle carries ids only.
    """
    source = df.select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("t"))
    suspect = source.where(F.col("record_id").isNotNull() & F.col("t").rlike(SUSPECT))
    cases = suspect.withColumn("c", _consistent("t")).where(F.col("c") != F.col("t"))
    return cases.select(F.lit(table_name).alias("table_name"), "record_id").distinct()
