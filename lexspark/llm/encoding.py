"""Garbled text from wrong character encoding (problem 7).

Characters are mapped back to the bytes of a legacy code page, a byte-structure automaton finds the maximal
well-formed multibyte UTF-8 spans among them, and only those spans are decoded. Text garbled several times is repaired
in as many passes: each one shortens the text, so they end by themselves. What stays unreadable (replacement characters, stray halves of a sequence) is reported as
garbled but not restored.

Null and empty text: not garbled, repaired to itself. Length has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Code pages in which UTF-8 bytes are read by mistake, in order of preference.
CODE_PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_7", "iso8859_15", "koi8_r", "cp866")
#: Code pages whose upper half is another alphabet: ordinary capitals and letters may look like a sequence there,
#: so that what is decoded from them must be letters or common punctuation.
OTHER_SCRIPT = ("cp1251", "cp1253", "iso8859_7", "koi8_r", "cp866")
#: The structure of UTF-8: what may follow a lead byte.
WELL_FORMED = (
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})"
)
SPAN = re.compile(WELL_FORMED + b"+")


def _code_page(name: str) -> dict[str, int]:
    """Characters of the upper half of a code page with their bytes; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    if name == "cp1252":  # Latin-1 differs from it in the C1 controls only
        out.update({chr(b): b for b in range(0x80, 0xA0) if chr(b) not in out})
    return out


TABLES = {n: _code_page(n) for n in CODE_PAGES}


def _chars(cs) -> str:
    return "".join(re.escape(c) if c < "\x80" else f"\\x{{{ord(c):04x}}}" for c in sorted(set(cs)))


def _pairs() -> dict[str, re.Pattern]:
    """By code page: a lead byte's character before a continuation byte's; without one there is no span."""
    out = {}
    for n, t in TABLES.items():
        lead, cont = ("".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
        out[n] = re.compile(f"[{lead}][{cont}]")
    return out


PAIRS = _pairs()


def _suspect_pattern() -> str:
    """Java pattern: in some code page a lead byte of UTF-8 followed by a continuation byte, or a sure sign of loss."""
    parts = []
    for n in CODE_PAGES:
        lead = _chars(c for c, b in TABLES[n].items() if 0xC2 <= b <= (0xDF if n in OTHER_SCRIPT else 0xF4) or b == 0xE2)
        cont = _chars(c for c, b in TABLES[n].items() if 0x80 <= b <= 0xBF)
        parts.append(f"[{lead}][{cont}]")
    # ASCII characters are passed over by one test
    return "(?=[^\\x{00}-\\x{7f}])(?:" + "|".join(parts) + f"|[{LOST_JAVA}]|[{_chars(map(chr, [*range(0xC0, 0x100), 0xA2]))}]{{3}}|{STRAY.pattern})"


#: Characters that no text of these tables has by itself: controls, the replacement character, boxes.
LOST_JAVA = r"\x{0080}-\x{009f}\x{fffd}\x{2500}-\x{259f}"
LOST = re.compile("[\x80-\x9f�─-▟]")
#: Half of a sequence whose other half was lost: a lead character inside or before a word with no valid partner,
#: or the lead of punctuation (E2 80) without its third byte.
STRAY = re.compile("â€|[ÃÂÐÎÏ](?=[\xa0\xad¡-¿])|√|├|╨|╤")
SUSPECT = _suspect_pattern()
#: A wider, faster test before it: a non-ASCII character, then one beyond ASCII or a sign of loss.
MAYBE = f"[^\\x{{00}}-\\x{{7f}}]{{2}}|[{LOST_JAVA}√]"



PUNCTUATION = "\xa0\xad£§«»¿¡¹²³‘’“”‚„–—‐…→ʰˈː"
#: What a text that was garbled twice consists of after one pass.
GARBLE = frozenset(c for n in CODE_PAGES if n not in OTHER_SCRIPT for c in TABLES[n]) | frozenset(map(chr, range(0x80, 0x100)))


def _letter(c: str) -> bool:
    return c.isalpha() and (c < "\u02b0" or "\u0370" <= c < "\u0530" or "\u1e00" <= c < "\u2000")


def _decoded_ok(s: str, strict: bool) -> bool:
    """Whether a decoded span is text in a script in use here, or, unless strict, what such text looks like when it was garbled twice."""
    return all(_letter(c) or c in PUNCTUATION or "\u0300" <= c <= "\u0328" and not strict or not strict and (c in GARBLE or c in "\u200b\u200c\u200d\u2060\ufeff\u2002\u2009\u202f\u3000\ufffd") for c in s)


#: A word of upper-half letters alone: eight-bit Cyrillic or Greek text read as Latin-1.
EIGHT_BIT = re.compile("(?<![A-Za-z])[À-ÿ¢]{3,}(?![A-Za-z])")
EIGHT_BIT_WORD = re.compile("(?<!\\w)[à-ÿÀ-ÞÜÝß]{4,}(?!\\w)")
C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _eight_bit(m: re.Match) -> str:
    """The word in the alphabet that it was written in; itself if it is none."""
    best, most = m.group(), -1.0
    for name in ("cp1251", "cp1253"):
        try:
            w = m.group().encode("latin-1").decode(name)
        except UnicodeDecodeError:
            continue
        if not w.isalpha() or "ς" in w[:-1]:
            continue
        vowels = sum(c in "аеиоуыэюяӣӯαεηιουωάέήίόύώ" for c in w.lower()) / len(w)
        if (score := 1 - abs(vowels - 0.45)) > most:
            best, most = w, score
    return best


def _score(span: str) -> float:
    """Decoded characters that a text has: letters of one script and common punctuation count most."""
    n = 0.0
    for c in span:
        if c.isalpha():
            n += 1.0 if ord(c) < 0x250 or 0x370 <= ord(c) < 0x460 or 0x1E00 <= ord(c) < 0x2000 else 0.8
        elif c in "“”‘’—–‐…£°§€\xa0\xad":
            n += 1.0
        else:
            n += 0.3
    return n


def _one_pass(text: str) -> str:
    best, best_score = text, 0.0
    for name in CODE_PAGES:
        if not PAIRS[name].search(text):
            continue
        t = TABLES[name]
        raw = bytes(t.get(c, 0) if c >= "\x80" else 0 for c in text)
        if not (m := SPAN.search(raw)):
            continue
        out, at, score, used = [], 0, 0.0, 0
        while m:
            s = raw[m.start():m.end()].decode("utf-8")
            if _decoded_ok(s, name in OTHER_SCRIPT):
                out.append(text[at:m.start()])
                out.append(s)
                score += _score(s)
                used += m.end() - m.start()
            else:
                out.append(text[at:m.end()])
            at = m.end()
            m = SPAN.search(raw, at)
        out.append(text[at:])
        # garbled characters left over speak against a code page
        score += used / 100 - 0.5 * len(LOST.findall("".join(out)))
        if score > best_score:
            best, best_score = "".join(out), score
    return best


def repair(text: str | None) -> str | None:
    """The text with every well-formed span decoded, pass by pass; then the controls and words of eight-bit text."""
    if text is None:
        return None
    text = EIGHT_BIT_WORD.sub(_eight_bit, text)
    while (fixed := _one_pass(text)) != text:
        text = fixed
    return EIGHT_BIT.sub(_eight_bit, text.translate(C1))


def is_garbled(text: str | None) -> bool:
    """Whether a text is garbled wholly or in part, restorable or not."""
    if not text:
        return False
    return judged(text)[0]


def judged(text: str) -> tuple[bool, str]:
    """Whether a text is garbled, and the text restored as far as possible."""
    restored = repair(text)
    return bool(LOST.search(text)) or bool(STRAY.search(text)) or restored != text, restored


def suspect(c: Column) -> Column:
    """A cheap test in the JVM that every garbled text passes; null for null."""
    return c.rlike(MAYBE) & c.rlike(SUSPECT)


@pandas_udf(StringType())
def _repair_udf(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(repair, na_action="ignore")


@pandas_udf(StructType([StructField("garbled", BooleanType()), StructField("restored", StringType())]))
def _judged_udf(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in it:
        yield pd.DataFrame([judged(v) for v in s], columns=["garbled", "restored"])


def repaired(c: Column) -> Column:
    """Column with garbled spans restored. Only suspects reach Python: others are replaced by null on the way."""
    return F.coalesce(_repair_udf(F.when(suspect(c), c)), c)


def garbled(df, columns: list[str], key: Column, table_name: str):
    """(table_name, record_id, field, value, restored): every garbled value, distinct.

    Only rows with a suspect value leave the JVM. Null keys and values are no cases.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])
    x = df.select(key.cast("string").alias("record_id"), F.explode(pairs).alias("x")).select("record_id", "x.field", "x.value")
    x = x.filter(F.col("value").isNotNull() & suspect(F.col("value")) & F.col("record_id").isNotNull())
    x = x.withColumn("j", _judged_udf("value")).filter("j.garbled")
    return x.select(F.lit(table_name).alias("table_name"), "record_id", "field", "value", F.col("j.restored").alias("restored")).distinct()
