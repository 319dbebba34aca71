"""Scalar functions on text, years and periods: Column in, Column out, null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, with that letter; by rule over the alphabets in use."""
    a, b = [], []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            a.append(chr(cp))
            b.append(base)
    return "".join(a), "".join(b)


ACCENTED, PLAIN = _plain_letters()


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[\x{300}-\x{36f}]", "")


def normal_form(c: Column) -> Column:
    """Lower case without diacritics."""
    return strip_diacritics(F.lower(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncated(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def parse_year(c: Column) -> Column:
    """Leading digits as a year, negative before BC or BCE; anything else gives null. Trailing text is ignored."""
    x = F.upper(F.trim(c))
    n = F.regexp_extract(x, r"^(\d{1,9})", 1).try_cast("int")
    return F.when(x.rlike(r"^\d+\s*BCE?"), -n).otherwise(n)


def strict_year(c: Column) -> Column:
    """As parse_year, but a year after Christ must stand alone, CE or AD aside."""
    x = F.upper(F.trim(c))
    n = F.regexp_extract(x, r"^(\d{1,9})", 1).try_cast("int")
    return F.when(x.rlike(r"^\d+\s*BCE?"), -n).when(x.rlike(r"^\d+\s*(?:CE|AD)?$"), n)


def year_text(y: Column) -> Column:
    return F.when(y.isNull(), "unknown").when(y < 0, F.concat(F.abs(y).cast("string"), F.lit(" BCE"))).otherwise(y.cast("string"))


def century_start(y: Column) -> Column:
    return (F.floor(y / 100) * 100).cast("int")


def century_label(y: Column) -> Column:
    n = F.floor(F.abs(y) / 100) + 1
    return F.concat(n.cast("string"), F.when(y >= 0, "th century CE").otherwise("th century BCE"))


def label_range(label: Column) -> Column:
    """struct(start, end) of a century label; malformed labels are the first century."""
    n = F.regexp_extract(label, r"^(\d+)", 1).try_cast("int")
    bce = F.struct((-(n - 1) * 100 - 100).cast("int").alias("start"), (-(n - 1) * 100).cast("int").alias("end"))
    ce = F.struct(((n - 1) * 100).cast("int").alias("start"), (n * 100).cast("int").alias("end"))
    first = F.struct(F.lit(0).alias("start"), F.lit(100).alias("end"))
    return F.when(n.isNull(), first).when(F.endswith(label, F.lit("BCE")), bce).otherwise(ce)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two periods as a share of the shorter; an open end gives a half, a point inside gives 1."""
    s, e = F.greatest(F.least(a0, a1), F.least(b0, b1)), F.least(F.greatest(a0, a1), F.greatest(b0, b1))
    shorter = F.least(F.abs(a1 - a0), F.abs(b1 - b0))
    ratio = F.when(e < s, 0.0).when(shorter == 0, 1.0).otherwise((e - s) / F.nullif(shorter, F.lit(0)))
    return F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), 0.5).otherwise(ratio)


def midpoint(start: Column, end: Column) -> Column:
    """Middle of a period; an end of null or 0 counts as missing."""
    return F.floor((start + F.when(end.isNull() | (end == 0), start).otherwise(end)) / 2).cast("int")


def sanitized(c: Column, most: int = 1000) -> Column:
    """Collapsed, HTML-escaped, cut to a length."""
    x = collapse(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.substring(x, 1, most)


def identifier(c: Column) -> Column:
    return F.substring(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "")), 1, 50)


def iso_code(c: Column) -> Column:
    return F.substring(F.lower(F.regexp_replace(c, r"[^A-Za-z-]", "")), 1, 10)


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters alone, in order, in lower case; a word with any other letter, digit or underscore isn't split."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-zA-Z]+$")), F.lower)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(u, F.lit(0)))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def date_proximity(year: Column, start: Column, end: Column) -> Column:
    """1 inside the period, falling to 0 over a century; years that are null or 0 are missing and give a half."""
    missing = year.isNull() | (year == 0) | start.isNull() | (start == 0) | end.isNull() | (end == 0)
    outside = F.greatest(F.lit(0.0), 1 - F.least(F.abs(year - start), F.abs(year - end)) / 100)
    return F.when(missing, 0.5).when((year >= start) & (year <= end), 1.0).otherwise(outside)


def suffix_change(source: Column, target: Column) -> Column:
    """`-xy > -zw` if the last two letters differ and both words are longer than two letters."""
    a, b = F.right(source, F.lit(2)), F.right(target, F.lit(2))
    return F.when((F.length(source) > 2) & (F.length(target) > 2) & (a != b), F.concat(F.lit("-"), a, F.lit(" > -"), b))
