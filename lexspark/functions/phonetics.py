"""Phonetic functions: codes, distances on pronunciations, sound laws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grimm's law, in the order of application; a changed sound isn't changed again.
GRIMM = (("bh", "B"), ("dh", "D"), ("gh", "G"), ("p", "f"), ("t", "th"), ("k", "h"), ("b", "p"), ("d", "t"), ("g", "k"), ("B", "b"), ("D", "d"), ("G", "g"))


def code(c: Column) -> Column:
    """Soundex; empty for text without ASCII letters."""
    x = F.regexp_replace(c, "[^A-Za-z]", "")
    return F.when(c.isNull(), None).when(x == "", "").otherwise(F.soundex(x))


def distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer pronunciation, stress marks aside: 0 for two empty ones, null for null."""
    a, b = F.regexp_replace(a, "[ˈˌ.]", ""), F.regexp_replace(b, "[ˈˌ.]", "")
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 0.0).otherwise(F.levenshtein(a, b) / F.nullif(n, F.lit(0)))


def sound_law(c: Column, rules: tuple[tuple[str, str], ...] = GRIMM) -> Column:
    for a, b in rules:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
