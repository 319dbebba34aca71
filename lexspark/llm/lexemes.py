"""What a dictionary record says, apart from how it is written: keys of forms and senses.

Everything here is a column expression, so that it stays in the JVM. Null in, null out unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.lookalike import HOMOGLYPHS
from lexspark.session import bounded_broadcast, written

#: Words that definitions are built with, without meaning of their own.
FUNCTION_WORDS = (
    "a an the in of for with which that what is was were be being to by as and or one any made kept used done said looks look serves serve like fit manner good apt "
    "especially means work kind way it its at on from arch obs fig"
).split()
#: Stand-ins for a definition.
DEFINITION_STAND_INS = ("", "—", "-", "–", "tbd", "n/a", "?", "see main entry", "(no definition given)", "(definition not extracted)", "none", "null", "...", "…", "unknown")
#: Stand-ins for a pronunciation.
PHONETIC_STAND_INS = ("", "n/a", "//", "-", "[?]", "?", "—", "–", "tbd", "none", "null", "/", "[]", "...")
#: A definition ends in one of these only if the rest is missing.
CUT_END = r"(?:\.\.\.|…|\[(?:cut|\.\.\.|…|truncated)\]|[,;:(]|\b(?:a|an|the|of|for|with|which|that|to|by|as|and|one|being|used|kept|made|done|means|especially))\s*$"

#: No sign of CUT_END is longer.
CUT_TAIL = 24


def _skeleton_map() -> tuple[str, str]:
    """Characters and the plain letter that stands for their look-alike class, accents and width aside."""
    out: dict[str, str] = {}
    for g in HOMOGLYPHS.split():
        first = g[0].lower()
        for c in g:
            if c.isalpha() and c.lower() != first:
                out[c] = first
                out.setdefault(c.lower(), first)
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF5B)]:
        c = chr(cp)
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        base = out.get(base, base)
        if base and base != c and c not in out:
            out[c] = base
    out["ς"] = out.get("σ", "σ")
    return "".join(out), "".join(out.values())


FROM, TO = _skeleton_map()
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}


def skeleton(form: Column) -> Column:
    """The letters of a form without case, accents, width, look-alikes, spaces, marks of editing and remarks in brackets."""
    x = F.regexp_replace(F.lower(form), r"\([^)]*\)|[\x{b9}\x{b2}\x{b3}0-9]", "")
    for wide, plain in LIGATURES.items():
        x = F.replace(x, F.lit(wide), F.lit(plain))
    x = F.translate(F.translate(x, FROM, TO), FROM, TO)
    return F.regexp_replace(x, r"[^\p{L}]", "")


def loose(skeleton_: Column) -> Column:
    """A skeleton without what variant spellings differ in: doubled letters and letters written with two signs."""
    x = F.translate(skeleton_, "þðæœøkqvyjzçwh", "ttaeoccuiissu")  # h has no other letter: it goes
    x = F.regexp_replace(x, "cs|x", "x")
    return F.regexp_replace(x, r"(\p{L})\1+", "$1")


def real_definition(c: Column) -> Column:
    """The definition, or null if it is blank or a stand-in."""
    return F.when(~F.lower(F.trim(c)).isin(*DEFINITION_STAND_INS), F.trim(c))


def real_phonetic(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*PHONETIC_STAND_INS), c)


def seems_cut(c: Column) -> Column:
    """Whether a text visibly breaks off. A prefix of another member's text is a matter of the group."""
    # the signs have no space within: only what follows the last one is searched
    last = F.substring_index(F.rtrim(F.right(c, F.lit(CUT_TAIL)), F.lit(" \t\n\x0b\f\r")), " ", -1)
    return F.lower(last).rlike(CUT_END) | (F.length(F.replace(c, F.lit("("), F.lit(""))) < F.length(F.replace(c, F.lit(")"), F.lit(""))))


def stems(definition: Column) -> Column:
    """The different content words of a definition, stemmed and sorted; domain and usage labels don't count."""
    x = F.regexp_replace(F.lower(definition), r"^\s*(?:\([^)]*\)\s*)?(?:in [\p{L} ]+:)?|\[cut\]", "")
    x = F.regexp_replace(F.replace(x, F.lit(" sort, for "), F.lit(" ")), r" sort,?\s*$|-like\b", " ")
    # tests that look back stand behind the characters that they are about: positions without those cost nothing
    x = F.regexp_replace(x, r"-(?<=\p{L}-)(?=\p{L})", "")
    w = F.array_join(F.array_distinct(F.filter(F.split(x, r"[^\p{L}]+"), lambda t: ~t.isin("", *FUNCTION_WORDS))), " ")
    # stems of all words at a time
    w = F.regexp_replace(w, r"(?:ing|ed|e|s)(?!\p{L})(?<=\p{L}{3}(?:ing|ed|e|s))", "")
    w = F.regexp_replace(F.regexp_replace(w, r"i\b", "y"), r"(\p{L})\1\b", "$1")
    return F.sort_array(F.array_remove(F.split(w, " "), ""))


def identity(*columns: Column | str) -> Column:
    """A key of 128 bits for a combination of values; nulls and empty values differ."""
    given = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\0")) for c in columns]
    return F.concat(F.hex(F.xxhash64(*given)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *given)))


def _set_hash(seed: str, *given: Column | str) -> Column:
    """The exclusive or of the hashes of w's words and of what is given: taking a word out again costs one operation, however long w."""
    return F.aggregate("w", F.xxhash64(F.lit(seed), *given), lambda s, t: s.bitwiseXOR(F.xxhash64(F.lit(seed), t)))


def synonyms(several: DataFrame, lone: DataFrame, support: int = 3, share: float = 0.1) -> DataFrame:
    """(word, same): words that replace each other in definitions of one form, the rarer with the more frequent.

    several: a written (k, w), different definitions of two words at least, with form key k and sorted different stems w,
    of any length; lone: w of the forms with a single definition, which have nothing to compare it with and only count for
    the words' frequencies. Definitions of one word share nothing that could make another one its rewording. Learned:
    definitions of a form that differ in one word only have an open place; each word in it makes a pair with the most
    frequent one there, which is linear in the words of a place. A pair counts from `support` places on and from `share`
    of the rarer word's places.
    """
    place = ["h1", "h2"]  # of the form, the number of words and the other words: 128 bits together
    x = several.select(*[_set_hash(h[1], "k", F.size("w")).alias(h) for h in place], F.explode("w").alias("word"))
    x = x.select("word", *[F.col(h).bitwiseXOR(F.xxhash64(F.lit(h[1]), "word")).alias(h) for h in place])
    # keys and stems are distinct: a count of rows is a count of words in the open place
    places = written(x.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    freq = written(several.select("w").unionByName(lone).select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f")))
    members = written(x.join(bounded_broadcast(places), place, "left_semi").join(bounded_broadcast(freq), "word"))
    tops = members.groupBy(*place).agg(F.min(F.struct((-F.col("f")).alias("f"), F.col("word").alias("same"))).alias("top"))
    pairs = members.join(tops, place).filter("word <> top.same").groupBy("word", F.col("top.same").alias("same")).agg(F.count("*").alias("n"), F.first("f").alias("f"))
    good = pairs.filter((F.col("n") >= support) & (F.col("n") >= share * F.col("f")))
    return good.groupBy("word").agg(F.max(F.struct("n", "same")).alias("x")).select("word", "x.same")


def learned(words: DataFrame) -> DataFrame:
    """(word, same) of all synonyms of words (k, w): rounds of synonyms() over the words rewritten so far, until a round finds nothing.

    Later rounds find words that only occur beside other synonyms. Each round leaves fewer words, so they end. Rewriting
    merges definitions of a form but makes none: forms with a single one are set apart once.
    """
    d = words.select("k", "w").filter("size(w) > 1").distinct()
    d = written(d.withColumn("n", F.count("*").over(Window.partitionBy("k"))))
    alone, several = d.filter("n = 1").select("w"), d.filter("n > 1").select("k", "w")
    again = lambda x, by: rewritten(x, by).withColumn("w", F.array_distinct("cw")).drop("cw").filter("size(w) > 1")
    same = written(synonyms(several, alone))
    new = same
    while not new.isEmpty():
        several = written(again(several, new).distinct())
        new = written(synonyms(several, again(alone, same)))
        moved = same.join(new.select(F.col("word").alias("same"), F.col("same").alias("to")), "same", "left").select("word", F.coalesce("to", "same").alias("same"))
        same = written(moved.unionByName(new.join(same.select("word"), "word", "left_anti")))
    return same


#: A table of synonyms of at most so many rows becomes part of the plan; a longer one is joined.
MAP_WORDS = 256


def rewritten(x: DataFrame, same: DataFrame, most: int = MAP_WORDS) -> DataFrame:
    """x with cw, the words w with synonyms replaced, sorted; null for null. same: a written table."""
    rows = same.limit(most + 1).collect()  # bounded by most
    if not rows:
        return x.withColumn("cw", F.col("w"))
    if len(rows) <= most:
        by = F.create_map(*[F.lit(v) for r in rows for v in (r["word"], r["same"])])
        known = [r["word"] for r in rows]  # a set; the map is searched word by word
        return x.withColumn("cw", F.sort_array(F.transform("w", lambda t: F.when(t.isin(*known), F.try_element_at(by, t)).otherwise(t))))
    return joined_words(x, same)


def joined_words(x: DataFrame, same: DataFrame) -> DataFrame:
    """The same for a table of any size.

    Word lists are reduced to distinct ones and only changed ones are joined back, so that a list repeated in any
    number of rows is rewritten once; rows without words stay out of the join.
    """
    lists = x.filter("size(w) > 0").select("w").distinct().select("w", F.explode("w").alias("word"))
    lists = lists.join(bounded_broadcast(same), "word", "left").groupBy("w").agg(F.array_sort(F.collect_list(F.coalesce("same", "word"))).alias("cw"), F.count("same").alias("changed"))
    y = x.filter("size(w) > 0").join(lists.filter("changed > 0").select("w", "cw"), "w", "left").select(*x.columns, F.coalesce("cw", "w").alias("cw"))
    return y.unionByName(x.filter("w is null or size(w) = 0").withColumn("cw", F.col("w")))
