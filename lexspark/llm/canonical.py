"""Mapping freely entered values to a canonical list (problem 1).

Token-level repair: every distinct token of the entered values is joined to the tokens of the reference list by
edit distance, weighted by how well it fits; the repaired tokens of a value and the tokens of every reference name
are then compared by soft TF-IDF, and the best name wins if it is good enough and not tied with another one.
A value written without or with misplaced spaces is compared as a whole in the same way, its letters being one
more token.

Candidates come from an equi-join on segments of tokens, whatever the size of the list: its tables are broadcast below
a counted bound and shuffled beyond it. Entered values are reduced to distinct ones before any of this; pairs of name
and code that hold a large share of the rows are split off when rows are joined back. Null, blank and unknown values
come out as unmatched; ties between names as well. An empty list leaves everything unmatched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import HOT, bounded_broadcast, written


UNMATCHED = "none"
#: Letters with accents and what they are without.
ACCENTED, PLAIN = "áàâäãåāăąéèêëēĕėęěíìîïĩīįóòôöõōőøúùûüũūůűýÿçćčñńňşśšžźżřŕďđťţğģķļĺľłŵŷß", "aaaaaaaaaeeeeeeeeeiiiiiiioooooooouuuuuuuuyycccnnnssszzzrrddttggkllllwys"
#: Words that qualify a language name without being part of it.
QUALIFIERS = "the tongue language lang lg dialect speech written spoken of northern southern eastern western island coastal inland upper lower idiom variety form idiome langue sprache lengua"
#: Words that are part of a name even in brackets.
STAGES = ("old", "middle", "mid", "proto", "common")
#: An abbreviated word: up to this many letters, the beginning of a reference token, worth this much.
ABBREVIATION, ABBREVIATED = 3, 0.9
#: A repaired token must keep this share of its letters; a name's score must reach MIN_SCORE.
MIN_TOKEN, MIN_SCORE = 0.6, 0.75
#: A token this much worse than the best repair of the same token isn't considered.
MARGIN = 0.1


def fold(c: Column) -> Column:
    """Lower case without accents, odd spaces or invisible characters."""
    x = F.lower(F.regexp_replace(c, "[\\x{ad}\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]", ""))
    x = F.regexp_replace(F.translate(x, ACCENTED, PLAIN), "[\\x{300}-\\x{36f}]", "")
    return F.trim(F.regexp_replace(x, "[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+", " "))


def blank(c: Column) -> Column:
    return F.coalesce(fold(c) == "", F.lit(True))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, "[^\\p{L}]+"), lambda w: w != "")


def reference(languages: DataFrame) -> DataFrame:
    """(iso_code, name_id, name, words, whole) of every accepted name; codes are matched apart."""
    names = languages.select("iso_code", F.explode(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("n"))
    x = names.withColumn("name", fold(F.col("n"))).filter("length(name) > 2").select("iso_code", "name").distinct()
    x = x.withColumn("words", _words(F.col("name"))).withColumn("whole", F.array_join("words", ""))
    return x.withColumn("name_id", F.xxhash64("iso_code", "name"))


def codes(languages: DataFrame) -> DataFrame:
    """(code, iso_code): canonical codes and the short codes among the other names; a code of two languages is none."""
    alt = languages.select("iso_code", F.explode(F.coalesce("alt_names", F.array().cast("array<string>"))).alias("code")).filter("length(code) <= 2")
    x = languages.select("iso_code", F.col("iso_code").alias("code")).unionByName(alt).withColumn("code", fold(F.col("code"))).distinct()
    return x.groupBy("code").agg(F.min("iso_code").alias("iso_code"), F.count_distinct("iso_code").alias("n")).filter("n = 1").drop("n")


def clean_code(c: Column) -> Column:
    return F.regexp_replace(fold(c), "^[^\\p{L}]+|[^\\p{L}]+$", "")


def _edits(a: Column, b: Column) -> Column:
    """The edits that two tokens of these lengths may be apart."""
    return F.floor((1 - MIN_TOKEN) * F.greatest(a, b) + 1e-9).cast("int")


def near(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(t, part, token, idf, sim) of tokens (t, part) and vocabulary (token, idf, part) at least MIN_TOKEN alike.

    An equi-join finds the candidates, whatever the sizes: of K edits, K + 1 segments of t leave one untouched, so a
    reference token has it within K places of where it stands in t. The reference tokens, the smaller side, are listed
    by all their windows; a token of the values by its own few segments. A swap of two neighbours counts as one edit:
    tokens with the same letters meet as well.
    """
    seg = lambda n, k: f"transform(sequence(0, {k}), i -> struct(i as seg, cast(floor(i * {n} / ({k} + 1)) as int) as at, cast(floor((i + 1) * {n} / ({k} + 1)) as int) as til))"
    # by reference token: each length that a token of the values may have, and the edits that go with it
    v = vocabulary.select("token", "part", "idf", F.length("token").alias("m"))
    v = v.withColumn("n", F.explode(F.expr(f"sequence(greatest(1, cast(ceil(m * {MIN_TOKEN} - 1e-9) as int)), cast(floor(m / {MIN_TOKEN} + 1e-9) as int))")))
    v = v.withColumn("k", _edits(F.col("m"), F.col("n"))).withColumn("s", F.explode(F.expr(seg("n", "k"))))
    v = v.withColumn("p", F.explode(F.expr("sequence(greatest(0, s.at - k), least(m, s.at + k))")))
    v = v.select("token", "part", "idf", "n", "k", F.col("s.seg").alias("seg"), F.expr("substr(token, p + 1, s.til - s.at)").alias("piece")).filter("length(piece) > 0 or k >= n").distinct()
    t = tokens.withColumn("n", F.length("t"))
    t = t.withColumn("k", F.explode(F.expr(f"sequence(cast(floor({1 - MIN_TOKEN} * n + 1e-9) as int), cast(floor({1 - MIN_TOKEN} * floor(n / {MIN_TOKEN} + 1e-9) + 1e-9) as int))")))
    t = t.withColumn("s", F.explode(F.expr(seg("n", "k")))).select("t", "part", "n", "k", F.col("s.seg").alias("seg"), F.expr("substr(t, s.at + 1, s.til - s.at)").alias("piece"))
    pairs = t.join(bounded_broadcast(written(v)), ["part", "n", "k", "seg", "piece"]).select("t", "part", "token", "idf")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = tokens.withColumn("l", letters(F.col("t"))).join(bounded_broadcast(vocabulary.withColumn("l", letters(F.col("token")))), ["part", "l"]).select("t", "part", "token", "idf")
    x = pairs.unionByName(swapped).distinct()
    d = F.levenshtein("t", "token")
    d = F.when((letters(F.col("t")) == letters(F.col("token"))) & (d == 2), 1).otherwise(d)
    return x.withColumn("sim", 1 - d / F.greatest(F.length("t"), F.length("token"))).filter(F.col("sim") >= MIN_TOKEN)


def by_name(values: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, iso_code, score) for distinct entered names; unmatched ones are absent.

    values: (language), any number of repeats.
    """
    ref = written(reference(languages))
    v = values.select("language").distinct().withColumn("f", fold(F.col("language"))).filter("f <> ''")
    # a remark in brackets, after a slash or before a colon isn't part of the name, unless nothing else is there
    core = F.trim(F.regexp_replace(F.regexp_replace("f", "\\([^)]*\\)|\\[[^\\]]*\\]", " "), "\\s*/.*$|^[\\p{L}-]{2,7}:", " "))
    v = v.withColumn("core", F.when(F.length(core) > 0, core).otherwise(F.col("f")))
    every = F.array(*map(F.lit, QUALIFIERS.split()))
    v = v.join(bounded_broadcast(ref.select(F.col("name").alias("core"), F.lit(True).alias("is_name")).distinct()), "core", "left")
    aside = F.flatten(F.transform(F.regexp_extract_all("f", F.lit("[(\\[]([^)\\]]*)[)\\]]"), F.lit(1)), _words))
    aside = F.filter(aside, lambda w: w.isin(*STAGES))
    v = v.withColumn("all", F.when(F.col("core") == F.col("f"), _words(F.col("core"))).otherwise(F.concat(aside, _words(F.col("core"))))).withColumn("kept", F.filter("all", lambda w: ~F.array_contains(every, w)))
    v = v.withColumn("words", F.when(F.col("is_name").isNotNull() | (F.size("kept") == 0), F.col("all")).otherwise(F.col("kept")))
    v = written(v.filter(F.size("words") > 0).select("language", "words", F.array_join("words", "").alias("whole")))

    # vocabulary: the words of all names, and all names written together; weight: inverse document frequency
    n = max(1, ref.count())
    rare = math.log(n) + 1
    own_words = ref.select("name_id", "iso_code", F.explode(F.array_distinct("words")).alias("token"))
    idf = written(own_words.groupBy("token").agg((F.log(F.lit(n) / F.count("*")) + 1).alias("idf")))
    wholes = ref.select(F.col("whole").alias("token"), "iso_code").distinct()
    vocabulary = written(idf.select("token", "idf", F.lit(True).alias("part")).unionByName(wholes.select("token", F.lit(rare).alias("idf"), F.lit(False).alias("part")).distinct()))
    weighed = own_words.join(bounded_broadcast(idf), "token")
    norm = weighed.groupBy("name_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    name_words = written(weighed.join(norm, "name_id").select("name_id", "iso_code", "token", "norm"))

    tokens = v.select(F.explode(F.concat(F.transform("words", lambda w: F.struct(w.alias("t"), F.lit(True).alias("part"))), F.array(F.struct(F.col("whole").alias("t"), F.lit(False).alias("part"))))).alias("x")).select("x.t", "x.part").distinct()
    tokens = written(tokens)
    close = near(tokens, vocabulary)
    beginnings = idf.filter("length(token) > 1").select(F.explode(F.expr(f"transform(sequence(1, least({ABBREVIATION}, length(token) - 1)), k -> substr(token, 1, k))")).alias("t"), "token", "idf")
    short = tokens.filter((F.col("part")) & (F.length("t") <= ABBREVIATION)).join(bounded_broadcast(beginnings), "t")
    close = close.unionByName(short.select("t", "part", "token", "idf", F.lit(ABBREVIATED).alias("sim")))
    top = Window.partitionBy("t", "part")
    repaired = written(close.withColumn("best", F.max("sim").over(top)).filter(F.col("sim") >= F.col("best") - MARGIN).drop("best"))

    # soft TF-IDF over words: sum of products of weights of repaired words, by the names that contain them; a word
    # weighs what its repair in that name weighs, or as much as the rarest if it has none there
    words = v.select("language", F.size("words").alias("k"), F.posexplode("words").alias("i", "t")).join(repaired.filter("part").drop("part"), "t")
    # a word of the name goes to the entered word closest to it
    closest = Window.partitionBy("language", "name_id", "token")
    hits = words.join(bounded_broadcast(name_words), "token").withColumn("top", F.max("sim").over(closest)).filter("sim = top").groupBy("language", "k", "name_id", "iso_code", "norm", "i").agg(F.max(F.struct(F.col("sim") * F.col("idf") ** 2, "token", "idf")).alias("m"))
    hits = hits.select("language", "k", "name_id", "iso_code", "norm", "i", F.col("m.col1").alias("p"), "m.token", "m.idf")
    once = hits.groupBy("language", "k", "name_id", "iso_code", "norm", "token").agg(F.max("p").alias("p"), F.max("idf").alias("idf"), F.count("*").alias("used"))
    own = F.sqrt(F.sum(F.col("used") * F.col("idf") ** 2) + (F.col("k") - F.sum("used")) * rare**2)
    by_word = once.groupBy("language", "k", "name_id", "iso_code", "norm").agg(F.sum("p").alias("p"), own.alias("own"))
    by_word = by_word.select("language", "iso_code", (F.col("p") / (F.col("norm") * F.col("own"))).alias("score"))
    # the same for the value as a whole
    whole = v.filter(F.array_min(F.transform("words", F.length)) > 1).select("language", F.col("whole").alias("t")).join(repaired.filter("not part").drop("part"), "t")
    by_whole = whole.join(bounded_broadcast(wholes), "token").select("language", "iso_code", F.col("sim").alias("score"))
    best = by_word.unionByName(by_whole).groupBy("language", "iso_code").agg(F.max("score").alias("score")).filter(F.col("score") >= MIN_SCORE)
    r = Window.partitionBy("language").orderBy(F.desc("score"))
    best = best.withColumn("second", F.lead("score").over(r)).withColumn("rank", F.row_number().over(r)).filter("rank = 1 and (second is null or second < score - 0.02)")
    return best.select("language", "iso_code", "score")


def resolve(entries: DataFrame, languages: DataFrame) -> DataFrame:
    """entries (entry_id, language, language_code) with iso_code (`none` if unmatched), score and exact.

    Distinct pairs are resolved, then joined back: repeated rows come out as often as they went in.
    """
    entries = entries.drop("iso_code", "score", "exact", "_l", "_k")  # columns of these names give way to the result's
    languages = languages.select("iso_code", "name", "alt_names")
    pairs = written(entries.groupBy("language", "language_code").agg(F.count("*").alias("_n")))
    lang, code = F.col("language"), F.col("language_code")
    # a whole value that is a code, in or out of brackets
    code_map = F.broadcast(codes(languages))
    shown = F.when(blank(lang), clean_code(code)).otherwise(clean_code(lang))
    named = by_name(pairs.filter(~blank(lang)), languages)
    x = pairs.withColumn("_c", shown).join(code_map.withColumnRenamed("code", "_c").withColumnRenamed("iso_code", "_by_code"), "_c", "left")
    x = x.join(named, "language", "left")
    iso = F.when(blank(lang), F.col("_by_code")).otherwise(F.coalesce("_by_code", "iso_code"))
    x = x.withColumn("iso_code", F.coalesce(iso, F.lit(UNMATCHED))).withColumn("score", F.when(F.col("_by_code").isNotNull(), 1.0).otherwise(F.col("score")))
    exact = F.broadcast(languages.select(F.col("name").alias("language"), F.col("iso_code").alias("language_code"), F.lit(True).alias("exact")))
    x = x.select("language", "language_code", "iso_code", "score", "_n").join(exact, ["language", "language_code"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    x = written(x.withColumnsRenamed({"language": "_l", "language_code": "_k"}))
    # pairs of more than one row in HOT, at most so many, are met where the rows are; the others by a shuffle
    total = pairs.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(x.filter(F.col("_n") * HOT > total).drop("_n"))
    on = lang.eqNullSafe(F.col("_l")) & code.eqNullSafe(F.col("_k"))
    rest = entries.join(hot.select("_l", "_k"), on, "left_anti").join(x.filter(F.col("_n") * HOT <= total).drop("_n"), on)
    return entries.join(hot, on).unionByName(rest).drop("_l", "_k")


