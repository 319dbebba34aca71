"""Entity resolution of entries against a record store by edit distance and weighted features.

Candidates share the language and differ by at most K edits. They come from a lossless segment join: a record's form
is cut into K + 1 segments, one of which survives K edits within a shift of K, so entries and records meet by an
equi-join on (language, length, segment number, segment) and are verified after it. Pairs of distinct forms are
verified once and joined back to rows, so repeated forms weigh nothing. Blank forms have no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import date_proximity, edit_similarity, jaccard, word_set

K = 2
WEIGHTS = {"exact": 0.3, "fuzzy": 0.2, "semantic": 0.3, "date": 0.1, "source": 0.1}
ACTIONS = ((0.95, "auto_merge"), (0.85, "merge_with_flag"), (0.70, "flag_for_review"))


def form_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(lang, fa, fb, distance) of distinct forms of a and b, both (lang, form), at most K edits apart."""
    a = a.filter("form <> '' and lang is not null").select("lang", F.col("form").alias("fa")).distinct()
    b = b.filter("form <> '' and lang is not null").select("lang", F.col("form").alias("fb")).distinct()
    n = F.length("fb")
    # forms shorter than the number of segments have empty ones: they meet by length alone
    cut = F.expr(f"transform(sequence(0, {K}), i -> struct(i as seg, substr(fb, cast(floor(i * length(fb) / {K + 1}) as int) + 1, cast(floor((i + 1) * length(fb) / {K + 1}) as int) - cast(floor(i * length(fb) / {K + 1}) as int)) as part))")
    index = b.select("lang", "fb", n.alias("len"), F.explode(cut).alias("c")).select("lang", "fb", "len", "c.seg", "c.part")
    probes = a.select("lang", "fa", F.explode(F.sequence(F.greatest(F.lit(1), F.length("fa") - K), F.length("fa") + K)).alias("len"))
    window = F.expr(f"""flatten(transform(sequence(0, {K}), i -> transform(
        sequence(greatest(0, cast(floor(i * len / {K + 1}) as int) - {K}), cast(floor(i * len / {K + 1}) as int) + {K}),
        p -> struct(i as seg, substr(fa, p + 1, cast(floor((i + 1) * len / {K + 1}) as int) - cast(floor(i * len / {K + 1}) as int)) as part))))""")
    probes = probes.select("lang", "fa", "len", F.explode(F.array_distinct(window)).alias("c")).select("lang", "fa", "len", "c.seg", "c.part")
    x = probes.join(index, ["lang", "len", "seg", "part"]).select("lang", "fa", "fb").distinct()
    return x.withColumn("distance", F.levenshtein("fa", "fb", K)).filter("distance >= 0")


def _candidate_rows(entries: DataFrame, store: DataFrame, left: list[Column], right: list[Column]) -> DataFrame:
    """Rows of both sides with a common pair of forms, each with the given columns; forms are joined to rows once a side."""
    p = form_pairs(entries, store)
    x = entries.select(F.col("id").alias("entry_id"), "lang", F.col("form").alias("fa"), *left).join(p, ["lang", "fa"])
    return x.join(store.select(F.col("id").alias("lsr_id"), "lang", F.col("form").alias("fb"), *right), ["lang", "fb"])


def candidates(entries: DataFrame, store: DataFrame) -> DataFrame:
    """(entry_id, lsr_id, distance) of entries and store (id, lang, form)."""
    return _candidate_rows(entries, store, [], []).select("entry_id", "lsr_id", "distance")


def features(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates with exact, fuzzy, semantic, date, source and score.

    entries (id, lang, form, definition, year, source), store (id, lang, form, definition, date_start, date_end, sources).
    """
    left = [F.col("form").alias("ef"), F.col("definition").alias("ed"), F.col("year"), F.col("source")]
    right = [F.col("form").alias("rf"), F.col("definition").alias("rd"), F.col("date_start"), F.col("date_end"), F.col("sources")]
    x = _candidate_rows(entries, store, left, right)
    missing = F.col("ed").isNull() | F.col("rd").isNull() | (F.col("ed") == "") | (F.col("rd") == "")
    f = {
        "exact": (F.col("ef") == F.col("rf")).cast("double"), "fuzzy": edit_similarity(F.col("ef"), F.col("rf")),
        "semantic": F.when(missing, 0.5).otherwise(jaccard(word_set(F.col("ed")), word_set(F.col("rd")))),
        "date": date_proximity(F.col("year"), F.col("date_start"), F.col("date_end")), "source": F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False)).cast("double"),
    }
    x = x.withColumns(f)
    # the order of addition decides at a threshold
    score = sum((F.col(k) * w for k, w in list(WEIGHTS.items())[1:]), F.col("exact") * WEIGHTS["exact"])
    return x.select("entry_id", "lsr_id", "distance", *WEIGHTS, F.round(score, 9).alias("score"))


def resolution(entries: DataFrame, store: DataFrame) -> DataFrame:
    """(entry_id, action, lsr_id, score): the best candidate of each entry, the smallest id of equals; without one a new record."""
    w = Window.partitionBy("entry_id").orderBy(F.desc("score"), "lsr_id")
    best = features(entries, store).withColumn("r", F.row_number().over(w)).filter("r = 1")
    x = entries.select(F.col("id").alias("entry_id")).join(best, "entry_id", "left")
    action = F.lit("create_new")
    for least, name in reversed(ACTIONS):
        action = F.when(F.col("score") >= least, name).otherwise(action)
    x = x.withColumn("action", action)
    return x.select("entry_id", "action", F.when(F.col("action") != "create_new", F.col("lsr_id")).alias("lsr_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
