"""Text dating, diagnostic words and anachronisms.

Tokens are ASCII words, per occurrence. The word periods have one row per (form, language) with its first and last year.
Texts that are null or have no content words date to (0, 0) with confidence 0. Null languages match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import ascii_words
from lexspark.schema import STOP_WORDS
from lexspark.session import bounded_broadcast

#: A word dates a text if its own period is shorter than this.
DIAGNOSTIC_SPAN = 200
TOP = 20
#: Half-width of the period when even the medians contradict each other.
FALLBACK = 50


def word_periods(quotations: DataFrame, language: str) -> DataFrame:
    """(form, lang, date_start, date_end) of the words of dated quotations (text, year)."""
    x = quotations.filter("year is not null and text is not null").select("year", F.explode(F.array_distinct(ascii_words(F.col("text")))).alias("form"))
    return x.groupBy("form").agg(F.min("year").alias("date_start"), F.max("year").alias("date_end")).withColumn("lang", F.lit(language))


#: A quotation is English from this share of English stop words among its words on.
ENGLISH_SHARE = 0.2


def in_english(text: Column) -> Column:
    """Whether a text seems to be English by its stop words; null and wordless texts aren't."""
    w = ascii_words(text)
    return F.coalesce((F.size(w) > 0) & (F.size(F.filter(w, lambda t: t.isin(*STOP_WORDS))) >= ENGLISH_SHARE * F.size(w)), F.lit(False))


def content_tokens(docs: DataFrame) -> DataFrame:
    """(doc columns but text, pos, form): words longer than two letters that aren't stop words, lazily exploded."""
    x = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(ascii_words(F.col("text"))).alias("pos", "form"))
    return x.filter((F.length("form") > 2) & ~F.col("form").isin(*STOP_WORDS))


def date_texts(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, date_start, date_end, confidence, content, matched) of docs (doc_id, lang, text).

    Words are counted per document before they meet the word periods, and periods per document before the medians:
    nothing grows with the number of uses. Word periods are broadcast below a counted bound.
    """
    words = content_tokens(docs.select("doc_id", "lang", "text")).groupBy("doc_id", "lang", "form").agg(F.count("*").alias("k"))
    tok = words.join(bounded_broadcast(lex), ["form", "lang"], "left")
    hit = F.col("date_start").isNotNull() & F.col("date_end").isNotNull()
    weight = F.when(hit, F.col("k"))
    g = tok.groupBy("doc_id").agg(
        F.sum("k").alias("content"), F.coalesce(F.sum(weight), F.lit(0)).alias("matched"), F.max("date_start").alias("s0"), F.min("date_end").alias("e0"),
        F.percentile("date_start", 0.5, F.coalesce(weight, F.lit(0))).alias("ms"), F.percentile("date_end", 0.5, F.coalesce(weight, F.lit(0))).alias("me"), F.collect_list(F.when(hit, F.struct("date_start", "date_end", "k"))).alias("spans"),
    )
    s1, e1 = F.when(F.col("s0") > F.col("e0"), F.col("ms").cast("int")).otherwise(F.col("s0")), F.when(F.col("s0") > F.col("e0"), F.col("me").cast("int")).otherwise(F.col("e0"))
    g = g.withColumns({"s1": s1, "e1": e1}).withColumn("mid", F.floor((F.col("s1") + F.col("e1")) / 2))
    s2, e2 = F.when(F.col("s1") > F.col("e1"), F.col("mid") - FALLBACK).otherwise(F.col("s1")), F.when(F.col("s1") > F.col("e1"), F.col("mid") + FALLBACK).otherwise(F.col("e1"))
    g = g.withColumns({"date_start": s2.cast("int"), "date_end": e2.cast("int")})
    mid = F.floor((F.col("date_start") + F.col("date_end")) / 2)
    agree = F.aggregate(F.filter("spans", lambda x: (x["date_start"] <= mid) & (x["date_end"] >= mid)), F.lit(0).cast("bigint"), lambda n, x: n + x["k"]) / F.nullif(F.col("matched"), F.lit(0))
    g = g.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 * F.col("matched") / F.col("content") + 0.5 * agree), 3))
    out = docs.select("doc_id").join(g, "doc_id", "left")
    z = lambda c: F.coalesce(F.when(F.col("matched") > 0, F.col(c)), F.lit(0))
    return out.select("doc_id", z("date_start").alias("date_start"), z("date_end").alias("date_end"), F.coalesce(F.when(F.col("matched") > 0, F.col("confidence")), F.lit(0.0)).alias("confidence"), F.coalesce("content", F.lit(0)).alias("content"), F.coalesce("matched", F.lit(0)).alias("matched"))


def _top(x: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(by), "pos")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP)


def diagnostics(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """The most telling words of each text: (doc_id, rank, form, value); repeats stay, ties by position."""
    tok = content_tokens(docs.select("doc_id", "lang", "text")).join(bounded_broadcast(lex), ["form", "lang"])
    span = F.col("date_end") - F.col("date_start")
    x = tok.filter(span < DIAGNOSTIC_SPAN).withColumn("value", F.greatest(F.lit(0.0), 1 - span / DIAGNOSTIC_SPAN))
    return _top(x, "value").select("doc_id", "rank", "form", F.round("value", 6).alias("value"))


def anachronisms(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """Words first attested after the claimed year: (doc_id, pos, form, gap, severity), every occurrence."""
    tok = content_tokens(docs.filter("year is not null").select("doc_id", "lang", "year", "text")).join(bounded_broadcast(lex), ["form", "lang"])
    x = tok.withColumn("gap", F.col("date_start") - F.col("year")).filter("gap > 0")
    severity = F.when(F.col("gap") > 100, "high").when(F.col("gap") > 50, "medium").otherwise("low")
    return x.select("doc_id", "pos", "form", "gap", severity.alias("severity"))


def anachronism_words(docs: DataFrame, lex: DataFrame) -> DataFrame:
    return _top(anachronisms(docs, lex), "gap").select("doc_id", "rank", "form", "gap", "severity")


def verdicts(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, found, suspicious, verdict, confidence) of every text with a claimed year."""
    g = anachronisms(docs, lex).groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if(F.col("severity") != "low").alias("suspicious"))
    x = docs.filter("year is not null").select("doc_id").join(g, "doc_id", "left").na.fill(0, ["found", "suspicious"])
    s, f = F.col("suspicious"), F.col("found")
    verdict = F.when(s == 0, "consistent").when(s <= 2, "suspicious").otherwise("anachronistic")
    confidence = F.when(f == 0, 1.0).when(s == 0, 0.9).when(s <= 2, 0.6).otherwise(0.3)
    return x.select("doc_id", "found", "suspicious", verdict.alias("verdict"), confidence.alias("confidence"))
