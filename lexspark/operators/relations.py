"""Candidate relations between records, interval joins, attestation contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import edit_similarity

#: Width of the buckets of an interval join.
BUCKET = 100


def overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a and b, both (on..., id, s, e), whose closed periods overlap: (on..., a_id, b_id).

    Periods meet in every century that both touch; the pair is kept in the later of their first centuries only, so
    nothing is found twice and no distinct is needed. Open or reversed periods overlap nothing.
    """
    def cut(x: DataFrame, p: str) -> DataFrame:
        x = x.filter("s is not null and e is not null and s <= e")
        first, last = F.floor(F.col("s") / BUCKET), F.floor(F.col("e") / BUCKET)
        return x.select(*on, F.col("id").alias(f"{p}_id"), F.col("s").alias(f"{p}_s"), F.col("e").alias(f"{p}_e"), F.explode(F.sequence(first, last)).alias("bucket"))

    x = cut(a, "a").join(cut(b, "b"), [*on, "bucket"])
    x = x.filter((F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")) & (F.col("bucket") == F.floor(F.greatest("a_s", "b_s") / BUCKET)))
    return x.select(*on, "a_id", "b_id")


def cognate_candidates(lsr: DataFrame, families: DataFrame, least: float = 0.5) -> DataFrame:
    """(definition, a, b, similarity): languages of one family whose first forms for a definition are alike.

    Forms are reduced to one per language and definition, so a pair of languages meets once a definition.
    """
    x = lsr.filter("definition_primary <> ''").groupBy("language_code", "definition_primary").agg(F.min("form").alias("form"))
    x = x.join(F.broadcast(families), "language_code")  # the fixed canonical list
    a = x.select("family", "definition_primary", F.col("language_code").alias("a"), F.col("form").alias("fa"))
    b = x.select("family", "definition_primary", F.col("language_code").alias("b"), F.col("form").alias("fb"))
    y = a.join(b, ["family", "definition_primary"]).filter("a < b").withColumn("similarity", F.round(edit_similarity(F.col("fa"), F.col("fb")), 6))
    return y.filter(F.col("similarity") >= least).select(F.col("definition_primary").alias("definition"), "a", "b", "similarity")


def inherited_or_borrowed(etymology: Column) -> Column:
    """What an etymology says: borrowed, inherited, derived or unknown."""
    x = F.lower(etymology)
    return F.when(x.rlike("borrow|loan"), "borrowed").when(x.rlike("inherit|^of .* origin"), "inherited").when(x.rlike("derivative|from the verb|^from "), "derived").otherwise("unknown")


def contexts(quotations: DataFrame, form: Column, text: Column, width: int = 20) -> DataFrame:
    """The first place of each quotation's form with `width` characters on both sides: (id, at, context)."""
    x = quotations.withColumn("at", F.position(form, text)).filter("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - width)
    return x.select("id", "at", F.substring(text, start, F.length(form) + (F.col("at") - start) + width).alias("context"))


def recent_titles(changes: DataFrame) -> DataFrame:
    """Changed titles once each, with the last time; titles of other name spaces (with a colon) dropped."""
    return changes.filter(~F.contains(F.col("title"), F.lit(":"))).groupBy("title").agg(F.max("at").alias("at"))


def ocr_flags(entries: DataFrame) -> DataFrame:
    """(entry_id, confidence, level) by the recognition confidence in raw_data; entries without one are left out."""
    c = F.get_json_object("raw_data", "$.ocr_confidence").cast("double")
    level = F.when(c < 0.7, "reject").when(c < 0.8, "review").when(c < 0.9, "accept").otherwise("good")
    return entries.select("entry_id", c.alias("confidence"), level.alias("level")).filter("confidence is not null")


def since(df: DataFrame, column: str, at: str) -> DataFrame:
    """Incremental scan: the filter reaches the Parquet scan."""
    return df.filter(F.col(column) > F.lit(at).cast("timestamp_ntz"))


def read_only_sql(query: str) -> str:
    """The query if it is one SELECT or WITH statement; raises otherwise."""
    import re

    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.DOTALL).strip().rstrip(";").rstrip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if not re.match(r"(?i)(select|with)\b", bare) or ";" in bare or re.search(r"(?i)\b(insert|update|delete|drop|create|alter|merge|truncate|set)\b", bare):
        raise ValueError("only a single SELECT or WITH query is allowed")
    return text
