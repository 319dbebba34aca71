"""Queries of the wikitext source over dictionary pages among the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.sources import wikitext as W
from lexspark.sources.tables import table


def pages(s, d):
    return table(s, d, "documents", F.col("doc_id").cast("string").alias("title"), F.col("text").alias("wikitext"))


def wikitext_entries(s, d):
    return W.entries(pages(s, d)).select("title", "source_id", "language", "language_code", "form_phonetic", F.array_join("definitions", "|").alias("definitions"), "date_attested")


def etymology_edges(s, d):
    """Borrowing and descent edges named in the etymologies of entries: phrases, not templates."""
    e = table(s, d, "raw_entries", "entry_id", "etymology")
    lang = r"((?:Old |Middle |Proto-)?[A-Z][a-z]+)"
    found = F.regexp_extract_all("etymology", F.lit(rf"(?:from|From|via|compare|cf\.) {lang} "), F.lit(1))
    names = F.broadcast(table(s, d, "languages", F.col("name").alias("donor")))
    return e.select("entry_id", F.explode(found).alias("donor")).join(names, "donor").groupBy("donor").agg(F.count("*").alias("n"), F.count_distinct("entry_id").alias("entries"))


QUERIES = {"wikitext_entries": wikitext_entries, "etymology_edges": etymology_edges, "wikitext_years": lambda s, d: pages(s, d).select("title", W.year_of(F.col("wikitext")).alias("year"))}
_Y = r"coalesce((nullif(regexp_extract({0}, '(\d{1,2})(?:st|nd|rd|th) century', 1), '')::int - 1) * 100 + 1, list_min(list_filter(list_transform(regexp_extract_all({0}, '\b(\d{4})\b', 1), lambda y: y::int), lambda y: y >= 800 and y <= 2100)))"
SQL = {
    "wikitext_years": "select doc_id::varchar as title, " + _Y.replace("{0}", "text") + " as year from documents",
    "etymology_edges": r"with x as (select entry_id, unnest(regexp_extract_all(etymology, '(?:from|From|via|compare|cf\.) ((?:Old |Middle |Proto-)?[A-Z][a-z]+) ', 1)) as donor from raw_entries) select donor, count(*) as n, count(distinct entry_id) as entries from x join languages on name = donor group by 1",
}
