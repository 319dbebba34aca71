"""Queries of the adapters, exports and reference data."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from lexspark.sources import adapters as A
from lexspark.sources.tables import table


def _files(d, name):
    path = f"{d}/{name}.parquet"
    return sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]


def adapter_scan(s, d):
    """Titles of the reference list by the paged adapter, slice by slice."""
    x = None
    for f in _files(d, "eval_items"):
        y = A.scan(s, f, column="text", batch_size=50)
        x = y if x is None else x.unionByName(y)
    return x.select(F.length("value").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


def cross_linguistic(s, d):
    m = table(s, d, "lsr_metadata", F.col("id").alias("ID"), F.col("language_code").alias("Language_ID"), F.md5("definition_primary").alias("Parameter_ID"), F.col("form_normalized").alias("Form"))
    langs = table(s, d, "languages", F.col("iso_code").alias("ID"), F.col("name").alias("Name"), F.col("iso_code").alias("ISO639P3code"))
    params = table(s, d, "lsr_metadata", F.md5("definition_primary").alias("ID"), F.col("definition_primary").alias("Name")).filter("ID is not null").distinct()
    return A.cross_linguistic(m, langs, params).withColumn("definitions", F.array_join("definitions", "|"))


_EXPORT = ("id", "form_orthographic", "language_code", "date_start", "reconstruction_flag")
QUERIES = {
    "adapter_scan": adapter_scan,
    "cross_linguistic_entries": cross_linguistic,
    "corpus_entries": lambda s, d: A.corpus_entries(table(s, d, "documents", "lang", "text", "year")),
    "reference_languages": lambda s, d: A.reference_languages(s, table(s, d, "languages", "iso_code", "name")),
    "csv_export": lambda s, d: A.csv_lines(table(s, d, "lsr_metadata", *_EXPORT)),
    "json_export": lambda s, d: A.json_lines(table(s, d, "lsr_metadata", "id", "form_orthographic", "language_code", "date_start")).select(*[F.get_json_object("line", f"$.{c}").alias(c) for c in ("id", "form_orthographic", "language_code", "date_start")]),
    "weekly_dump": lambda s, d: A.weekly(table(s, d, "raw_entries", "entry_id", "fetched_at"), "fetched_at"),
}
_CELL = lambda c: f"coalesce('\"' || replace({c}::varchar, '\"', '\"\"') || '\"', '')"
SQL = {
    "adapter_scan": "select length(text) as length, count(*) as n from eval_items where text is not null group by 1",
    "cross_linguistic_entries": "select 'cldf' as source_name, 'cldf-' || m.id as source_id, form_normalized as form, name as language, iso_code as language_code, coalesce(definition_primary, '') as definitions from lsr_metadata m left join languages on iso_code = language_code",
    "corpus_entries": r"with x as (select lang, year, unnest(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) as w from documents where year is not null), g as (select lang, lower(w) as form, min(year) as date_attested, count(*) as uses from x group by all having count(*) >= 2) select concat_ws('-', 'corpus', lang, form) as source_id, form, lang as language_code, date_attested, uses from g",
    "reference_languages": "with s as (select unnest(" + str([c for c, _ in A.SEED_LANGUAGES]) + ") as iso_code, unnest(" + str([n for _, n in A.SEED_LANGUAGES]) + ") as name) select iso_code, name from languages union all select iso_code, name from s where iso_code not in (select iso_code from languages)",
    "csv_export": "select " + " || ',' || ".join(_CELL(c) for c in _EXPORT) + " as line from lsr_metadata",
    "json_export": "select id, form_orthographic, language_code, date_start::varchar as date_start from lsr_metadata",
    "weekly_dump": "select strftime(date_trunc('week', fetched_at), '%Y-%m-%d') as week, count(*) as rows, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') as last from raw_entries where fetched_at is not null group by 1",
}
