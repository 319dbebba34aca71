"""Queries of relations, phonetics, intervals and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import phonetics as P
from lexspark.functions.text import normal_form
from lexspark.operators import relations as R
from lexspark.operators.references import clean_uuid
from lexspark.plans.resolve import BYTES, FORM, letters
from lexspark.sources.tables import dedup_deliveries, table


def sound_laws(s, d):
    m = table(s, d, "lsr_metadata", "id", "form_normalized")
    return m.select("id", P.sound_law(F.col("form_normalized")).alias("shifted"))


def range_join(s, d):
    """Pairs of a language's nouns and verbs in overlapping periods, by language."""
    m = table(s, d, "lsr_metadata", "id", "language_code", F.col("date_start").alias("s"), F.col("date_end").alias("e"), "part_of_speech")
    a, b = m.filter("array_contains(part_of_speech, 'adj')"), m.filter("array_contains(part_of_speech, 'verb')")
    return R.overlapping(a, b, ["language_code"]).groupBy("language_code").agg(F.count("*").alias("pairs"), F.count_distinct("a_id").alias("adjectives"))


def cognate_candidates(s, d):
    m = table(s, d, "lsr_metadata", "language_code", "definition_primary", "form_normalized").withColumn("form", normal_form(F.trim("form_normalized")))
    return R.cognate_candidates(m, table(s, d, "languages", F.col("iso_code").alias("language_code"), "family"), 0.2)


def attestation_contexts(s, d):
    a = dedup_deliveries(table(s, d, "attestations", "id", "lsr_id", "text_excerpt"), "id").withColumn("k", clean_uuid(F.col("lsr_id")))
    m = table(s, d, "lsr_metadata", F.col("id").alias("k"), "form_orthographic").filter("form_orthographic <> ''")
    return R.contexts(a.join(m, "k"), F.col("form_orthographic"), F.col("text_excerpt"))


def ingestion_stats(s, d):
    """Deliveries by source and status, and repeated ones."""
    i = table(s, d, "ingestion_records", "id", "source_name", "status")
    return i.groupBy("source_name", "status").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("records"))


QUERIES = {
    "sound_laws": sound_laws,
    "range_join": range_join,
    "cognate_candidates": cognate_candidates,
    "attestation_contexts": attestation_contexts,
    "ingestion_stats": ingestion_stats,
    "inherited_or_borrowed": lambda s, d: table(s, d, "raw_entries", "etymology").groupBy(R.inherited_or_borrowed(F.col("etymology")).alias("kind")).agg(F.count("*").alias("n")),
    "recent_changes": lambda s, d: R.recent_titles(table(s, d, "raw_entries", F.col("form").alias("title"), F.col("fetched_at").alias("at"))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")),
    "ocr_flags": lambda s, d: R.ocr_flags(table(s, d, "raw_entries", "entry_id", "raw_data")),
    "incremental_scan": lambda s, d: R.since(table(s, d, "raw_entries", "entry_id", "fetched_at"), "fetched_at", "2026-01-15 00:00:00").select("entry_id"),
}
_GRIMM = "form_normalized"
for _a, _b in P.GRIMM:
    _GRIMM = f"replace({_GRIMM}, '{_a}', '{_b}')"
SQL = {
    "sound_laws": f"select id, {_GRIMM} as shifted from lsr_metadata",
    "range_join": "with m as (select * from lsr_metadata where date_start is not null and date_end is not null and date_start <= date_end) select a.language_code, count(*) as pairs, count(distinct a.id) as adjectives from m a join m b on a.language_code = b.language_code and a.date_start <= b.date_end and b.date_start <= a.date_end where list_contains(a.part_of_speech, 'adj') and list_contains(b.part_of_speech, 'verb') group by 1",
    "cognate_candidates": f"""with x0 as (select language_code, family, definition_primary as lang, min({FORM('form_normalized')}) as form from lsr_metadata join languages on iso_code = language_code where definition_primary <> '' group by all), {letters('x0')},
x as (select language_code, family, lang, {BYTES} as f from x0 left join mp using (lang)),
y as (select a.lang as definition, a.language_code as a, b.language_code as b, round(1 - levenshtein(a.f, b.f) / greatest(length(a.f), length(b.f), 1)::double, 6) as similarity from x a join x b on a.family = b.family and a.lang = b.lang and a.language_code < b.language_code)
select * from y where similarity >= 0.2""",
    "attestation_contexts": r"""with a as (select distinct on (id) id, lower(regexp_replace(lsr_id, '^[\s\x{a0}{(]+|[\s\x{a0})}]+$', '', 'g')) as k, text_excerpt as t from attestations),
x as (select a.id, t, form_orthographic as f, strpos(t, form_orthographic) as i from a join lsr_metadata m on m.id = k where form_orthographic <> '')
select id, i as "at", substr(t, greatest(1, i - 20), length(f) + (i - greatest(1, i - 20)) + 20) as context from x where i > 0""",
    "ingestion_stats": "select source_name, status, count(*) as rows, count(distinct id) as records from ingestion_records group by all",
    "inherited_or_borrowed": "with x as (select lower(etymology) as e from raw_entries) select case when regexp_matches(e, 'borrow|loan') then 'borrowed' when regexp_matches(e, 'inherit|^of .* origin') then 'inherited' when regexp_matches(e, 'derivative|from the verb|^from ') then 'derived' else 'unknown' end as kind, count(*) as n from x group by 1",
    "recent_changes": "select form as title, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') as at from raw_entries where not contains(form, ':') group by 1",
    "ocr_flags": "with x as (select entry_id, cast(json_extract_string(raw_data, '$.ocr_confidence') as double) as confidence from raw_entries) select entry_id, confidence, case when confidence < 0.7 then 'reject' when confidence < 0.8 then 'review' when confidence < 0.9 then 'accept' else 'good' end as level from x where confidence is not null",
    "incremental_scan": "select entry_id from raw_entries where fetched_at > timestamp '2026-01-15 00:00:00'",
}
