"""Queries of entity resolution: raw entries against lexical records.

The engine that checks the SQL counts edits in bytes. There the letters of each language are numbered and every letter
becomes the byte of its number, one to one: both sides then count code points. More letters than bytes is an error.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions.text import normal_form
from lexspark.operators import resolve as R
from lexspark.sources.tables import table


def entries(s, d):
    """The language is the code, or else the beginning of the language's name."""
    e = table(s, d, "raw_entries", "entry_id", "form", "language", "language_code", "definitions", "date_attested", "source_name")
    lang = F.coalesce(F.nullif(F.lower(F.trim("language_code")), F.lit("")), F.lower(F.left("language", F.lit(3))))
    return e.select(F.col("entry_id").alias("id"), lang.alias("lang"), normal_form(F.trim("form")).alias("form"), F.try_element_at("definitions", F.lit(1)).alias("definition"), F.col("date_attested").alias("year"), F.lower("source_name").alias("source"))


def store(s, d):
    m = table(s, d, "lsr_metadata", "id", "form_orthographic", "language_code", "definition_primary", "date_start", "date_end", "source_databases")
    return m.select("id", F.col("language_code").alias("lang"), normal_form(F.trim("form_orthographic")).alias("form"), F.col("definition_primary").alias("definition"), "date_start", "date_end", F.transform("source_databases", F.lower).alias("sources"))


FORM = lambda c: f"strip_accents(lower(trim({c}, ' ')))"


def letters(*tables: str) -> str:
    """CTEs ch and mp: by lang, the letters src of the tables' column form and the bytes dst that stand for them."""
    every = " union all ".join(f"select lang, unnest(regexp_extract_all(form, '(?s).')) as c from {t}" for t in tables)
    return f"""ch as (select lang, c, row_number() over (partition by lang order by c) as i from (select distinct lang, c from ({every}))),
mp as (select lang, string_agg(c, '' order by c) as src, string_agg(chr(cast(i as int)), '' order by c) as dst, max(i) as n from ch group by lang)"""


BYTES = "case when n > 127 then error('more letters than bytes') when form is null or form = '' then form else translate(form, src, dst) end"
_CTE = f"""e0 as (select entry_id, coalesce(nullif(lower(trim(language_code, ' ')), ''), lower(left(language, 3))) as lang, {FORM('form')} as form, definitions[1] as definition, date_attested as year, lower(source_name) as source from raw_entries),
r0 as (select id as lsr_id, language_code as lang, {FORM('form_orthographic')} as form, definition_primary as definition, date_start, date_end, list_transform(source_databases, lambda x: lower(x)) as sources from lsr_metadata),
{letters('(select * from e0 where lang in (select lang from r0))', 'r0')},
e as (select entry_id, e0.lang, {BYTES} as form, definition, year, source from e0 left join mp using (lang)),
r as (select lsr_id, r0.lang, {BYTES} as form, definition, date_start, date_end, sources from r0 left join mp using (lang)),
c as (select entry_id, lsr_id, e.lang, e.form as ef, r.form as rf, levenshtein(e.form, r.form) as distance, e.definition as ed, r.definition as rd, year, source, date_start, date_end, sources from e join r on e.lang = r.lang and abs(length(e.form) - length(r.form)) <= 2 where e.form <> '' and r.form <> '' and levenshtein(e.form, r.form) <= 2),
w as (select *, list_distinct(list_filter(string_split_regex(lower(trim(ed)), '\\s+'), lambda x: x <> '')) as wa, list_distinct(list_filter(string_split_regex(lower(trim(rd)), '\\s+'), lambda x: x <> '')) as wb from c),
f as (select entry_id, lsr_id, distance, cast(ef = rf as int)::double as exact, 1 - distance / greatest(length(ef), length(rf), 1)::double as fuzzy,
 case when ed is null or rd is null or ed = '' or rd = '' then 0.5::double when len(list_distinct(list_concat(wa, wb))) = 0 then 0 else len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) end as semantic,
 case when year is null or year = 0 or date_start is null or date_start = 0 or date_end is null or date_end = 0 then 0.5::double when year between date_start and date_end then 1.0 else greatest(0.0, 1 - least(abs(year - date_start), abs(year - date_end)) / 100) end as date,
 cast(coalesce(list_contains(sources, source), false) as int)::double as source from w),
s as (select *, round(exact * 0.3::double + fuzzy * 0.2::double + semantic * 0.3::double + date * 0.1::double + source * 0.1::double, 9) as score from f)"""
_BEST = "b as (select *, row_number() over (partition by entry_id order by score desc, lsr_id) as k from s), x as (select e.entry_id, lsr_id, coalesce(score, 0) as score, case when score >= 0.95 then 'auto_merge' when score >= 0.85 then 'merge_with_flag' when score >= 0.7 then 'flag_for_review' else 'create_new' end as action from e left join (select * from b where k = 1) b using (entry_id))"
QUERIES = {
    "er_candidates": lambda s, d: R.candidates(entries(s, d), store(s, d)),
    "er_features": lambda s, d: R.features(entries(s, d), store(s, d)).select("entry_id", "lsr_id", "distance", *[F.round(k, 6).alias(k) for k in (*R.WEIGHTS, "score")]),
    "er_resolution": lambda s, d: R.resolution(entries(s, d), store(s, d)).withColumn("score", F.round("score", 6)),
    "er_action_counts": lambda s, d: R.resolution(entries(s, d), store(s, d)).groupBy("action").agg(F.count("*").alias("n")),
}
SQL = {
    "er_candidates": f"with {_CTE} select entry_id, lsr_id, distance from c",
    "er_features": f"with {_CTE} select entry_id, lsr_id, distance, round(exact, 6) as exact, round(fuzzy, 6) as fuzzy, round(semantic, 6) as semantic, round(date, 6) as date, round(source, 6) as source, round(score, 6) as score from s",
    "er_resolution": f"with {_CTE}, {_BEST} select entry_id, action, case when action <> 'create_new' then lsr_id end as lsr_id, round(score, 6) as score from x",
    "er_action_counts": f"with {_CTE}, {_BEST} select action, count(*) as n from x group by 1",
}
