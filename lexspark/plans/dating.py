"""Queries of text dating over documents, with periods of words from dated quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import dating as D
from lexspark.schema import STOP_WORDS
from lexspark.session import written
from lexspark.sources.tables import dedup_deliveries, table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "lang", "year", "text")


def _periods(s: SparkSession, d: str) -> DataFrame:
    q = dedup_deliveries(table(s, d, "attestations", "id", "text_excerpt", "text_date"), "id")
    return D.word_periods(q.filter(D.in_english(F.col("text_excerpt"))).select(F.col("text_excerpt").alias("text"), F.col("text_date").alias("year")), "en")


def _written_periods(s: SparkSession, d: str) -> DataFrame:
    return written(_periods(s, d))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL_TOKENS = r"""
q as (select distinct on (id) id, text_excerpt as text, text_date as year from attestations),
qw as (select year, list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')), lambda x: lower(x)) as w from q where year is not null and text is not null),
qt as (select year, unnest(w) as form from qw where len(w) > 0 and len(list_filter(w, lambda x: x in (STOP))) >= 0.2 * len(w)),
lex as (select form, 'en' as lang, min(year) as date_start, max(year) as date_end from qt group by form),
dw as (select doc_id, lang, year, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')) as w from documents where text is not null),
tok as (select * from (select doc_id, lang, year, generate_subscripts(w, 1) - 1 as pos, lower(unnest(w)) as form from dw) where length(form) > 2 and form not in (STOP)),
hit as (select t.*, l.date_start, l.date_end from tok t left join lex l using (form, lang))
""".replace("STOP", _STOP)

QUERIES = {
    "word_periods": lambda s, d: _periods(s, d),
    "text_dating": lambda s, d: D.date_texts(_docs(s, d), _written_periods(s, d)),
    "dating_diagnostics": lambda s, d: D.diagnostics(_docs(s, d), _written_periods(s, d)),
    "anachronism_words": lambda s, d: D.anachronism_words(_docs(s, d), _written_periods(s, d)),
    "anachronism_verdicts": lambda s, d: D.verdicts(_docs(s, d), _written_periods(s, d)),
}
SQL = {
    "word_periods": f"with {SQL_TOKENS} select form, lang, date_start, date_end from lex",
    "text_dating": f"""with {SQL_TOKENS},
g as (select doc_id, count(*) as content, count(date_start) as matched, max(date_start) as s0, min(date_end) as e0, median(date_start) as ms, median(date_end) as me from hit group by doc_id),
g1 as (select *, case when s0 > e0 then cast(trunc(ms) as int) else s0 end as s1, case when s0 > e0 then cast(trunc(me) as int) else e0 end as e1 from g),
g2 as (select *, case when s1 > e1 then cast(floor((s1 + e1) / 2) as int) - 50 else s1 end as s2, case when s1 > e1 then cast(floor((s1 + e1) / 2) as int) + 50 else e1 end as e2 from g1),
a as (select g2.doc_id, count(*) as agree from g2 join hit h on h.doc_id = g2.doc_id and h.date_start <= floor((s2 + e2) / 2) and h.date_end >= floor((s2 + e2) / 2) group by 1)
select d.doc_id, case when matched > 0 then s2 else 0 end as date_start, case when matched > 0 then e2 else 0 end as date_end,
 case when matched > 0 then round(least(1.0, 0.5 * matched / content + 0.5 * coalesce(agree, 0) / matched), 3) else 0.0 end as confidence, coalesce(content, 0) as content, coalesce(matched, 0) as matched
from documents d left join g2 using (doc_id) left join a using (doc_id)""",
    "dating_diagnostics": f"""with {SQL_TOKENS},
v as (select doc_id, pos, form, greatest(0.0, 1 - (date_end - date_start) / 200) as value from hit where date_end - date_start < 200),
r as (select *, row_number() over (partition by doc_id order by value desc, pos) as rank from v)
select doc_id, rank, form, round(value, 6) as value from r where rank <= 20""",
    "anachronism_words": f"""with {SQL_TOKENS},
v as (select doc_id, pos, form, date_start - year as gap from hit where date_start > year),
r as (select *, row_number() over (partition by doc_id order by gap desc, pos) as rank from v)
select doc_id, rank, form, gap, case when gap > 100 then 'high' when gap > 50 then 'medium' else 'low' end as severity from r where rank <= 20""",
    "anachronism_verdicts": f"""with {SQL_TOKENS},
g as (select doc_id, count(*) as found, count(*) filter (date_start - year > 50) as suspicious from hit where date_start > year group by 1),
x as (select d.doc_id, coalesce(found, 0) as found, coalesce(suspicious, 0) as suspicious from documents d left join g using (doc_id) where d.year is not null)
select *, case when suspicious = 0 then 'consistent' when suspicious <= 2 then 'suspicious' else 'anachronistic' end as verdict,
 cast(case when found = 0 then 1.0 when suspicious = 0 then 0.9 when suspicious <= 2 then 0.6 else 0.3 end as double) as confidence from x""",
}
