"""Queries over lexical records and entries: scalar functions, search, sinks, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import records as R
from lexspark.operators.references import clean_uuid
from lexspark.schema import UNSAFE
from lexspark.sources.tables import dedup_deliveries, table

_M = lambda s, d: table(s, d, "lsr_metadata")
_E = lambda s, d: table(s, d, "raw_entries")


def year_labels(s, d):
    m = _M(s, d).select("id", "date_start", "date_end")
    y = F.col("date_start")
    r = T.label_range(T.century_label(y))
    return m.select("id", T.year_text(y).alias("label"), T.century_start(y).alias("century"), T.century_label(y).alias("century_label"), r["start"].alias("label_start"), r["end"].alias("label_end"), T.midpoint(y, F.col("date_end")).alias("middle"))


def overlap_ratio(s, d):
    n = table(s, d, "graph_nodes", "node_id", F.col("date_start").alias("b0"), F.col("date_end").alias("b1"))
    m = _M(s, d).select("id", "neo4j_id", "date_start", "date_end").join(n, F.col("neo4j_id") == F.col("node_id"))
    a = [F.col(c).cast("double") for c in ("date_start", "date_end", "b0", "b1")]
    touch = F.coalesce((F.col("date_start") <= F.col("b1")) & (F.col("b0") <= F.col("date_end")), F.lit(True))
    return m.select("id", F.round(T.overlap_ratio(*a), 6).alias("ratio"), touch.alias("overlap"))


def sanitize_fields(s, d):
    e = _E(s, d)
    safe = F.lit(True)
    for p in UNSAFE:
        safe = safe & ~F.coalesce(F.lower("etymology").rlike(p), F.lit(False))
    return e.select("entry_id", T.sanitized(F.col("etymology"), 200).alias("etymology"), T.identifier(F.col("source_id")).alias("source"), T.iso_code(F.col("language_code")).alias("code"), T.truncated(T.collapse(F.col("etymology")), 40).alias("short"), safe.alias("safe"), F.concat_ws(":", "source_name", "language", "form").alias("source_key"))


def parse_years(s, d):
    lit = F.split(F.col("page_reference"), ",")[0]
    a = table(s, d, "attestations", "page_reference").filter("page_reference is not null").select(lit.alias("t")).distinct()
    era = a.select(F.concat("t", F.lit(" BCE")).alias("t")).unionByName(a).unionByName(a.select(F.concat("t", F.lit(" ad")).alias("t"))).distinct()
    return era.select("t", T.parse_year(F.col("t")).alias("year"), T.strict_year(F.col("t")).alias("strict"))


def normal_forms(s, d):
    return _M(s, d).select("id", T.normal_form(F.col("form_orthographic")).alias("normal"), T.content_hash(F.col("form_orthographic")).alias("hash"))


def lsr_confidence(s, d):
    a = dedup_deliveries(table(s, d, "attestations", "id", "lsr_id", "text_date"), "id")
    return R.widened(_M(s, d), R.attestation_facts(a, clean_uuid(F.col("lsr_id"))))


def definition_jaccard(s, d):
    """Word overlap of each entry's first two definitions."""
    e = _E(s, d).filter("size(definitions) > 1")
    a, b = F.element_at("definitions", 1), F.element_at("definitions", 2)
    return e.select("entry_id", F.round(T.jaccard(T.word_set(a), T.word_set(b)), 6).alias("jaccard"))


def date_proximity(s, d):
    n = table(s, d, "graph_nodes", "node_id", F.col("date_start").alias("b0"))
    m = _M(s, d).join(n, F.col("neo4j_id") == F.col("node_id"))
    return m.select("id", F.round(T.date_proximity(F.col("b0"), F.col("date_start"), F.col("date_end")), 6).alias("proximity"))


QUERIES = {
    "year_labels": year_labels,
    "overlap_ratio": overlap_ratio,
    "sanitize_fields": sanitize_fields,
    "parse_years": parse_years,
    "normal_forms": normal_forms,
    "definition_jaccard": definition_jaccard,
    "date_proximity": date_proximity,
    "lsr_confidence": lsr_confidence,
    "record_search": lambda s, d: R.page(R.search(_M(s, d), form="ra", language="vrd", date_start=1500, date_end=1900), 20).select("id", "form_orthographic", "confidence_overall"),
    "record_overlap_search": lambda s, d: R.search(_M(s, d), date_start=900, date_end=1200, mode="overlap").select("id", "date_start", "date_end"),
    "search_counts": lambda s, d: R.search(_M(s, d), date_start=1500).groupBy("language_code").agg(F.count("*").alias("n")),
    "graph_node_sink": lambda s, d: R.graph_node(_M(s, d)),
    "search_document_sink": lambda s, d: R.search_document(_M(s, d)).select("id", *[F.get_json_object("document", f"$.{f}").alias(f) for f in ("form_orthographic", "language_code", "date_start", "definition_primary")]),
    "rdf_export": lambda s, d: R.n_triples(_M(s, d)),
    "lsr_merge": lambda s, d: R.merged(_M(s, d), ["language_code", "form_normalized"]),
    "entry_conversion": lambda s, d: R.from_entries(_E(s, d)),
    "content_hash_dedup": lambda s, d: R.deduplicated(_E(s, d)),
}
_UNSAFE = " or ".join("regexp_matches(lower(etymology), '" + p + "')" for p in UNSAFE)
_FLOOR = "cast(floor(date_start / 100) * 100 as int)"
_N = "(cast(floor(abs(date_start) / 100) as int) + 1)"
_CLEAN = r"regexp_replace(lsr_id, '^[\s\x{a0}{(]+|[\s\x{a0})}]+$', '', 'g')"
SQL = {
    "year_labels": f"""select id, case when date_start is null then 'unknown' when date_start < 0 then abs(date_start) || ' BCE' else date_start || '' end as label, {_FLOOR} as century,
 {_N} || case when date_start >= 0 then 'th century CE' else 'th century BCE' end as century_label,
 case when date_start is null then 0 when date_start >= 0 then ({_N} - 1) * 100 else -({_N} - 1) * 100 - 100 end as label_start, case when date_start is null then 100 when date_start >= 0 then {_N} * 100 else -({_N} - 1) * 100 end as label_end,
 cast(floor((date_start + case when date_end is null or date_end = 0 then date_start else date_end end) / 2) as int) as middle from lsr_metadata""",
    "overlap_ratio": """with x as (select m.id, m.date_start a0, m.date_end a1, n.date_start b0, n.date_end b1 from lsr_metadata m join graph_nodes n on m.neo4j_id = n.node_id),
y as (select *, greatest(least(a0, a1), least(b0, b1)) s, least(greatest(a0, a1), greatest(b0, b1)) e, least(abs(a1 - a0), abs(b1 - b0)) l from x)
select id, round(case when a0 is null or a1 is null or b0 is null or b1 is null then 0.5 when e < s then 0.0 when l = 0 then 1.0 else (e - s) / l end, 6) as ratio, coalesce(a0 <= b1 and b0 <= a1, true) as overlap from y""",
    "sanitize_fields": rf"""with x as (select *, trim(regexp_replace(etymology, '\s+', ' ', 'g')) as c from raw_entries)
select entry_id, substr(replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), 1, 200) as etymology,
 substr(lower(regexp_replace(source_id, '[^A-Za-z0-9_-]', '', 'g')), 1, 50) as source, substr(lower(regexp_replace(language_code, '[^A-Za-z-]', '', 'g')), 1, 10) as code,
 case when length(c) > 40 then substr(c, 1, 37) || '...' else c end as short, not coalesce({_UNSAFE}, false) as safe, concat_ws(':', source_name, language, form) as source_key from x""",
    "parse_years": r"""with a as (select distinct string_split(page_reference, ',')[1] as t from attestations where page_reference is not null), b as (select t from a union select t || ' BCE' from a union select t || ' ad' from a),
c as (select t, upper(trim(t)) as u, try_cast(nullif(regexp_extract(upper(trim(t)), '^(\d{1,9})', 1), '') as int) as n from b)
select t, case when regexp_matches(u, '^\d+\s*BCE?') then -n else n end as year, case when regexp_matches(u, '^\d+\s*BCE?') then -n when regexp_matches(u, '^\d+\s*(?:CE|AD)?$') then n end as strict from c""",
    "normal_forms": "select id, strip_accents(lower(form_orthographic)) as normal, sha256(form_orthographic) as hash from lsr_metadata",
    "definition_jaccard": r"""with x as (select entry_id, list_distinct(list_filter(string_split_regex(lower(trim(definitions[1])), '\s+'), lambda w: w <> '')) a, list_distinct(list_filter(string_split_regex(lower(trim(definitions[2])), '\s+'), lambda w: w <> '')) b from raw_entries where len(definitions) > 1)
select entry_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from x""",
    "date_proximity": """select id, round(case when n.date_start is null or n.date_start = 0 or m.date_start is null or m.date_start = 0 or m.date_end is null or m.date_end = 0 then 0.5
 when n.date_start between m.date_start and m.date_end then 1.0 else greatest(0.0, 1 - least(abs(n.date_start - m.date_start), abs(n.date_start - m.date_end)) / 100) end, 6) as proximity
 from lsr_metadata m join graph_nodes n on m.neo4j_id = n.node_id""",
    "lsr_confidence": f"""with a as (select distinct on (id) id, lower({_CLEAN}) as k, text_date from attestations), f as (select k, count(*) as n, min(text_date) as first, max(text_date) as last from a where k <> '' group by k),
x as (select m.*, coalesce(n, 0) as n, first, last, case when n > 0 then least(1.0, 0.1 * n + 0.5) else 0.3 end as att from lsr_metadata m left join f on m.id = f.k)
select id, least(date_start, first) as date_start, greatest(date_end, last) as date_end, n as attestations,
 round((coalesce(date_confidence, 0) + att + case when reconstruction_flag then 0.6 else 0 end + case when human_validated then 1.0 else 0 end) / (case when date_confidence is null then 0 else 1 end + 1 + case when reconstruction_flag then 1 else 0 end + case when human_validated then 1 else 0 end), 6) as confidence from x""",
    "record_search": """select id, form_orthographic, confidence_overall from lsr_metadata where (contains(form_normalized, 'ra') or contains(form_orthographic, 'ra')) and language_code = 'vrd' and (date_start is null or date_start >= 1500) and (date_end is null or date_end <= 1900)
 order by confidence_overall desc nulls first, form_orthographic, id limit 20""",
    "record_overlap_search": "select id, date_start, date_end from lsr_metadata where date_start is not null and date_end is not null and not (date_end < 900 or date_start > 1200)",
    "search_counts": "select language_code, count(*) as n from lsr_metadata where date_start is null or date_start >= 1500 group by 1",
    "graph_node_sink": "select id, form_orthographic as form, form_normalized, language_code, period_label, date_start, date_end, definition_primary as definition, confidence_overall as confidence, reconstruction_flag as reconstruction from lsr_metadata",
    "search_document_sink": "select id, form_orthographic, language_code, date_start::varchar as date_start, definition_primary from lsr_metadata",
    "rdf_export": """with x as (select id, unnest(['form_orthographic', 'language_code', 'definition_primary', 'date_start']) as p, unnest([form_orthographic, language_code, definition_primary, cast(date_start as varchar)]) as o from lsr_metadata)
select '<urn:lsr:' || id || '> <urn:lsr:' || p || '> "' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '" .' as line from x where o is not null""".replace("\\\\", "\\"),
    "lsr_merge": """with g as (select language_code, form_normalized, min(id) as id, min(date_start) as date_start, max(date_end) as date_end, arg_min(definition_primary, (created_at, id)) as d0, count(*) as version from lsr_metadata group by 1, 2),
f as (select language_code, form_normalized, first(definition_primary order by created_at, id) as definition, count(distinct definition_primary) as n, list(distinct definition_primary) as every from lsr_metadata group by 1, 2),
s as (select language_code, form_normalized, string_agg(distinct u, '|' order by u) as sources from (select language_code, form_normalized, unnest(source_databases) as u from lsr_metadata) group by 1, 2)
select g.language_code, g.form_normalized, g.id, g.date_start, g.date_end, coalesce(sources, '') as sources, f.definition, len(list_filter(every, lambda x: x is not null and x <> coalesce(f.definition, ''))) as alternates, version
 from g join f on g.language_code = f.language_code and g.form_normalized is not distinct from f.form_normalized left join s on g.language_code = s.language_code and g.form_normalized is not distinct from s.form_normalized""",
    "entry_conversion": """select entry_id, form as form_orthographic, strip_accents(lower(form)) as form_normalized, language_code, definitions[1] as definition_primary, greatest(coalesce(len(definitions), 0) - 1, 0) as alternates,
 nullif(date_attested, 0) as date_start, nullif(date_attested, 0) as date_end, source_name as source_database from raw_entries""",
    "content_hash_dedup": r"""with x as (select *, sha256(concat_ws(chr(31), form, language, etymology)) as content_hash from raw_entries)
select source_name, source_id, content_hash, arg_min(entry_id, (fetched_at, entry_id)) as entry_id, count(*) as deliveries from x group by 1, 2, 3""",
}
