"""Queries of validation, quality and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import corpus as C
from lexspark.operators import quality as Q
from lexspark.plans.dating import _STOP
from lexspark.functions.text import normal_form
from lexspark.plans.edges import EDGES
from lexspark.plans.records import _CLEAN
from lexspark.plans.resolve import BYTES, FORM, letters
from lexspark.operators.records import attestation_facts
from lexspark.operators.references import clean_uuid
from lexspark.sources.tables import dedup_deliveries, table

_M = lambda s, d: table(s, d, "lsr_metadata")
_D = lambda s, d: table(s, d, "documents", "doc_id", "lang", "year", "text")
# Concepts of the matrix.
CONCEPTS = ["barley", "basket", "bridge", "cloak", "horses", "ladle", "lantern", "salt", "spindle", "wool"]


def _verdicts(s, d):
    x = Q.record_issues(_M(s, d), table(s, d, "languages", "iso_code"))
    return x.withColumn("verdict", Q.verdict(F.col("critical"), F.col("warnings")))


def _strata(s, d):
    f = F.broadcast(table(s, d, "languages", F.col("iso_code").alias("language_code"), "family"))  # the fixed canonical list
    period = (F.floor(F.col("date_start") / 500) * 500).cast("int")
    return _M(s, d).join(f, "language_code", "left").select("id", "family", period.alias("period"))


def _density(s, d):
    a = dedup_deliveries(table(s, d, "attestations", "id", "lsr_id", "text_date"), "id")
    return Q.density(_M(s, d), attestation_facts(a, clean_uuid(F.col("lsr_id"))))


def _near(s, d):
    """Exact numbers of forms, and whether the sketch is within three times its error of them."""
    exact = _M(s, d).groupBy("language_code").agg(F.count_distinct("form_normalized").alias("forms"))
    got = C.approximate_forms(_M(s, d)).withColumnRenamed("forms", "sketch")
    return exact.join(got, "language_code").select("language_code", "forms", (F.abs(F.col("sketch") - F.col("forms")) <= 1 + 0.15 * F.col("forms")).alias("near"))


def _trees(s, d):
    """Two groupings of the languages as clades: by branch and by script inside a family."""
    x = table(s, d, "languages", "iso_code", "family", "script", F.try_element_at("branch_path", F.lit(1)).alias("branch"))
    t = lambda name, *by: x.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("iso_code")), ",").alias("clade")).select(F.lit(name).alias("tree"), "clade")
    return t("branch", "branch").unionByName(t("script", "family", "script")).unionByName(t("family", "family"))


def _aged(s, d):
    from lexspark.operators.edges import node
    from lexspark.plans.edges import edge_table

    n = table(s, d, "graph_nodes", "node_id", "language_code", "created_at", node(F.col("language_code"), F.col("form")).alias("node_word")).filter("node_word is not null")
    return Q.aged_orphans(n, edge_table(s, d), "2026-01-01 00:00:00", 30)


QUERIES = {
    "entry_issues": lambda s, d: Q.entry_issues(table(s, d, "raw_entries")).select("entry_id", F.array_join("issues", ",").alias("issues")).filter("issues <> ''"),
    "validation_verdicts": _verdicts,
    "validation_counts": lambda s, d: _verdicts(s, d).groupBy("verdict").agg(F.count("*").alias("n")),
    "quality_rollup": lambda s, d: Q.gauges(_M(s, d)),
    "date_outliers": lambda s, d: Q.outliers(_M(s, d)),
    "colexification": lambda s, d: Q.colexification(_M(s, d)),
    "validation_queue_order": lambda s, d: Q.queue(table(s, d, "validation_queue")),
    "calibrated_confidence": lambda s, d: _M(s, d).select("id", F.round(Q.calibrated(F.col("confidence_overall"), F.size("source_databases"), F.col("human_validated"), F.col("reconstruction_flag")), 6).alias("confidence")),
    "frequency_series": lambda s, d: C.frequency_series(_D(s, d)),
    "frequency_acceleration": lambda s, d: C.acceleration(C.frequency_series(_D(s, d))).drop("n"),
    "time_slices": lambda s, d: C.slices(_M(s, d)),
    "collocations": lambda s, d: C.collocations(_D(s, d)),
    "cognate_matrix": lambda s, d: C.cognate_matrix(_M(s, d), CONCEPTS),
    "language_distance": lambda s, d: C.language_distance(_M(s, d).withColumn("form_normalized", normal_form(F.trim("form_normalized")))),
    "stratified_split": lambda s, d: C.split(_strata(s, d), ["family", "period"]),
    "period_collocations": lambda s, d: C.period_collocations(_D(s, d)),
    "period_ranks": lambda s, d: C.ranks(_M(s, d)),
    "form_cube": lambda s, d: C.cube(_M(s, d)),
    "approximate_forms": lambda s, d: _near(s, d),
    "common_forms": lambda s, d: C.common_forms(table(s, d, "lsr_metadata", F.col("form_normalized").alias("form")).filter("form is not null"), table(s, d, "raw_entries", normal_form(F.trim("form")).alias("form")).filter("form is not null")),
    "tree_distances": lambda s, d: C.distances_by_clades(_trees(s, d)),
    "attestation_density": _density,
    "confidence_clusters": lambda s, d: Q.confidence_clusters(_M(s, d)),
    "load_stats": lambda s, d: Q.loads(table(s, d, "ingestion_records", "id", "source_name", "status")),
    "clamped_confidence": lambda s, d: _M(s, d).select("id", F.round(Q.clamped(F.col("confidence_overall"), F.size("source_databases") * 0.7), 6).alias("confidence")),
    "aged_orphans": _aged,
}
_TOK = rf"dw as (select doc_id, lang, year, list_filter(list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ({_STOP})) as w from documents where text is not null)"
_SER = f"{_TOK}, ft as (select lang, cast(floor(year / 50) * 50 as int) as bin, unnest(w) as form from dw where year is not null), fs as (select lang, form, bin, count(*) as n from ft group by all)"
_ISS = r"""x as (select m.*, l.iso_code as known from lsr_metadata m left join languages l on l.iso_code = m.language_code),
y as (select id, cast(coalesce(trim(form_orthographic) = '', true) as int) + cast(not coalesce(regexp_matches(lower(language_code), '^[a-z]{3}(-[a-z]{2,4})?$'), false) as int) + cast(not regexp_matches(id, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') as int)
 + cast(coalesce(date_start > date_end, false) as int) + cast(coalesce(date_start < -10000 or date_end > 2100, false) as int) + cast(coalesce(not confidence_overall between 0 and 1, false) as int) as critical,
 cast(known is null as int) + cast(definition_primary is null as int) + cast(date_start is null and date_end is null as int) as warnings from x),
z as (select *, case when critical > 0 then 'fail' when warnings > 0 then 'warn' else 'pass' end as verdict from y)"""
_B = "coalesce(cast(floor(least(confidence_overall, 0.999) * 5) as int), -1)"
SQL = {
    "entry_issues": "select entry_id, concat_ws(',', case when coalesce(trim(form, ' ') = '', true) then 'form' end, case when coalesce(trim(language, ' ') = '', true) then 'language' end, case when coalesce(len(definitions), 0) < 1 then 'definitions' end) as issues from raw_entries where issues <> ''",
    "validation_verdicts": f"with {_ISS} select id, critical, warnings, verdict from z",
    "validation_counts": f"with {_ISS} select verdict, count(*) as n from z group by 1",
    "quality_rollup": f"with x as (select language_code, {_B} as bucket, confidence_overall from lsr_metadata) select language_code, bucket, count(*) as n, round(avg(confidence_overall), 6) as mean, grouping(language_code, bucket) as level from x group by rollup (language_code, bucket)",
    "date_outliers": "with g as (select language_code, avg(date_start) as m, stddev_pop(date_start) as sd from lsr_metadata where date_start is not null group by 1), x as (select id, l.language_code, round((date_start - m) / nullif(sd, 0), 6) as z from lsr_metadata l join g using (language_code)) select id, language_code, z from x where abs(z) > 2",
    "colexification": "select language_code, form_normalized, count(distinct definition_primary) as senses from lsr_metadata where definition_primary is not null group by all having senses > 1",
    "validation_queue_order": "with x as (select distinct on (id) id, assigned_to, priority, created_at from validation_queue where lower(trim(status, ' ')) = 'pending') select id, assigned_to, priority, row_number() over (partition by assigned_to order by priority desc nulls last, created_at nulls first, id) as place from x",
    "calibrated_confidence": "select id, round(greatest(0.0, least(1.0, confidence_overall + case when len(source_databases) > 1 then 0.1 else 0 end + case when human_validated then 0.2 else 0 end - case when reconstruction_flag then 0.2 else 0 end)), 6) as confidence from lsr_metadata",
    "frequency_series": f"with {_SER} select * from fs",
    "frequency_acceleration": f"with {_SER}, a as (select lang, form, bin, n - 2 * lag(n, 1) over w + lag(n, 2) over w as acceleration from fs window w as (partition by lang, form order by bin)) select * from a where acceleration is not null",
    "time_slices": "with x as (select unnest(generate_series(cast(floor((date_start - 50) / 40) as int) + 1, cast(floor(date_end / 40) as int))) as k from lsr_metadata where date_start is not null and date_end is not null and date_end >= date_start) select cast(k * 40 as int) as slice, count(*) as n from x group by 1",
    "collocations": f"""with {_TOK}, t as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from dw), c as (select t, count(*) as c from t group by 1),
p as (select least(x.t, y.t) as a, greatest(x.t, y.t) as b, count(*) as n from t x join t y on x.doc_id = y.doc_id and y.i - x.i in (1, 2) where x.t <> y.t group by all having count(*) >= 5)
select a, b, n, round(log2(n * (select sum(c)::double from c) / (ca.c * cb.c)), 6) as pmi from p join c ca on ca.t = a join c cb on cb.t = b""",
    "cognate_matrix": "select language_code, " + ", ".join(f"max(case when list_contains(string_split_regex(lower(definition_primary), '[^a-z]+'), '{c}') then 1 else 0 end) as \"{c}\"" for c in CONCEPTS) + " from lsr_metadata group by 1",
    "language_distance": f"""with x0 as (select language_code, definition_primary as lang, min({FORM('form_normalized')}) as form from lsr_metadata where definition_primary is not null group by all), {letters('x0')},
x as (select language_code, lang, {BYTES} as f from x0 left join mp using (lang))
select a.language_code as a, b.language_code as b, count(*) as n, round(1 - avg(1 - levenshtein(a.f, b.f) / greatest(length(a.f), length(b.f), 1)::double), 6) as distance from x a join x b on a.lang = b.lang and a.language_code < b.language_code group by all""",
    "stratified_split": "with x as (select m.id, family, cast(floor(date_start / 500) * 500 as int) as period, md5(m.id) as h from lsr_metadata m left join languages on iso_code = m.language_code), y as (select id, family, period, (row_number() over (partition by family, period order by h, id) - 1) / count(*) over (partition by family, period) as s from x) select id, family, period, case when s < 0.8 then 'train' when s < 0.9 then 'validation' else 'test' end as part from y",
    "period_collocations": f"""with {_TOK}, t as (select doc_id, cast(floor(year / 250) * 250 as int) as period, unnest(w) as t, generate_subscripts(w, 1) as i from dw where year is not null)
select x.period, least(x.t, y.t) as a, greatest(x.t, y.t) as b, count(*) as n from t x join t y on x.doc_id = y.doc_id and y.i - x.i in (1, 2) where x.t <> y.t group by all having count(*) >= 5""",
    "period_ranks": "select id, language_code, dense_rank() over (partition by language_code order by date_start) as dense, ntile(4) over (partition by language_code order by date_start, id) as quarter, round(percent_rank() over (partition by language_code order by date_start), 6) as percent from lsr_metadata where date_start is not null",
    "form_cube": "with x as (select language_code, unnest(case when len(part_of_speech) > 0 then part_of_speech else [null] end) as pos, form_normalized, confidence_overall from lsr_metadata) select language_code, pos, count(*) as n, count(distinct form_normalized) as forms, round(sum(confidence_overall), 6) as total, grouping(language_code, pos) as level from x group by cube (language_code, pos)",
    "approximate_forms": "select language_code, count(distinct form_normalized) as forms, true as near from lsr_metadata where language_code is not null group by 1",
    "common_forms": f"with a as (select distinct form_normalized as form from lsr_metadata where form_normalized is not null), b as (select distinct {FORM('form')} as form from raw_entries where form is not null) select coalesce(a.form, b.form) as form, case when a.form is null then 'second' when b.form is null then 'first' else 'both' end as where from a full join b on a.form = b.form",
    "tree_distances": "with x as (select iso_code, family, script, branch_path[1] as branch from languages), t as (select distinct 'branch' as tree, string_agg(iso_code, ',' order by iso_code) as clade from x group by branch union select 'script', string_agg(iso_code, ',' order by iso_code) from x group by family, script union select 'family', string_agg(iso_code, ',' order by iso_code) from x group by family), n as (select tree, count(*) as n from t group by 1), k as (select a.tree as a, b.tree as b, count(*) as k from t a join t b on a.clade = b.clade and a.tree < b.tree group by all) select a, b, na.n + nb.n - 2 * k as distance from k join n na on na.tree = a join n nb on nb.tree = b",
    "attestation_density": f"with a as (select distinct on (id) id, lower({_CLEAN}) as k from attestations), f as (select k, count(*) as n from a where k <> '' group by k) select language_code, period_label, count(*) as records, coalesce(sum(n), 0)::bigint as attestations, round(coalesce(sum(n), 0) / count(*), 6) as density from lsr_metadata left join f on k = id group by all",
    "confidence_clusters": "with g as (select language_code, period_label, count(*) as n, avg(confidence_overall) as mean from lsr_metadata where confidence_overall is not null group by all), m as (select avg(mean) as m, stddev_pop(mean) as sd from g) select language_code, period_label, n, round(mean, 6) as mean, round((mean - m) / nullif(sd, 0), 6) as z from g, m where abs(round((mean - m) / nullif(sd, 0), 6)) > 1",
    "load_stats": "with x as (select distinct on (id) source_name, lower(trim(status, ' ')) as st from ingestion_records) select source_name, count(*) as processed, count(*) filter (st in ('processed', 'success', 'succeeded', 'done', 'ok')) as succeeded, count(*) filter (st in ('failed', 'error')) as failed, count(*) filter (st = 'skipped') as skipped, round(count(*) filter (st in ('processed', 'success', 'succeeded', 'done', 'ok')) / count(*), 6) as rate from x group by 1",
    "clamped_confidence": "select id, round(greatest(0.0, least(1.0, confidence_overall * (len(source_databases) * 0.7))), 6) as confidence from lsr_metadata",
    "aged_orphans": f"with {EDGES} select node_id, language_code from graph_nodes where form <> '' and created_at < timestamp '2026-01-01 00:00:00' - interval 30 days and coalesce(language_code, 'unknown') || ':' || form not in (select id from ids)",
}
