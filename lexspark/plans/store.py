"""Queries of record keeping and of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import store as K
from lexspark.operators.references import clean_uuid
from lexspark.plans.quality import _ISS, _verdicts
from lexspark.plans.records import _CLEAN
from lexspark.sources.tables import dedup_deliveries, table

_KEY = ["language_code", "form_normalized"]
_M = lambda s, d, *c: table(s, d, "lsr_metadata", "id", *c)


def _changes(s, d):
    return table(s, d, "graph_nodes", F.col("node_id").alias("neo4j_id"), F.col("confidence").alias("confidence_overall"), "period_label")


def record_update(s, d):
    """Records with what their graph nodes know: confidence and period."""
    m = _M(s, d, "neo4j_id", "confidence_overall", "period_label").withColumn("version", F.lit(1))
    c = m.select("id", "neo4j_id").join(_changes(s, d), "neo4j_id").drop("neo4j_id")
    return K.updated(m.drop("neo4j_id"), c, "confidence_overall", "period_label")


def record_versions(s, d):
    """All versions after that update, reduced to the latest of each id."""
    m = _M(s, d, "confidence_overall", "period_label").withColumn("version", F.lit(1))
    return K.current(m.unionByName(record_update(s, d).filter("version > 1")))


def record_create(s, d):
    """Records and those that graph nodes without one would make."""
    n = table(s, d, "graph_nodes", F.col("node_id").alias("id"), F.col("form").alias("form_orthographic"), "language_code")
    return K.created(_M(s, d, "form_orthographic", "language_code").withColumn("version", F.lit(1)), n)


def record_lookup(s, d):
    q = dedup_deliveries(table(s, d, "validation_queue", F.col("id").alias("queue_id"), "lsr_id"), "queue_id")
    return K.lookup(_M(s, d, "form_orthographic"), q.select("queue_id", clean_uuid(F.col("lsr_id")).alias("id")), "form_orthographic")


def record_delete(s, d):
    log = table(s, d, "audit_logs").filter("entity_type = 'lsr'").withColumn("entity_id", F.lower("entity_id"))
    return K.deleted(_M(s, d, "language_code"), log)


def merge_attestations(s, d):
    a = dedup_deliveries(table(s, d, "attestations", "id", "lsr_id", "text_date"), "id").filter("id is not null").withColumn("lsr_id", clean_uuid(F.col("lsr_id")))
    return K.merged_attestations(_M(s, d, *_KEY), a, _KEY)


def create_requests(s, d):
    e = table(s, d, "raw_entries", F.col("entry_id").alias("id"), "form", "language_code", F.try_element_at("definitions", F.lit(1)).alias("definition"), F.col("date_attested").alias("date_start"), F.col("date_attested").alias("date_end"))
    return K.create_requests(e)


def denied_queries(s, d):
    return table(s, d, "raw_entries", "entry_id", "etymology").filter(K.denied(F.col("etymology"))).select("entry_id")


QUERIES = {
    "record_update": record_update, "record_versions": record_versions, "record_create": record_create, "record_lookup": record_lookup, "record_delete": record_delete, "merge_attestations": merge_attestations,
    "merge_log": lambda s, d: K.merge_log(_M(s, d, *_KEY), _KEY), "merge_alternates": lambda s, d: K.alternates(_M(s, d, "definition_primary", *_KEY), _KEY), "create_requests": create_requests,
    "text_requests": lambda s, d: K.text_requests(table(s, d, "documents", F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.col("year").alias("claimed"))), "denied_queries": denied_queries,
    "result_pages": lambda s, d: K.pages(_M(s, d, "language_code").groupBy("language_code").agg(F.count("*").alias("n"))), "verdict_routes": lambda s, d: K.routed(_verdicts(s, d)),
}
_UP = """u as (select m.id, coalesce(n.confidence, m.confidence_overall) as confidence_overall, coalesce(n.period_label, m.period_label) as period_label,
 1 + cast(coalesce(n.confidence is not null and n.confidence is distinct from m.confidence_overall, false) or coalesce(n.period_label is not null and n.period_label is distinct from m.period_label, false) as int) as version from lsr_metadata m left join graph_nodes n on n.node_id = m.neo4j_id)"""
_SURV = "sv as (select id, min(id) over (partition by language_code, form_normalized) as survivor, definition_primary from lsr_metadata)"
SQL = {
    "record_update": f"with {_UP} select * from u",
    "record_versions": f"with {_UP} select * from u",
    "record_create": "select id, form_orthographic, language_code, 1 as version from lsr_metadata union all select node_id, form, language_code, 1 from graph_nodes where node_id is not null and node_id not in (select id from lsr_metadata)",
    "record_lookup": f"with d as (select distinct on (id) id, lsr_id from validation_queue), q as (select id as queue_id, nullif(lower({_CLEAN}), '') as id from d) select q.queue_id, q.id, form_orthographic, m.id is not null as found from q left join lsr_metadata m on m.id = q.id",
    "record_delete": "with l as (select lower(entity_id) as id, arg_max(action, (created_at, action)) as last from audit_logs where entity_type = 'lsr' and action in ('delete', 'restore') group by 1) select id, language_code from lsr_metadata where id not in (select id from l where last = 'delete')",
    "merge_attestations": f"with {_SURV}, a as (select distinct on (id) id, lower({_CLEAN}) as k, text_date from attestations where id is not null) select survivor as lsr_id, a.id, min(text_date) as text_date from a join sv on sv.id = a.k group by all",
    "merge_log": f"with {_SURV} select survivor as target_id, id as source_id, 'merge' as action, 'language_code+form_normalized' as reason from sv where id <> survivor",
    "merge_alternates": f"with {_SURV}, o as (select survivor, definition_primary as own from sv where id = survivor) select distinct survivor, definition_primary as definition from sv join o using (survivor) where definition_primary <> '' and definition_primary is distinct from own",
    "create_requests": r"""with x as (select entry_id as id, form, trim(regexp_replace(form, '\s+', ' ', 'g')) as c, language_code, substr(lower(regexp_replace(language_code, '[^A-Za-z-]', '', 'g')), 1, 10) as code, definitions[1] as definition, date_attested as y from raw_entries)
select id, substr(replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), 1, 200) as form, code as language_code,
 concat_ws(',', case when length(coalesce(form, '')) not between 1 and 200 then 'form' end, case when length(coalesce(language_code, '')) not between 2 and 10 or not coalesce(regexp_matches(code, '^[a-z]{3}(-[a-z]{2,4})?$'), false) then 'language_code' end,
 case when length(definition) > 2000 then 'definition' end, case when y not between -10000 and 3000 then 'date_start' end, case when y not between -10000 and 3000 then 'date_end' end) as issues from x""",
    "text_requests": r"""select doc_id as id, concat_ws(',', case when length(coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '')) not between 10 and 100000 then 'text' end, case when length(coalesce(lang, '')) not between 2 and 10 then 'language' end, case when year not between -10000 and 3000 then 'claimed' end) as issues from documents""",
    "denied_queries": "select entry_id from raw_entries where coalesce(regexp_matches(upper(etymology), 'DETACH DELETE|DROP|CREATE INDEX|CREATE CONSTRAINT'), false)",
    "result_pages": "with t as (select language_code, count(*) as n from lsr_metadata group by 1), p as (select language_code, n, unnest(generate_series(1, greatest(1, cast(ceil(n / 20) as int)))) as page from t) select language_code, n, cast(page as int) as page, page * 20 < n as has_next, page > 1 as has_previous from p",
    "verdict_routes": f"with {_ISS} select id, verdict, case when id is null then 'log' when verdict = 'pass' then 'production' when verdict = 'warn' then 'production, flagged' else 'validation queue' end as route from z",
}
