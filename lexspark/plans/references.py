"""Queries of problem 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.operators import references as R
from lexspark.sources.tables import table


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = lambda n, *c: table(spark, d, n, *c)
    return {
        "attestations": t("attestations", "id", "lsr_id", "created_at"),
        "validation_queue": t("validation_queue", "id", "lsr_id", "created_at"),
        "ingestion_records": t("ingestion_records", "id", "lsr_id", "ingested_at"),
        "lsr_metadata": t("lsr_metadata", "id", "neo4j_id", "created_at"),
        "graph_nodes": t("graph_nodes", "node_id", "created_at"),
        "audit_logs": t("audit_logs", "action", "entity_type", "entity_id", "created_at"),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return R.all_orphans(_tables(spark, d)).select("table_name", "record_id", "kind").distinct()


def p3_orphans_per_month(spark: SparkSession, d: str) -> DataFrame:
    return R.per_period(R.all_orphans(_tables(spark, d)))


_CORE = r"""
with refs as (
  select 'attestations' as table_name, id as record_id, lsr_id as ref, created_at as own, 'lsr' as et from attestations
  union all select 'validation_queue', id, lsr_id, created_at, 'lsr' from validation_queue
  union all select 'ingestion_records', id, lsr_id, ingested_at, 'lsr' from ingestion_records
  union all select 'lsr_metadata', id, neo4j_id, created_at, 'graph_node' from lsr_metadata
), k as (
  select *, case when et = 'lsr' then lower(regexp_replace(ref, '^[\s\x{a0}{(]+|[\s\x{a0})}]+$', '', 'g')) else regexp_replace(ref, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') end as key from refs where ref is not null
), parents as (
  select 'lsr' as et, lower(id) as key, created_at from lsr_metadata union all select 'graph_node', node_id, created_at from graph_nodes
), dels as (
  select et, key from (
    select entity_type as et, case when entity_type = 'lsr' then lower(entity_id) else entity_id end as key, action,
      row_number() over (partition by entity_type, lower(entity_id) order by created_at desc, action) as rn
    from audit_logs where action in ('delete', 'restore')) where rn = 1 and action = 'delete'
), found as (
  select distinct table_name, record_id, own,
    case when p.key is null and d.key is not null then 'deleted' when p.key is null then 'missing' when p.created_at > k.own then 'late' end as kind
  from k left join parents p using (et, key) left join dels d using (et, key) where k.key <> ''
)
"""

QUERIES = {"p3_found": p3_found, "p3_orphans_per_month": p3_orphans_per_month}
SQL = {
    "p3_found": _CORE + "select distinct table_name, record_id, kind from found where kind is not null",
    "p3_orphans_per_month": _CORE + "select table_name, strftime(own, '%Y-%m') as month, kind, count(*) as n from found where kind is not null group by all",
}
