"""Queries of the alert rules, deltas and window histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.plans.streams import _E, _LE
from lexspark.sources.tables import table
from lexspark.streaming import alerts as A
from lexspark.streaming import metrics as S

_day = lambda x: x.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
QUERIES = {
    "histogram_text": lambda s, d: A.histogram_text(S.histogram(_E(s, d))),
    "daily_histogram": lambda s, d: A.windowed_histogram(_E(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd")),
    "silent_days": lambda s, d: _day(A.silent_days(table(s, d, "ingestion_records", "ingested_at"), "ingested_at")),
    "failing_days": lambda s, d: _day(A.failing_days(table(s, d, "ingestion_records", "ingested_at", "status"), "ingested_at", 0.1)),
    "long_queues": lambda s, d: _day(A.long_queues(table(s, d, "validation_queue", "created_at", "completed_at"), 100)),
    "slow_days": lambda s, d: _day(A.slow_days(_E(s, d), 50.0)),
    "confidence_moves": lambda s, d: _day(A.moved_means(table(s, d, "lsr_metadata", "updated_at", "confidence_overall"), "updated_at", "confidence_overall")),
    "latest_spans": lambda s, d: A.latest(_E(s, d)).select("event_id", "user_id"),
    "idempotent_ingest": lambda s, d: A.ingested(table(s, d, "raw_entries")).groupBy("source_name").agg(F.count("*").alias("n")),
    "daily_delta": lambda s, d: A.delta(table(s, d, "raw_entries"), "2026-01-15 00:00:00").groupBy("source_name").agg(F.count("*").alias("n")),
}
_ING = "select distinct source_name, source_id, sha256(concat_ws(chr(31), form, language, etymology)) as h from raw_entries"
_H = f"select event_type, le, count(value) filter (le is null or value / 100.0 <= le) as n from events, ({_LE}) group by all"
SQL = {
    "histogram_text": f"with h as ({_H}) select 'latency_bucket{{type=\"' || event_type || '\",le=\"' || coalesce(le::varchar, '+Inf') || '\"}} ' || n as line from h",
    "daily_histogram": f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, le, count(value) filter (le is null or value / 100.0 <= le) as n from events, ({_LE}) group by all",
    "silent_days": "with d as (select distinct ingested_at::date as day from ingestion_records where ingested_at is not null), a as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d) select strftime(day, '%Y-%m-%d') as day from a where day not in (select day from d)",
    "failing_days": "with g as (select ingested_at::date as d, count(*) as n, count(*) filter (lower(trim(status, ' ')) in ('failed', 'error')) as failed from ingestion_records where ingested_at is not null group by 1) select strftime(d, '%Y-%m-%d') as day, n, failed, round(failed / n, 6) as share from g where round(failed / n, 6) > 0.1",
    "long_queues": "with s as (select created_at::date as d, 1 as k from validation_queue where created_at is not null union all select completed_at::date, -1 from validation_queue where completed_at is not null), g as (select d, sum(k) as k from s group by 1), o as (select d, sum(k) over (order by d rows unbounded preceding)::bigint as open from g) select strftime(d, '%Y-%m-%d') as day, open from o where open > 100",
    "slow_days": "with g as (select ts::date as d, round(quantile_cont(value, 0.99), 6) as p from events group by 1) select strftime(d, '%Y-%m-%d') as day, p from g where p > 50",
    "confidence_moves": "with g as (select updated_at::date as d, avg(confidence_overall) as mean from lsr_metadata where updated_at is not null group by 1) select strftime(a.d, '%Y-%m-%d') as day, round(a.mean, 6) as mean, round(b.mean, 6) as before, round(abs(a.mean - b.mean), 6) as moved from g a join g b on a.d = b.d + 7 where abs(a.mean - b.mean) > 0.1",
    "latest_spans": "select event_id, user_id from events order by ts desc, event_id desc limit 1000",
    "idempotent_ingest": f"with x as ({_ING}) select source_name, count(*) as n from x group by 1",
    "daily_delta": f"with x as ({_ING} where fetched_at > timestamp '2026-01-13 22:00:00') select source_name, count(*) as n from x group by 1",
}
