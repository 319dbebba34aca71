"""Queries of the streaming operators over the finished events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.sources.tables import table
from lexspark.streaming import metrics as S

_E = lambda s, d: table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")
QUERIES = {
    "metrics_counters": lambda s, d: S.counters(_E(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")),
    "latency_histogram": lambda s, d: S.histogram(_E(s, d)),
    "active_gauge": lambda s, d: S.gauge(_E(s, d)),
    "daily_delta_dedup": lambda s, d: S.idempotent(_E(s, d)).groupBy("event_type").agg(F.count("*").alias("n")),
    "slow_requests": lambda s, d: S.slow(_E(s, d), 100.0).select("event_id", "value"),
    "metrics_text": lambda s, d: S.exposition(_E(s, d).groupBy("event_type").agg(F.count("*").alias("n"))),
    "alert_share": lambda s, d: S.alerts(_E(s, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd")),
    "rate_limit": lambda s, d: S.limited_batch(_E(s, d), 2, 3600),
}
_LE = " union all ".join(f"select {b}::double as le" for b in S.BUCKETS) + " union all select null::double"
SQL = {
    "metrics_counters": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "latency_histogram": f"select event_type, le, count(value) filter (le is null or value / 100.0 <= le) as n from events, ({_LE}) group by all",
    "active_gauge": "select user_id, event_id, sum(case when event_type = 'purchase' then -1 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as open from events",
    "daily_delta_dedup": "select event_type, count(distinct event_id) as n from events group by 1",
    "slow_requests": "select event_id, value from events where value > 100",
    "metrics_text": "select 'events_total{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type",
    "alert_share": "with g as (select date_trunc('day', ts) as d, event_type, count(*) as n from events group by all) select strftime(d, '%Y-%m-%d') as day, event_type, n, round(n / sum(n) over (partition by d), 6) as share from g qualify round(n / sum(n) over (partition by d), 6) > 0.2",
}
