"""Alert rules and ingest deltas over logs; functions take a DataFrame, batch or, where said, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.streaming.metrics import BUCKETS, LATE, timed


def histogram_text(h: DataFrame) -> DataFrame:
    """Prometheus text lines of (event_type, le, n)."""
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    return h.select(F.concat(F.lit('latency_bucket{type="'), "event_type", F.lit('",le="'), le, F.lit('"} '), F.col("n").cast("string")).alias("line"))


def windowed_histogram(events: DataFrame, width: str = "1 day", unit: float = 100.0) -> DataFrame:
    """(start, event_type, le, n): the histogram of each tumbling window, batch or streaming."""
    v = F.col("value") / unit
    sums = [F.sum(F.when(v <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    g = timed(events).withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(*sums, F.count("value").alias("open"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("open").alias("n"))]
    return g.select(F.col("window.start").alias("start"), "event_type", F.explode(F.array(*rows)).alias("r")).select("start", "event_type", "r.le", "r.n")


def silent_days(loads: DataFrame, at: str) -> DataFrame:
    """(day) without any row between the first and the last day: nothing came in for a day."""
    d = loads.filter(F.col(at).isNotNull()).select(F.to_date(at).alias("day")).distinct()
    ends = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(d, "day", "left_anti")


def failing_days(loads: DataFrame, at: str, share: float = 0.2) -> DataFrame:
    """(day, n, failed, share): days on which more than a share of the rows failed."""
    g = loads.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim("status")).isin("failed", "error")).alias("failed"))
    return g.withColumn("share", F.round(F.col("failed") / F.col("n"), 6)).filter(F.col("share") > share)


def long_queues(queue: DataFrame, most: int) -> DataFrame:
    """(day, open): days at whose end more than `most` items are waiting."""
    step = lambda c, v: queue.filter(F.col(c).isNotNull()).groupBy(F.to_date(c).alias("day")).agg(F.count("*").alias("k")).select("day", (F.col("k") * v).alias("k"))
    g = step("created_at", 1).unionByName(step("completed_at", -1)).groupBy("day").agg(F.sum("k").alias("k"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return g.withColumn("open", F.sum("k").over(w)).filter(F.col("open") > most).select("day", "open")


def slow_days(events: DataFrame, limit: float, at: float = 0.99) -> DataFrame:
    """(day, p): days whose high percentile of the value is above a limit."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.percentile("value", at), 6).alias("p")).filter(F.col("p") > limit)


def moved_means(x: DataFrame, at: str, value: str, days: int = 7, least: float = 0.1) -> DataFrame:
    """(day, mean, before, moved): days whose mean differs by more than `least` from that of the day `days` before."""
    g = x.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.avg(value).alias("mean"))
    before = g.select(F.date_add("day", days).alias("day"), F.col("mean").alias("before"))
    y = g.join(before, "day").withColumn("moved", F.abs(F.col("mean") - F.col("before"))).filter(F.col("moved") > least)
    return y.select("day", *[F.round(c, 6).alias(c) for c in ("mean", "before", "moved")])


def latest(spans: DataFrame, most: int = 1000) -> DataFrame:
    """The last `most` events: what a ring buffer of that size holds. The limit is the operator."""
    return spans.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def ingested(entries: DataFrame) -> DataFrame:
    """Repeats of a source id with the same content dropped, within the watermark if entries stream in."""
    h = F.sha2(F.concat_ws("\x1f", "form", "language", "etymology"), 256)
    x = entries.withColumn("content_hash", h).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", LATE)
    key = ["source_name", "source_id", "content_hash"]
    return x.dropDuplicatesWithinWatermark(key) if entries.isStreaming else x.dropDuplicates(key)


def delta(entries: DataFrame, since: str, look_back: str = LATE) -> DataFrame:
    """A daily delta: what came in after `since` less the look-back, repeats of a source id and content once."""
    start = F.lit(since).cast("timestamp_ntz") - F.expr(f"interval {look_back}")
    return ingested(entries.filter(F.col("fetched_at") > start))
