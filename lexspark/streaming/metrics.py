"""Streams of events (event_id, ts, user_id, event_type, value): counters, histograms, deduplication, limits, alerts.

Every function takes a DataFrame, batch or streaming, unless it says so; event time is watermarked where state must end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Look-back of late events.
LATE = "26 hours"
#: Upper bounds of latency buckets, the last one open.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def timed(events: DataFrame) -> DataFrame:
    """ts as an event time that can be watermarked."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def counters(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    w = F.window("ts", width)
    x = timed(events).withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def histogram(events: DataFrame, unit: float = 100.0) -> DataFrame:
    """(event_type, le, n): cumulative buckets of value / unit; le null is the open bucket. One pass, one row per type."""
    v = F.col("value") / unit
    sums = [F.sum(F.when(v <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    g = events.groupBy("event_type").agg(*sums, F.count("value").alias("open"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("open").alias("n"))]
    return g.select("event_type", F.explode(F.array(*rows)).alias("r")).select("event_type", "r.le", "r.n")


def gauge(events: DataFrame) -> DataFrame:
    """Running number of open items per user: +1 for an add, -1 for a remove; batch only."""
    from pyspark.sql import Window

    step = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("user_id", "event_id", F.sum(step).over(w).alias("open"))


def idempotent(events: DataFrame) -> DataFrame:
    """Repeated event ids within the watermark dropped."""
    x = timed(events).withWatermark("ts", LATE)
    return x.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else x.dropDuplicates(["event_id"])


def slow(events: DataFrame, limit: float = 1000.0) -> DataFrame:
    return events.filter(F.col("value") > limit)


def exposition(counts: DataFrame) -> DataFrame:
    """Prometheus text lines of (event_type, n)."""
    return counts.select(F.concat(F.lit('events_total{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


def alerts(events: DataFrame, share: float = 0.2) -> DataFrame:
    """(day, event_type, n, share) of days on which a type makes up more than `share` of the day's events."""
    g = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    total = g.groupBy("day").agg(F.sum("n").alias("total"))
    return g.join(total, "day").withColumn("share", F.round(F.col("n") / F.col("total"), 6)).filter(F.col("share") > share).select("day", "event_type", "n", "share")


def limited(events: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """Events let through by a sliding limit per user: at most `most` accepted in any `seconds`; refused ones don't count.

    Streaming: keyed state of the accepted times, at most `most` of them. Needs event order within a batch only.
    """
    out = "user_id bigint, event_id bigint, accepted boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times: list[float] = list(state.get[0]) if state.exists else []
        for b in batches:
            b = b.sort_values(["ts", "event_id"])
            ok, times = admit(b["ts"].astype("int64").to_numpy() / 1e9 if str(b["ts"].dtype).endswith("[ns]") else b["ts"].map(pd.Timestamp.timestamp).to_numpy(), times, most, seconds)
            yield pd.DataFrame({"user_id": key[0], "event_id": b["event_id"], "accepted": ok})
        # a user from whom nothing came for a window has no accepted time left: the state may go
        state.update((times,))
        state.setTimeoutDuration(seconds * 1000)

    x = timed(events).select("user_id", "event_id", "ts")
    return x.groupBy("user_id").applyInPandasWithState(step, out, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def admit(times, before: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which of the ordered times are accepted, after those accepted before; and the accepted ones still counting."""
    kept, ok = list(before), []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        ok.append(len(kept) < most)
        if ok[-1]:
            kept.append(float(t))
    return ok, kept


def limited_batch(events: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """The same for a finished table: users are dealt out by key, each one's events in order.

    A user's events are read one by one with `most` times in memory, from a sorted partition, so a frequent user is no
    group in memory.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for b in batches:
            ok = []
            for u, t in zip(b["user_id"], b["t"]):
                if u != user:
                    user, kept = u, []
                a, kept = admit([t], kept, most, seconds)
                ok += a
            yield pd.DataFrame({"user_id": b["user_id"], "event_id": b["event_id"], "accepted": ok})

    x = events.filter("user_id is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)
    x = x.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return x.select("user_id", "event_id", "t").mapInPandas(run, "user_id bigint, event_id bigint, accepted boolean")


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def route(batch: DataFrame, folder: str) -> None:
    """foreachBatch sink: events by type, appended to a folder each."""
    batch.write.mode("append").partitionBy("event_type").parquet(folder)
