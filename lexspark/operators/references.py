"""References to records that do not exist (problem 3).

Parent keys are integers (a UUID is one of 128 bits, held as two BIGINTs; `prefix:000123` is its number).
Sorted keys are compressed into contiguous runs, every distinct reference is matched as-of to the preceding
run start, and a reference beyond that run's end is an orphan. A run also carries the latest creation time of
its members, so that only references older than it need an exact look at their parent ("late").
Keys that are no integers are matched by equality of their cleaned text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID_RE = "^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
#: Low bits of a numbered key inside one bucket; runs are cut at bucket borders so that each bucket is matched alone.
RUN_BITS = 14
#: High bits of a UUID that make its bucket.
UUID_BUCKET_SHIFT = 44
#: Copies of the flagged keys when they are joined to their rows; splits a key that holds a large part of all rows.
SALTS = 8


def clean_uuid(c: Column) -> Column:
    """UUID text without regard to case, surrounding blanks and braces; blank gives null."""
    x = F.lower(F.regexp_replace(c, r"^[\s {(]+|[\s })]+$", ""))
    return F.when(x != "", x)


def clean_node(c: Column) -> Column:
    x = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(x != "", x)


def _hex64(x: Column) -> Column:
    """Sixteen hex digits as a signed BIGINT in order (top half mapped below zero)."""
    hi = F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint") - F.lit(2147483648)
    lo = F.conv(F.substring(x, 9, 8), 16, 10).cast("bigint")
    return hi * F.lit(4294967296) + lo


def integer_key(key: Column) -> Column:
    """struct(space, hi, lo) of a cleaned key, or null if it isn't of a known integer form."""
    h = F.regexp_replace(key, "-", "")
    number = F.regexp_extract(key, r"^(.*?)(\d{1,18})$", 2)
    uuid = F.struct(F.lit("uuid").alias("space"), _hex64(F.substring(h, 1, 16)).alias("hi"), _hex64(F.substring(h, 17, 16)).alias("lo"))
    # the width is part of the space: lsr:01 and lsr:1 are different texts
    num = F.struct(
        F.concat(F.regexp_extract(key, r"^(.*?)(\d{1,18})$", 1), F.lit("#"), F.length(number).cast("string")).alias("space"),
        F.lit(0).cast("bigint").alias("hi"),
        F.expr("try_cast(regexp_extract(_key, '^(.*?)([0-9]{1,18})$', 2) as bigint)").alias("lo"),
    )
    return F.when(key.rlike(UUID_RE), uuid).when(number != "", num)


def _keyed(df: DataFrame) -> DataFrame:
    """Adds space, hi, lo and bucket to a frame with the column _key."""
    df = df.withColumn("_ik", integer_key(F.col("_key")))
    df = df.withColumns({x: F.col(f"_ik.{x}") for x in ("space", "hi", "lo")}).drop("_ik")
    bucket = F.when(F.col("space") == "uuid", F.shiftright("hi", UUID_BUCKET_SHIFT)).otherwise(F.shiftright("lo", RUN_BITS))
    return df.withColumn("bucket", bucket)


def runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs (space, bucket, hi, lo, end_lo, run_max) of distinct integer keys with columns _key and created.

    Empty input gives no runs; repeated keys count once, with their earliest creation.
    """
    w = Window.partitionBy("space", "bucket").orderBy("hi", "lo")
    k = parents.groupBy("space", "bucket", "hi", "lo").agg(F.min("created").alias("created"))
    same = (F.lag("hi").over(w) == F.col("hi")) & (F.lag("lo").over(w) + 1 == F.col("lo"))
    k = k.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return k.groupBy("space", "bucket", "run").agg(
        F.min(F.struct("hi", "lo")).alias("s"), F.max("lo").alias("end_lo"), F.max("created").alias("run_max")
    ).select("space", "bucket", "s.hi", "s.lo", "end_lo", "run_max")


def match_keys(keys: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct reference keys that are absent or may be late: (_key, present).

    keys: (_key, first) with the earliest time of a referring row; parents: (_key, created).
    """
    k, p = _keyed(keys), _keyed(parents)
    r = runs(p.filter("space is not null"))
    both = r.select("space", "bucket", "hi", "lo", F.lit(0).alias("ref"), "end_lo", "run_max", F.lit(None).cast("string").alias("_key"), F.lit(None).cast("timestamp_ntz").alias("first")).unionByName(
        k.filter("space is not null").select("space", "bucket", "hi", "lo", F.lit(1).alias("ref"), F.lit(None).cast("bigint").alias("end_lo"), F.lit(None).cast("timestamp_ntz").alias("run_max"), "_key", "first")
    )
    w = Window.partitionBy("space", "bucket").orderBy("hi", "lo", "ref").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.col("ref") == 0, F.struct("hi", "end_lo", "run_max")), ignorenulls=True).over(w)
    seen = both.withColumn("run", run).filter("ref = 1").withColumn(
        "present", F.coalesce((F.col("run.hi") == F.col("hi")) & (F.col("lo") <= F.col("run.end_lo")), F.lit(False))
    )
    integers = seen.filter(~F.col("present") | (F.col("run.run_max") > F.col("first"))).select("_key", "present")
    texts = k.filter("space is null").join(p.filter("space is null").groupBy("_key").agg(F.max(F.lit(True)).alias("present")), "_key", "left")
    return integers.unionByName(texts.select("_key", F.coalesce("present", F.lit(False)).alias("present")))


def last_deletions(audit: DataFrame, entity_type: str, clean) -> DataFrame:
    """Keys whose last delete or restore is a delete; at equal times a delete counts as later than a restore."""
    a = audit.filter((F.col("entity_type") == entity_type) & F.col("action").isin("delete", "restore"))
    a = a.select(clean(F.col("entity_id")).alias("_key"), "created_at", (F.col("action") == "delete").alias("deleted"))
    return a.filter("_key is not null").groupBy("_key").agg(F.max(F.struct("created_at", "deleted")).alias("x")).filter("x.deleted").select("_key", F.lit(True).alias("deleted"))


def orphans(refs: DataFrame, parents: DataFrame, audit: DataFrame, entity_type: str, clean) -> DataFrame:
    """Orphan and late references: (table_name, record_id, kind, at), distinct.

    refs: (table_name, record_id, ref, at); parents: (key, created); null and blank references are no cases; a null
    own time is never late. Works on empty inputs. References are counted down to distinct keys before the match,
    so one key may hold any part of the rows.
    """
    refs = refs.withColumn("_key", clean(F.col("ref"))).filter("_key is not null")
    parents = parents.select(clean(F.col("key")).alias("_key"), F.col("created")).filter("_key is not null")
    keys = refs.groupBy("_key").agg(F.min("at").alias("first"))
    flagged = match_keys(keys, parents)
    # the exact creation only of keys that may be late; parents are few per key (their key is unique)
    created = parents.groupBy("_key").agg(F.min("created").alias("created"))
    flagged = flagged.join(created, "_key", "left").join(last_deletions(audit, entity_type, clean), "_key", "left")
    flagged = flagged.withColumn("kind", F.when(~F.col("present"), F.when(F.col("deleted"), "deleted").otherwise("missing")).otherwise("late"))
    salted = flagged.select("_key", "kind", "created", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = refs.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(salted, ["_key", "_salt"]).filter((F.col("kind") != "late") | (F.col("created") > F.col("at")))
    return out.select("table_name", "record_id", "kind", "at").distinct()


def all_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """The orphans of the four referring tables."""
    def side(name: str, at: str) -> DataFrame:
        return tables[name].select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.col("lsr_id").alias("ref"), F.col(at).alias("at"))

    lsr = side("attestations", "created_at").unionByName(side("validation_queue", "created_at")).unionByName(side("ingestion_records", "ingested_at"))
    meta, audit = tables["lsr_metadata"], tables["audit_logs"]
    nodes = meta.select(F.lit("lsr_metadata").alias("table_name"), F.col("id").alias("record_id"), F.col("neo4j_id").alias("ref"), F.col("created_at").alias("at"))
    a = orphans(lsr, meta.select(F.col("id").alias("key"), F.col("created_at").alias("created")), audit, "lsr", clean_uuid)
    b = orphans(nodes, tables["graph_nodes"].select(F.col("node_id").alias("key"), F.col("created_at").alias("created")), audit, "graph_node", clean_node)
    return a.unionByName(b)


def per_period(found: DataFrame) -> DataFrame:
    """Counts per table, month of the referring row and kind; rows without a time come under a null month."""
    month = F.date_format("at", "yyyy-MM")
    return found.groupBy("table_name", month.alias("month"), "kind").agg(F.count("*").alias("n"))


__all__ = ["all_orphans", "clean_node", "clean_uuid", "last_deletions", "orphans", "per_period", "runs"]
