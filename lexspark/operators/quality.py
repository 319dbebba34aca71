"""Validation and data quality of records and entries: issues as arrays, verdicts, gauges, outliers.

A null counts as missing. Every function works on empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO = "^[a-z]{3}(-[a-z]{2,4})?$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
YEARS = (-10_000, 2100)


def _issues(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def _missing(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def entry_issues(entries: DataFrame) -> DataFrame:
    """(entry_id, issues): form, language or definitions missing."""
    empty = F.coalesce(F.size("definitions"), F.lit(0)) < 1
    return entries.select("entry_id", _issues((_missing("form"), "form"), (_missing("language"), "language"), (empty, "definitions")).alias("issues"))


def record_issues(lsr: DataFrame, languages: DataFrame) -> DataFrame:
    """(id, critical, warnings): schema rules are critical, reference rules warn."""
    known = F.broadcast(languages.select(F.col("iso_code").alias("language_code"), F.lit(True).alias("known")))  # the fixed canonical list
    s, e = F.col("date_start"), F.col("date_end")
    outside = F.coalesce((s < YEARS[0]) | (e > YEARS[1]), F.lit(False))
    critical = _issues((_missing("form_orthographic"), "form"), (~F.coalesce(F.lower("language_code").rlike(ISO), F.lit(False)), "iso"), (~F.col("id").rlike(UUID), "id"), (F.coalesce(s > e, F.lit(False)), "order"), (outside, "year"), (F.coalesce(~F.col("confidence_overall").between(0, 1), F.lit(False)), "confidence"))
    warnings = _issues((F.col("known").isNull(), "language"), (F.col("definition_primary").isNull(), "definition"), (s.isNull() & e.isNull(), "undated"))
    return lsr.join(known, "language_code", "left").select("id", F.size(critical).alias("critical"), F.size(warnings).alias("warnings"))


def verdict(critical: Column, warnings: Column) -> Column:
    return F.when(critical > 0, "fail").when(warnings > 0, "warn").otherwise("pass")


def gauges(lsr: DataFrame) -> DataFrame:
    """Records and mean confidence by language and confidence bucket, with subtotals (rollup)."""
    bucket = F.coalesce(F.floor(F.least(F.col("confidence_overall"), F.lit(0.999)) * 5).cast("int"), F.lit(-1))
    x = lsr.select("language_code", bucket.alias("bucket"), "confidence_overall")
    return x.rollup("language_code", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("confidence_overall"), 6).alias("mean"), F.grouping_id().alias("level"))


def outliers(lsr: DataFrame, z: float = 2.0) -> DataFrame:
    """Records whose first year is more than z deviations from the mean of their language."""
    g = lsr.filter("date_start is not null").groupBy("language_code").agg(F.avg("date_start").alias("m"), F.stddev_pop("date_start").alias("sd"))
    x = lsr.join(F.broadcast(g), "language_code")  # as many rows as languages
    score = (F.col("date_start") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return x.withColumn("z", F.round(score, 6)).filter(F.abs("z") > z).select("id", "language_code", "z")


def colexification(lsr: DataFrame) -> DataFrame:
    """Forms of a language with two definitions or more."""
    return lsr.filter("definition_primary is not null").groupBy("language_code", "form_normalized").agg(F.count_distinct("definition_primary").alias("senses")).filter("senses > 1")


def queue(validation: DataFrame) -> DataFrame:
    """Open items by priority, then age, numbered per assignee."""
    x = validation.withColumn("status", F.lower(F.trim("status"))).filter("status = 'pending'").dropDuplicates(["id"])
    # places inside a priority, then the items of higher ones before it: many items without an assignee are no one group
    w = Window.partitionBy("assigned_to", "priority").orderBy("created_at", "id")
    x = x.select("id", "assigned_to", "priority", F.row_number().over(w).alias("within"))
    n = x.groupBy("assigned_to", "priority").agg(F.count("*").alias("k"))
    above = F.sum("k").over(Window.partitionBy("assigned_to").orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(F.col("assigned_to").alias("_a"), F.col("priority").alias("_p"), F.coalesce(above, F.lit(0)).alias("above"))
    y = x.join(n, F.col("assigned_to").eqNullSafe(F.col("_a")) & F.col("priority").eqNullSafe(F.col("_p")))
    return y.select("id", "assigned_to", "priority", (F.col("within") + F.col("above")).cast("int").alias("place"))


def calibrated(confidence: Column, sources: Column, reviewed: Column, reconstructed: Column) -> Column:
    """Confidence plus 0.1 for several sources, plus 0.2 if reviewed, less 0.2 if reconstructed, between 0 and 1."""
    up = F.when(sources > 1, 0.1).otherwise(0.0) + F.when(reviewed, 0.2).otherwise(0.0) - F.when(reconstructed, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + up))


def clamped(confidence: Column, factor: Column) -> Column:
    """A confidence times a factor, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * factor))


def density(lsr: DataFrame, facts: DataFrame) -> DataFrame:
    """(language_code, period_label, records, attestations, density): attestations a record; facts (lsr_id, n)."""
    x = lsr.join(facts, lsr["id"] == facts["lsr_id"], "left").groupBy("language_code", "period_label")
    return x.agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("attestations")).withColumn("density", F.round(F.col("attestations") / F.col("records"), 6))


def confidence_clusters(lsr: DataFrame, z: float = 1.0) -> DataFrame:
    """(language_code, period_label, n, mean, z): groups whose mean confidence is unusually high or low among all groups."""
    g = lsr.filter("confidence_overall is not null").groupBy("language_code", "period_label").agg(F.count("*").alias("n"), F.avg("confidence_overall").alias("mean"))
    m = g.agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("sd")).first()  # two numbers
    score = (F.col("mean") - F.lit(m["m"])) / F.nullif(F.lit(m["sd"]), F.lit(0.0))
    return g.withColumn("z", F.round(score, 6)).filter(F.abs("z") > z).select("language_code", "period_label", "n", F.round("mean", 6).alias("mean"), "z")


def loads(log: DataFrame) -> DataFrame:
    """(source_name, processed, succeeded, failed, skipped, rate) of a load log; rows delivered twice once."""
    st = F.lower(F.trim("status"))
    x = log.dropDuplicates(["id"]).groupBy("source_name").agg(F.count("*").alias("processed"), F.count_if(st.isin("processed", "success", "succeeded", "done", "ok")).alias("succeeded"), F.count_if(st.isin("failed", "error")).alias("failed"), F.count_if(st == "skipped").alias("skipped"))
    return x.withColumn("rate", F.round(F.col("succeeded") / F.col("processed"), 6))


def aged_orphans(nodes: DataFrame, edges: DataFrame, now: str, days: int) -> DataFrame:
    """(node_id, language_code): nodes of at least so many days before `now` without an edge; edges (source_id, target_id)."""
    old = nodes.filter(F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return old.join(ends, old["node_word"] == ends["id"], "left_anti").select("node_id", "language_code")
