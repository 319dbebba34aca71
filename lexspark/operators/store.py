"""Keeping records: lookup, creation, versions, deletion, merging with its log, and checks of what is asked for.

Tables are immutable: a change is a new version of a row, and current() is the latest version of each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import collapse, iso_code, sanitized

ISO = "^[a-z]{3}(-[a-z]{2,4})?$"
#: Years that may be asked for.
ASKED_YEARS = (-10_000, 3000)
#: What a free query may not contain.
FORBIDDEN = ("DETACH DELETE", "DROP", "CREATE INDEX", "CREATE CONSTRAINT")


def get(records: DataFrame, key: str) -> DataFrame:
    """The one record of an id; raises KeyError without it."""
    x = records.filter(F.col("id") == key)
    if x.isEmpty():
        raise KeyError(key)
    return x


def lookup(records: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """asked (id) with the columns of the record and `found`; every asked row stays, null ids are not found."""
    r = records.select("id", *columns, F.lit(True).alias("found"))
    return asked.join(r, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def created(records: DataFrame, new: DataFrame) -> DataFrame:
    """records with the new ones whose id isn't there yet, as version 1; repeated new ids once, the first by all columns."""
    fresh = new.filter("id is not null").join(records.select("id"), "id", "left_anti")
    one = fresh.groupBy("id").agg(F.min(F.struct(*[c for c in fresh.columns if c != "id"])).alias("x")).select("id", "x.*")
    return records.unionByName(one.withColumn("version", F.lit(1)), allowMissingColumns=True)


def updated(records: DataFrame, changes: DataFrame, *fields: str) -> DataFrame:
    """records (id, version, fields) with the changed fields of changes (id, fields): null changes nothing, and a record
    of which nothing is changed keeps its version. changes has one row an id.
    """
    c = changes.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    x = records.join(c, "id", "left")
    touched = F.array_max(F.array(*[(F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f))).cast("int") for f in fields])) > 0
    x = x.withColumn("version", F.col("version") + F.when(touched, 1).otherwise(0))
    return x.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*records.columns)


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each id; partial maxima first, so an id with any number of versions is no hot spot."""
    rest = [c for c in versions.columns if c not in ("id", "version")]
    return versions.groupBy("id").agg(F.max(F.struct("version", *rest)).alias("x")).select("id", "x.*")


def deleted(records: DataFrame, log: DataFrame) -> DataFrame:
    """records without those whose last delete or restore in the log (entity_id, action, created_at) is a delete."""
    last = log.filter(F.col("action").isin("delete", "restore")).groupBy("entity_id").agg(F.max(F.struct("created_at", F.when(F.col("action") == "restore", 1).otherwise(0).alias("back"))).alias("x"))
    return records.join(last.filter("x.back = 0").select(F.col("entity_id").alias("id")), "id", "left_anti")


def survivors(records: DataFrame, key: list[str]) -> DataFrame:
    """(id, survivor): each record with the smallest id of its key; null keys are keys."""
    w = Window.partitionBy(*key)
    return records.select("id", F.min("id").over(w).alias("survivor"))


def merge_log(records: DataFrame, key: list[str]) -> DataFrame:
    """(target_id, source_id, action, reason): one row for every record that goes into another one."""
    return survivors(records, key).filter("id <> survivor").select(F.col("survivor").alias("target_id"), F.col("id").alias("source_id"), F.lit("merge").alias("action"), F.lit("+".join(key)).alias("reason"))


def merged_attestations(records: DataFrame, attestations: DataFrame, key: list[str]) -> DataFrame:
    """(lsr_id, id, text_date): the union of the members' attestations under the survivor, each id once.

    attestations (id, lsr_id, text_date).
    """
    s = survivors(records, key).withColumnRenamed("id", "lsr_id")
    x = attestations.join(s, "lsr_id").groupBy("survivor", "id").agg(F.min("text_date").alias("text_date"))
    return x.select(F.col("survivor").alias("lsr_id"), "id", "text_date")


def alternates(records: DataFrame, key: list[str]) -> DataFrame:
    """(survivor, definition): definitions of the members that the survivor doesn't have itself."""
    s = records.select("id", "definition_primary").join(survivors(records, key), "id")
    own = s.filter("id = survivor").select("survivor", F.col("definition_primary").alias("own"))
    x = s.filter("definition_primary <> ''").select("survivor", F.col("definition_primary").alias("definition")).distinct()
    return x.join(own, "survivor").filter(~F.col("definition").eqNullSafe(F.col("own"))).select("survivor", "definition")


def _issues(*checks: tuple[Column, str]) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull()), ",")


def _long(c: Column, least: int, most: int) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return (n < least) | (n > most)


def _year(c: str) -> Column:
    return F.coalesce(~F.col(c).between(*ASKED_YEARS), F.lit(False))


def create_requests(x: DataFrame) -> DataFrame:
    """(id, form, language_code, issues) of requests to create records: form, code, definition and years in bounds."""
    code = iso_code(F.col("language_code"))
    return x.select("id", sanitized(F.col("form"), 200).alias("form"), code.alias("language_code"), _issues(
        (_long(F.col("form"), 1, 200), "form"), (_long(F.col("language_code"), 2, 10) | ~F.coalesce(F.lower(code).rlike(ISO), F.lit(False)), "language_code"),
        (F.length(F.col("definition")) > 2000, "definition"), (_year("date_start"), "date_start"), (_year("date_end"), "date_end"),
    ).alias("issues"))


def text_requests(x: DataFrame) -> DataFrame:
    """(id, issues) of requests to date a text or to test a claimed year: texts of 10 to 100,000 characters, spaces collapsed."""
    t = collapse(F.col("text"))
    return x.select("id", _issues((_long(t, 10, 100_000), "text"), (_long(F.col("language"), 2, 10), "language"), (_year("claimed"), "claimed")).alias("issues"))


def search_arguments(query: str, language: str | None = None, date_start: int | None = None, date_end: int | None = None, limit: int = 20, offset: int = 0) -> dict:
    """The arguments of a search if they are in bounds; raises ValueError naming the first one that isn't."""
    years = [y for y in (date_start, date_end) if y is not None]
    wrong = [n for bad, n in ((not 1 <= len(query) <= 500, "query"), (language is not None and len(language) > 10, "language"), (any(not ASKED_YEARS[0] <= y <= ASKED_YEARS[1] for y in years), "date"), (not 1 <= limit <= 100, "limit"), (offset < 0, "offset")) if bad]
    if wrong:
        raise ValueError(f"{wrong[0]} out of bounds")
    return {"form": query, "language": language, "date_start": date_start, "date_end": date_end, "limit": limit, "offset": offset}


def denied(query: Column) -> Column:
    """Whether a free query contains an operation that isn't allowed, in any case."""
    return F.coalesce(F.upper(query).rlike("|".join(FORBIDDEN)), F.lit(False))


def pages(total: DataFrame, size: int = 20) -> DataFrame:
    """total (key, n) with the envelope of each page: (key, n, page, has_next, has_previous)."""
    p = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")))
    return total.withColumn("page", p).withColumn("has_next", F.col("page") * size < F.col("n")).withColumn("has_previous", F.col("page") > 1)


def routed(verdicts: DataFrame) -> DataFrame:
    """(id, verdict, route): pass and warn to production, warn with a flag, fail to the queue; without an id to the log."""
    v = F.col("verdict")
    return verdicts.select("id", "verdict", F.when(F.col("id").isNull(), "log").when(v == "pass", "production").when(v == "warn", "production, flagged").otherwise("validation queue").alias("route"))


def write_routes(routes: DataFrame, folder: str) -> None:
    """foreachBatch sink: rows by route, appended to a folder each."""
    routes.write.mode("append").partitionBy("route").json(folder)
