"""Queries of trained models; only rates and alignments have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import learning as L
from lexspark.operators.contact import by_century
from lexspark.operators.relations import inherited_or_borrowed
from lexspark.plans.contact import BORROW, borrowings
from lexspark.sources.tables import table


def dating_classifier(s, d):
    docs = table(s, d, "documents", "doc_id", "text", "year")
    return L.classify(docs, L.fit_dating(docs)).groupBy("claimed", "period").agg(F.count("*").alias("n"))


def borrowing_classifier(s, d):
    w = table(s, d, "raw_entries", F.col("entry_id").alias("id"), "form", "definitions", F.col("date_attested").alias("year"), inherited_or_borrowed(F.col("etymology")).alias("kind"))
    return L.judge_borrowing(w, L.fit_borrowing(w)).groupBy("kind", "guess").agg(F.count("*").alias("n"))


def _vectors(s, d):
    return table(s, d, "embeddings", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def aligned_vectors(s, d):
    """Vectors whose places were shifted by one are turned back: the distance that is left, by vector."""
    v = _vectors(s, d).withColumn("a", F.concat(F.slice("v", 2, 63), F.slice("v", 1, 1)))
    turn = L.fit_alignment(v.select("a", F.col("v").alias("b")), 64)
    gap = F.aggregate(F.zip_with("a", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return L.aligned(v, "a", turn).select("vec_id", (F.sqrt(gap) < 1e-6).alias("restored"))


def rate_anomalies(s, d):
    b = by_century(borrowings(s, d, True)).groupBy(F.col("donor").alias("key"), F.col("century").alias("bin")).agg(F.sum("n").alias("n"))
    return L.rate_anomalies(b)


QUERIES = {
    "dating_classifier": dating_classifier, "borrowing_classifier": borrowing_classifier, "aligned_vectors": aligned_vectors, "rate_anomalies": rate_anomalies,
    "reduced_vectors": lambda s, d: L.reduced(_vectors(s, d), "v", 2).select("vec_id", F.size("v").alias("places")),
}
SQL: dict[str, str] = {
    "aligned_vectors": "select vec_id, true as restored from embeddings",
    "reduced_vectors": "select vec_id, cast(2 as int) as places from embeddings",
    "rate_anomalies": f"with {BORROW}, c as (select donor as key, cast(floor(year / 100) * 100 as int) as bin, count(*) as n from b where year is not null group by all), a as (select *, n - 2 * lag(n, 1) over w + lag(n, 2) over w as a from c window w as (partition by key order by bin)), g as (select key, avg(a) as m, stddev_pop(a) as sd from a where a is not null group by 1) select key, bin, n, round((a - m) / nullif(sd, 0), 6) as z from a join g using (key) where a is not null and abs(round((a - m) / nullif(sd, 0), 6)) > 2",
}
