"""Semantic drift along vector trajectories (form, lang, date, vec, id).

Points are ordered by date, then id. Shifts compare a point with the one before, drift with the last one that has a
vector; so an empty vector breaks a shift but not the drift. Points without a date are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import vectors as V
from lexspark.schema import SHIFT_WORDS

SHIFT = 0.2
KEY = ["form", "lang"]


def _order():
    return Window.partitionBy(*KEY).orderBy("date", "id")


def shift_type(before: Column, after: Column) -> Column:
    """The type whose words were won most between two definitions; else by length; unknown without either."""
    a, b = F.lower(before), F.lower(after)

    def count(text: Column, words: list[str]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))

    # of equal scores the first type in order
    scores = F.array(*[F.struct((count(b, ws) - count(a, ws)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, ws) in enumerate(SHIFT_WORDS.items())])
    top = F.array_max(scores)
    best = F.when(top["score"] > 0, top["kind"])
    ratio = F.length(b) / F.nullif(F.length(a), F.lit(0))
    by_length = F.when(ratio > 1.5, "generalization").when(ratio < 0.7, "specialization").otherwise("general")
    missing = before.isNull() | after.isNull() | (before == "") | (after == "")
    return F.when(missing, "unknown").otherwise(F.coalesce(best, by_length))


def points(series: DataFrame) -> DataFrame:
    x, y = V.plane(F.col("vec"))
    return series.filter("date is not null").select(*KEY, "id", "date", x.alias("x"), y.alias("y"))


def shifts(series: DataFrame) -> DataFrame:
    """(form, lang, id, date, magnitude) of consecutive points farther apart than SHIFT."""
    x = series.filter("date is not null").withColumn("before", F.lag("vec").over(_order()))
    return x.withColumn("magnitude", V.drift(F.col("before"), F.col("vec"))).filter(F.col("magnitude") > SHIFT).select(*KEY, "id", "date", F.round("magnitude", 4).alias("magnitude"))


def totals(series: DataFrame) -> DataFrame:
    """(form, lang, points, total, stability, final) of each trajectory."""
    dated = series.filter("date is not null")
    x = dated.filter(F.size("vec") > 0).withColumn("step", F.coalesce(V.drift(F.lag("vec").over(_order()), F.col("vec")), F.lit(0.0)))
    drift = x.groupBy(*KEY).agg(F.sum("step").alias("total"), F.max_by("vec", F.struct("date", "id")).alias("final"))
    s = dated.withColumn("m", V.drift(F.lag("vec").over(_order()), F.col("vec"))).groupBy(*KEY).agg(F.count("*").alias("points"), F.sum(F.when(F.col("m") > SHIFT, F.col("m")).otherwise(0.0)).alias("shifted"))
    stability = F.when(F.col("points") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("shifted") / F.col("points")))
    return s.join(drift, KEY, "left").select(*KEY, "points", F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"), F.round(stability, 4).alias("stability"), "final")


def divergence(series: DataFrame) -> DataFrame:
    """(form, a, b, divergence) of each pair of languages of a form; languages are a fixed handful per form."""
    t = totals(series).filter("final is not null")
    a, b = t.select("form", F.col("lang").alias("a"), F.col("final").alias("va"), F.col("total").alias("ta")), t.select("form", F.col("lang").alias("b"), F.col("final").alias("vb"), F.col("total").alias("tb"))
    x = a.join(b, "form").filter("a < b")
    return x.select("form", "a", "b", F.round(0.7 * V.drift(F.col("va"), F.col("vb")) + 0.3 * F.least(F.lit(1.0), F.abs(F.col("ta") - F.col("tb"))), 4).alias("divergence"))


def centroids(series: DataFrame) -> DataFrame:
    """Mean vector of each form, by place."""
    x = series.select("form", F.posexplode("vec").alias("place", "v"))
    return x.groupBy("form", "place").agg(F.round(F.avg("v"), 6).alias("mean"))


def trajectory(series: DataFrame) -> DataFrame:
    """Every dated point of (form, lang, id, date, vec, definition, confidence, attestations) with its place on the way:
    x, y, the step from the point before, whether it is a shift, its type and confidence, and the drift so far.
    """
    x, y = V.plane(F.col("vec"))
    w = _order()
    p = series.filter("date is not null")
    p = p.withColumns({"step": F.coalesce(V.drift(F.lag("vec").over(w), F.col("vec")), F.lit(0.0)), "before": F.lag("definition").over(w), "trust": F.lag("confidence").over(w), "x": x, "y": y})
    p = p.withColumn("shifted", F.col("step") > SHIFT)
    p = p.withColumn("running", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4))
    kind = F.when(F.col("shifted"), shift_type(F.col("before"), F.col("definition")))
    return p.select(*KEY, "id", "date", "x", "y", "definition", "attestations", "confidence", F.round("step", 4).alias("magnitude"), "shifted", kind.alias("shift_type"), F.when(F.col("shifted"), F.least("trust", "confidence")).alias("shift_confidence"), "running", F.col("step").alias("distance"))


def shift_rows(series: DataFrame, least: float = 0.3) -> DataFrame:
    """The shifts of at least a magnitude with their evidence in words."""
    x = trajectory(series).filter(F.col("shifted") & (F.col("magnitude") >= least))
    return x.select(*KEY, "id", "date", "magnitude", "shift_type", "shift_confidence", F.format_string("distance %.3f at %d", F.col("distance"), F.col("date")).alias("evidence"))


def shift_edges(series: DataFrame) -> DataFrame:
    """SHIFTED_TO edges between the records of consecutive points of a shift, the earlier first."""
    x = series.filter("date is not null").withColumns({"from": F.lag("id").over(_order()), "step": V.drift(F.lag("vec").over(_order()), F.col("vec"))})
    return x.filter(F.col("step") > SHIFT).select(F.col("from").alias("source_id"), F.col("id").alias("target_id"), F.lit("SHIFTED_TO").alias("relationship_type"), F.col("date").alias("date_of_change"))


def found_or_form(asked: DataFrame, series: DataFrame) -> DataFrame:
    """asked (form, lang) with its points' number: of the language, or of the form in any language where that has none."""
    own = series.groupBy(*KEY).agg(F.count("*").alias("own"))
    every = series.groupBy("form").agg(F.count("*").alias("every"))
    return asked.distinct().join(own, KEY, "left").join(every, "form", "left").select(*KEY, F.coalesce("own", "every", F.lit(0)).alias("points"), F.when(F.col("own").isNotNull(), "language").when(F.col("every").isNotNull(), "form").otherwise("none").alias("found_by"))


def extremes(divergences: DataFrame) -> DataFrame:
    """(form, most_similar, most_divergent) pairs of languages of each form; of equal ones the first."""
    pair = F.concat_ws("-", "a", "b")
    return divergences.groupBy("form").agg(F.min(F.struct("divergence", pair.alias("p")))["p"].alias("most_similar"), F.min(F.struct((-F.col("divergence")).alias("d"), pair.alias("p")))["p"].alias("most_divergent"))


def field_evolution(points: DataFrame) -> DataFrame:
    """(field, century, n, moved): mean vectors of semantic fields by century and how far they moved since the one before.

    points (field, date, vec).
    """
    x = points.filter("date is not null and size(vec) > 0").withColumn("century", (F.floor(F.col("date") / 100) * 100).cast("int"))
    m = x.select("field", "century", F.posexplode("vec").alias("place", "v")).groupBy("field", "century", "place").agg(F.avg("v").alias("v"))
    c = m.groupBy("field", "century").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p["v"]).alias("c"))  # as many as a vector has places
    n = x.groupBy("field", "century").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("century")
    return c.join(n, ["field", "century"]).withColumn("before", F.lag("c").over(w)).withColumn("moved", F.when(F.col("before").isNotNull(), F.round(V.drift(F.col("before"), F.col("c")), 4))).select("field", "century", "n", "moved")
