"""Corpus statistics over documents (doc_id, lang, text, year) and lexical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import ascii_words, edit_similarity
from lexspark.schema import STOP_WORDS


def frequency_series(docs: DataFrame, width: int = 50) -> DataFrame:
    """(lang, form, bin, n) of content words by period of `width` years."""
    x = docs.filter("year is not null").select("lang", (F.floor(F.col("year") / width) * width).cast("int").alias("bin"), F.explode(ascii_words(F.col("text"))).alias("form"))
    return x.filter((F.length("form") > 2) & ~F.col("form").isin(*STOP_WORDS)).groupBy("lang", "form", "bin").agg(F.count("*").alias("n"))


def acceleration(series: DataFrame) -> DataFrame:
    """Second difference of each word's series."""
    w = Window.partitionBy("lang", "form").orderBy("bin")
    return series.withColumn("acceleration", F.col("n") - 2 * F.lag("n", 1).over(w) + F.lag("n", 2).over(w)).filter("acceleration is not null")


def slices(lsr: DataFrame, width: int = 50, overlap: int = 10) -> DataFrame:
    """Records by overlapping time slices: (slice, n); a record counts in every slice that its period touches."""
    step = width - overlap
    first, last = F.floor((F.col("date_start") - width) / step).cast("int") + 1, F.floor(F.col("date_end") / step).cast("int")
    x = lsr.filter("date_start is not null and date_end is not null and date_end >= date_start").select(F.explode(F.sequence(first, last)).alias("k"))
    return x.groupBy((F.col("k") * step).alias("slice")).agg(F.count("*").alias("n"))


def collocations(docs: DataFrame, distance: int = 2, least: int = 5) -> DataFrame:
    """(a, b, n, pmi) of content words within `distance`; pairs come from each text's own window, so there is no join of tokens."""
    w = docs.select(F.filter(ascii_words(F.col("text")), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)).alias("w"))
    pairs = F.flatten(F.transform("w", lambda t, i: F.transform(F.slice("w", i + 2, F.lit(distance)), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b")))))
    p = w.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    words = w.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    total = words.agg(F.sum("c")).first()[0] or 0  # one number
    x = p.filter(F.col("n") >= least).join(words.withColumnsRenamed({"t": "a", "c": "ca"}), "a").join(words.withColumnsRenamed({"t": "b", "c": "cb"}), "b")
    return x.select("a", "b", "n", F.round(F.log2(F.col("n") * F.lit(float(total)) / (F.col("ca") * F.col("cb"))), 6).alias("pmi"))


def cognate_matrix(lsr: DataFrame, concepts: list[str]) -> DataFrame:
    """Presence of each concept (a word of a definition) by language, as columns."""
    words = F.split(F.lower("definition_primary"), "[^a-z]+")
    return lsr.groupBy("language_code").agg(*[F.max(F.when(F.array_contains(words, c), 1).otherwise(0)).alias(c) for c in concepts])


def language_distance(lsr: DataFrame) -> DataFrame:
    """1 - mean similarity of the first forms of the senses that two languages share."""
    x = lsr.filter("definition_primary is not null").groupBy("language_code", "definition_primary").agg(F.min("form_normalized").alias("f"))
    a, b = x.select(F.col("language_code").alias("a"), "definition_primary", F.col("f").alias("fa")), x.select(F.col("language_code").alias("b"), "definition_primary", F.col("f").alias("fb"))
    # languages per definition are at most the fixed list
    y = a.join(b, "definition_primary").filter("a < b")
    return y.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(1 - F.avg(edit_similarity(F.col("fa"), F.col("fb"))), 6).alias("distance"))


def split(lsr: DataFrame, strata: list[str]) -> DataFrame:
    """(id, strata, part): 80/10/10 inside each stratum by the order of a hash of the id, so that every stratum has its share.

    Ranks inside a stratum come from counts of 256 hash ranges; only inside one range are rows ranked, so a stratum may
    hold any part of the rows.
    """
    h = F.md5("id")
    x = lsr.select("id", *strata, F.substring(h, 1, 2).alias("_range"), h.alias("_h"))
    n = x.groupBy(*strata, "_range").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*strata)
    n = n.withColumns({"_n": F.sum("_k").over(w), "_before": F.sum("_k").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))})
    n = n.select(*[F.col(c).alias(f"n{c}") for c in (*strata, "_range")], "_n", "_before")
    cond = F.lit(True)
    for c in (*strata, "_range"):
        cond = cond & F.col(c).eqNullSafe(F.col(f"n{c}"))
    at = F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_h", "id")) - 1
    y = x.join(n, cond).withColumn("_s", at / F.col("_n"))
    return y.select("id", *strata, F.when(F.col("_s") < 0.8, "train").when(F.col("_s") < 0.9, "validation").otherwise("test").alias("part"))


def period_collocations(docs: DataFrame, width: int = 250, distance: int = 2, least: int = 5) -> DataFrame:
    """(period, a, b, n) of content words within `distance`, by period of the text; texts without a year aside."""
    x = docs.filter("year is not null").select((F.floor(F.col("year") / width) * width).cast("int").alias("period"), F.filter(ascii_words(F.col("text")), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)).alias("w"))
    pairs = F.flatten(F.transform("w", lambda t, i: F.transform(F.slice("w", i + 2, F.lit(distance)), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b")))))
    return x.select("period", F.explode(pairs).alias("p")).filter("p.a <> p.b").groupBy("period", "p.a", "p.b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def ranks(lsr: DataFrame) -> DataFrame:
    """(id, language_code, dense, quarter, percent) of dated records by first year inside their language."""
    w = Window.partitionBy("language_code").orderBy("date_start", "id")
    y = Window.partitionBy("language_code").orderBy("date_start")
    return lsr.filter("date_start is not null").select("id", "language_code", F.dense_rank().over(y).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(y), 6).alias("percent"))


def cube(lsr: DataFrame) -> DataFrame:
    """Records, different forms and summed confidence by language and part of speech, with all subtotals."""
    x = lsr.select("language_code", F.explode_outer("part_of_speech").alias("pos"), "form_normalized", "confidence_overall")
    return x.cube("language_code", "pos").agg(F.count("*").alias("n"), F.count_distinct("form_normalized").alias("forms"), F.round(F.sum("confidence_overall"), 6).alias("total"), F.grouping_id().alias("level"))


def approximate_forms(lsr: DataFrame, error: float = 0.05) -> DataFrame:
    """(language_code, forms): the number of different forms, by a sketch of fixed size."""
    return lsr.groupBy("language_code").agg(F.approx_count_distinct("form_normalized", error).alias("forms"))


def common_forms(a: DataFrame, b: DataFrame) -> DataFrame:
    """(form, where): forms of both sides, of the first and of the second only."""
    both, left, right = a.intersect(b), a.exceptAll(b).distinct().join(b, "form", "left_anti"), b.distinct().join(a, "form", "left_anti")
    return both.withColumn("where", F.lit("both")).unionByName(left.withColumn("where", F.lit("first"))).unionByName(right.withColumn("where", F.lit("second")))


def distances_by_clades(trees: DataFrame) -> DataFrame:
    """(a, b, distance) of every two of a few trees (tree, clade): clades that only one of them has."""
    t = trees.select("tree", "clade").distinct()
    n = t.groupBy("tree").agg(F.count("*").alias("n"))
    common = t.select(F.col("tree").alias("a"), "clade").join(t.select(F.col("tree").alias("b"), "clade"), "clade").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = common.join(n.select(F.col("tree").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("tree").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("k")).alias("distance"))


def robinson_foulds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of clades (sorted arrays in `clade`) that only one of two trees has."""
    x, y = a.select("clade").distinct(), b.select("clade").distinct()
    return x.join(y, "clade", "left_anti").unionByName(y.join(x, "clade", "left_anti")).agg(F.count("*").alias("distance"))
