"""Language contact from borrowing records (donor, recipient, year, form, source_form, fields, definition).

Years are clustered by century; events need a least size and confidence. A borrowing with semantic fields counts once
for each; otherwise for the first domain with a word in its definition, or for none. Null years join no cluster.
Hot pairs of languages are no problem: everything is a grouped aggregate with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import century_label, century_start, suffix_change
from lexspark.schema import CONTACT_PARTS, DOMAIN_WORDS
from lexspark.session import written


def domains(fields: Column, definition: Column) -> Column:
    """Domains of a borrowing as an array."""
    text = F.lower(F.coalesce(definition, F.lit("")))
    first = F.coalesce(*[F.when(_any(text, words), F.lit(d)) for d, words in DOMAIN_WORDS.items()])
    return F.when(F.size(fields) > 0, fields).when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>"))


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def speaks_for(domain: Column, kind: str) -> Column:
    """Whether a part of a domain's name speaks for a type of contact; a name may speak for several."""
    return _any(F.lower(domain), CONTACT_PARTS[kind])


def between(b: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Borrowings in a closed range of years; an unknown year passes, an absent end doesn't filter."""
    y = F.col("year")
    inside = (F.lit(True) if first is None else y >= first) & (F.lit(True) if last is None else y <= last)
    return b.filter(y.isNull() | inside)


def two_sided(b: DataFrame) -> DataFrame:
    """Every borrowing seen from its recipient (incoming) and from its donor (outgoing)."""
    x = b.withColumn("domains", domains(F.col("fields"), F.col("definition")))
    sides = F.array(F.struct(F.col("recipient").alias("language"), F.col("donor").alias("other"), F.lit("incoming").alias("direction")), F.struct(F.col("donor").alias("language"), F.col("recipient").alias("other"), F.lit("outgoing").alias("direction")))
    return x.select("year", "form", "domains", F.explode(sides).alias("s")).select("s.language", "s.other", "s.direction", "year", "form", "domains")


KEY = ["language", "other", "direction", "century"]


def events(b: DataFrame, min_borrowings: int = 5, min_confidence: float = 0.3) -> DataFrame:
    """(language, other, direction, century, borrowings, intensity, confidence, contact_type) of all languages at once."""
    # both aggregates read the domains
    x = written(two_sided(b).filter("year is not null").withColumn("century", century_start(F.col("year"))))
    size = x.groupBy(*KEY).agg(F.count("*").alias("n"), F.stddev_pop("year").alias("sd"))
    counts = x.select(*KEY, F.explode("domains").alias("domain")).groupBy(*KEY, "domain").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*KEY)
    p = F.col("c") / F.sum("c").over(w)
    spread = counts.withColumn("h", -p * F.log2(p)).groupBy(*KEY).agg(F.sum("h").alias("h"), *[F.sum(F.when(speaks_for(F.col("domain"), k), F.col("c")).otherwise(0)).alias(k) for k in CONTACT_PARTS])
    e = size.join(spread, KEY, "left").filter(F.col("n") >= min_borrowings)
    h = F.coalesce("h", F.lit(0.0)) / F.log2(F.lit(10.0))
    steady = F.when(F.col("n") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / 100))
    e = e.withColumn("confidence", F.round(0.4 * F.least(F.lit(1.0), F.col("n") / 20) + 0.3 * (1 - h) + 0.3 * steady, 3))
    most = F.greatest(*[F.coalesce(k, F.lit(0)) for k in CONTACT_PARTS])
    kind = F.coalesce(*[F.when((F.col(k) == most) & (most > 0), F.lit(k)) for k in CONTACT_PARTS])
    return e.filter(F.col("confidence") >= min_confidence).select(*KEY, F.col("n").alias("borrowings"), F.round(F.least(F.lit(1.0), F.col("n") / 50), 3).alias("intensity"), "confidence", kind.alias("contact_type"))


def by_century(b: DataFrame) -> DataFrame:
    return b.filter("year is not null").groupBy("donor", "recipient", century_start(F.col("year")).alias("century")).agg(F.count("*").alias("n"))


def by_domain(b: DataFrame) -> DataFrame:
    return b.select("donor", "recipient", F.explode(domains(F.col("fields"), F.col("definition"))).alias("domain")).groupBy("donor", "recipient", "domain").agg(F.count("*").alias("n"))


def peak_century(b: DataFrame) -> DataFrame:
    """The century with most borrowings of each pair; the earliest of equals."""
    w = Window.partitionBy("donor", "recipient").orderBy(F.desc("n"), "century")
    return by_century(b).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def adaptations(b: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """Most frequent changes of a word's end by recipient."""
    x = b.select("recipient", suffix_change(F.col("source_form"), F.col("form")).alias("change")).filter("change is not null").groupBy("recipient", "change").agg(F.count("*").alias("n"))
    w = Window.partitionBy("recipient").orderBy(F.desc("n"), "change")
    return x.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= top) & (F.col("n") >= least))


def intensity(b: DataFrame) -> DataFrame:
    """Of each unordered pair: totals both ways, intensity, asymmetry and dominant donor (second of equals)."""
    x = b.filter("donor <> recipient").withColumn("a", F.least("donor", "recipient")).withColumn("b", F.greatest("donor", "recipient")).withColumn("d", domains(F.col("fields"), F.col("definition")))
    g = x.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("donor") == F.col("a")).alias("ab"), F.size(F.array_distinct(F.flatten(F.collect_set("d")))).alias("domains"))
    r = F.col("ab") / F.col("n")
    return g.select("a", "b", "n", "ab", "domains", F.round(F.least(F.lit(1.0), F.col("n") / 100 * (0.5 + 0.5 * F.col("domains") / 10)), 3).alias("intensity"), F.round(F.abs(r - (1 - r)), 3).alias("asymmetry"), F.when(F.col("ab") > F.col("n") - F.col("ab"), F.col("a")).otherwise(F.col("b")).alias("dominant"))


def ordered_events(e: DataFrame, language: str) -> DataFrame:
    """A language's events, the surest first, then the earliest, numbered."""
    w = Window.partitionBy("language").orderBy(F.desc("confidence"), "century", "direction", "other")
    return e.filter(F.col("language") == language).withColumn("place", F.row_number().over(w))


def patterns(b: DataFrame, examples: int = 10) -> DataFrame:
    """(donor, recipient, total, centuries, domains, peak, first_forms) of each pair: counts by century label, years unknown
    aside, and by domain as text, in order, and the first forms by year.

    Labels and domains of a pair are few; forms are cut to `examples` before they are collected.
    """
    k = ["donor", "recipient"]
    total = b.groupBy(*k).agg(F.count("*").alias("total"))
    dated = b.filter("year is not null").groupBy(*k, century_start(F.col("year")).alias("c"), century_label(F.col("year")).alias("label")).agg(F.count("*").alias("n"))
    text = lambda order, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name, "n"))), lambda x: F.concat(x[name], F.lit("="), x["n"].cast("string"))), "; ")
    labels = dated.groupBy(*k).agg(text("c", "label").alias("centuries"), F.min(F.struct((-F.col("n")).alias("n"), "c"))["c"].alias("peak"))
    fields = by_domain(b).withColumn("o", F.col("domain")).groupBy(*k).agg(text("o", "domain").alias("domains"))
    w = Window.partitionBy(*k).orderBy(F.asc_nulls_last("year"), "form", "source_form")
    some = b.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples).groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "form"))), lambda x: x["form"]), ", ").alias("first_forms"))
    return total.join(labels, k, "left").join(fields, k, "left").join(some, k, "left")


def century_labels(b: DataFrame) -> DataFrame:
    return b.filter("year is not null").groupBy("donor", "recipient", century_label(F.col("year")).alias("label")).agg(F.count("*").alias("n"))
