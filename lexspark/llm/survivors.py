"""Best representative of each duplicate group (problem 4).

Groups: records of one language whose forms differ in the way of writing only, whose senses don't contradict and
whose periods overlap or aren't given. Senses are compared by the content words of their definitions, synonyms
(learned from the data) aside; a record without a usable definition joins the only sense that fits it.

Survivors of the two fields whose choice is laid down: per group and field, the Pareto-undominated records (skyline
over validation, confidence and recency) among those with a real value, then the best of them by the lexicographic
policy. That policy's first record is in every skyline, so here the skyline only spares the last step work. The merged
record takes its other fields by the whole method: layered() over completeness, recency and trust, policy inside a
layer, fields that a layer lacks from the next one. Layers over whole records can't choose the two fields: they let a
worse value win where the better one's record is in a lower layer.
The skyline is computed in salted parts first, so a group may hold any part of the rows.

Nulls: no confidence counts lowest, no update time earliest, no validation as not validated; at equal rank the
smallest id wins. Repeated rows are one record. Records that fit several senses or periods equally join none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import lexemes as X
from lexspark.session import written

SALTS = 16
COLUMNS = (
    "id", "form_orthographic", "form_normalized", "form_phonetic", "language_code", "date_start", "date_end", "period_label",
    "definition_primary", "part_of_speech", "source_databases", "confidence_overall", "human_validated", "updated_at",
)
FIELDS = ("definition_primary", "form_phonetic")


#: Definitions with fewer content words than this share of all definitions has are taken as cut off when senses are compared.
SHORT_SHARE = 0.05


def with_sense(records: DataFrame, same: DataFrame, every: DataFrame, key: str = "k") -> DataFrame:
    """records (key, id, w, broken) with `sense`, null where none or more than one fits; every: all records, for what is usual."""
    x = X.rewritten(records, same)
    usual = every.filter("w is not null and not broken").select(F.percentile_approx(F.size("w"), SHORT_SHARE).alias("usual")).first()["usual"]
    whole = F.col("cw").isNotNull() & ~F.col("broken") & (F.size("cw") >= max(usual or 0, 2))
    x = written(x.withColumn("own", F.when(whole, F.concat_ws(" ", "cw"))))
    senses = x.filter("own is not null").groupBy(key, "own").agg(F.first("cw").alias("sw"), F.max("pos").alias("spos"))
    per_key = senses.groupBy(key).agg(F.count("*").alias("n"), F.min("own").alias("only"))
    open_ = x.filter("own is null").join(per_key, key, "left")
    single = open_.filter("n is null or n = 1").withColumn("sense", F.coalesce("only", F.lit("")))
    # one sense, but words that aren't in it: another sense that was cut off
    most = F.when(F.col("cw").isNull(), F.array().cast("array<string>")).otherwise(F.col("cw"))
    many = open_.filter("n > 1").withColumn("most", most).join(senses.select(F.col(key), F.col("own").alias("sense"), "sw", "spos"), key)
    # the last word of a broken definition may be a part only
    missing = F.size(F.array_except("most", "sw"))
    fits = (missing <= 1) & (F.size("most") - missing >= F.when(F.size("most") > 1, 1).otherwise(0)) & F.coalesce(F.col("pos") == F.col("spos"), F.lit(True))
    # records here are those without a usable definition whose form has several senses, each met with these few senses
    many = many.filter(fits).groupBy("id").agg(F.min("sense").alias("sense"), F.count("*").alias("m"), F.min(missing).alias("_")).filter("m = 1").select("id", "sense")
    cols = records.columns
    a = x.filter("own is not null").select(*cols, F.col("own").alias("sense"))
    b = single.select(*cols, "sense")
    c = open_.filter("n > 1").join(many, "id", "left").select(*cols, "sense")
    return a.unionByName(b).unionByName(c)


def with_period(x: DataFrame) -> DataFrame:
    """x (k, sense, date_start, date_end, period_label) with `island`: the number of its cluster of overlapping periods."""
    lo = F.coalesce("date_start", "date_end")
    hi = F.greatest(lo, F.coalesce("date_end", "date_start"))
    x = x.withColumn("lo", lo).withColumn("hi", hi)
    g = ["k", "sense"]
    spans = x.filter("lo is not null and sense is not null").select(*g, "lo", "hi").distinct()
    w = Window.partitionBy(*g).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("island", F.sum(F.when(F.col("lo") <= reach, 0).otherwise(1)).over(w))
    dated = x.filter("lo is not null").join(spans, [*g, "lo", "hi"], "left")
    per = spans.groupBy(*g).agg(F.max("island").alias("islands"))
    labels = dated.filter("period_label is not null and island is not null").groupBy(*g, "period_label").agg(F.min("island").alias("by_label"), F.count_distinct("island").alias("n")).filter("n = 1").drop("n")
    undated = x.filter("lo is null").join(per, g, "left").join(labels, [*g, "period_label"], "left")
    undated = undated.withColumn("island", F.when(F.coalesce("islands", F.lit(0)) <= 1, F.lit(1).cast("bigint")).otherwise(F.col("by_label")))
    return dated.select(*x.columns, "island").unionByName(undated.select(*x.columns, "island")).drop("lo", "hi")


def broken_ends(records: DataFrame) -> DataFrame:
    """Ids of records whose definition ends within a word: its last word is rare and the beginning of a frequent one."""
    last = F.regexp_extract(F.lower("def"), r"(\p{L}+)\W*$", 1)
    words = records.filter("def is not null").select(F.explode(F.array_distinct(F.split(F.lower("def"), r"[^\p{L}]+"))).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - 1)), lambda i: F.substring("w", 1, i))).alias("last"), F.col("n").alias("full")).groupBy("last").agg(F.max("full").alias("full"))
    rare = starts.join(words.withColumnRenamed("w", "last"), "last", "left").filter(F.coalesce("n", F.lit(0)) * 20 < F.col("full")).select("last", F.lit(True).alias("stub"))
    return records.withColumn("last", F.when(F.col("def").isNotNull(), last)).join(rare, "last", "left").withColumn("stub", F.coalesce("stub", F.lit(False))).drop("last")


def wordings(entries: DataFrame) -> DataFrame:
    """(k, w) of the definitions of each entry, more matter to learn synonyms from: an entry often words one sense twice."""
    x = entries.filter("size(definitions) > 1").select(F.concat(F.lit("#"), F.col("entry_id")).alias("k"), F.explode("definitions").alias("def"))
    x = x.withColumn("def", X.real_definition(F.col("def"))).filter(F.col("def").isNotNull() & ~X.seems_cut(F.col("def")))
    return x.select("k", X.stems(F.col("def")).alias("w"))


def groups(meta: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Records in groups of two or more, with group id `g`; written out, as several aggregates read it."""
    m = meta.select(*COLUMNS).filter("id is not null and language_code is not null").dropDuplicates(["id"])
    orthographic = X.skeleton(F.col("form_orthographic"))
    m = m.withColumn("sk", F.coalesce(F.nullif(orthographic, F.lit("")), X.skeleton(F.col("form_normalized"))))
    m = m.withColumn("k", F.concat_ws("|", "language_code", "sk")).withColumn("def", X.real_definition(F.col("definition_primary")))
    m = m.withColumn("pos", F.nullif(F.concat_ws(",", F.array_sort("part_of_speech")), F.lit("")))
    m = broken_ends(m).withColumn("broken", F.coalesce(X.seems_cut(F.col("def")) | F.col("stub"), F.lit(False)))
    sense = ["id", "k", "w", "pos", "broken", "date_start", "date_end", "period_label"]
    values = ["def", "form_phonetic", "source_databases", "confidence_overall", "human_validated", "updated_at"]
    m = written(m.withColumn("w", X.stems(F.col("def"))).filter("sk <> ''").select(*sense, *values))
    words = m.filter("w is not null and not broken").select("k", "w")
    same = X.learned(words if entries is None else words.unionByName(wordings(entries)))
    # a group has two records of one form at least; the other forms end here
    repeated = m.groupBy("k").agg(F.count("*").alias("_n")).filter("_n > 1").select("k")
    # each step reads its input several times: written out between them, plans stay small
    x = written(with_sense(m.select(*sense).join(repeated, "k", "left_semi"), same, m).filter("sense is not null").drop("w"))
    x = with_period(x).filter("island is not null").select("id", X.identity("k", "sense", "island").alias("g"))
    x = written(x)
    sizes = x.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1")
    return written(x.join(sizes, "g").join(m.select("id", "broken", *values), "id"))


def real_values(g: DataFrame) -> DataFrame:
    """(g, id, field, value, validated, confidence, updated): the real values of both fields."""
    base = ["g", "id", *_ranks()]
    d = g.filter("def is not null and not broken").select(*base, F.lit("definition_primary").alias("field"), F.col("def").alias("value"))
    p = g.select(*base, F.lit("form_phonetic").alias("field"), X.real_phonetic(F.col("form_phonetic")).alias("value")).filter("value is not null").filter(~F.col("value").rlike(r"(?:…|\.\.\.|\[cut\])\s*$"))
    v = written(d.unionByName(p)).withColumn("plain", F.regexp_replace(F.lower("value"), r"[\s.]+$|^\s*\(arch\.\)\s*", ""))
    # a value that another one begins with also is the beginning of the next one in order
    w = Window.partitionBy("g", "field").orderBy("plain")
    cut = v.select("g", "field", "plain").distinct().withColumn("next", F.lead("plain").over(w)).filter(F.expr("startswith(next, plain)")).select("g", "field", "plain")
    return v.join(cut, ["g", "field", "plain"], "left_anti").drop("plain")


def _ranks() -> list[Column]:
    """Trust and recency with nulls at the end: validated, confidence, updated."""
    early = F.lit("0001-01-01").cast("timestamp_ntz")
    return [F.coalesce("human_validated", F.lit(False)).alias("validated"), F.coalesce("confidence_overall", F.lit(-1.0)).alias("confidence"), F.coalesce("updated_at", early).alias("updated")]


def skyline(v: DataFrame, by: list[str], levels: int = 0) -> DataFrame:
    """Rows of v that no other row of the same `by` dominates in validated, confidence, updated and, where levels are
    given, completeness (0 to levels); of equal ones the first id. Salted parts first, so a group may hold any part of the rows.
    """
    def undominated(x: DataFrame, part: list[str]) -> DataFrame:
        # rows above in order are at least as trusted by confidence; what is left to compare is one running maximum
        # for each step of the other scales
        order = [F.desc("confidence"), F.desc("updated"), F.desc("validated"), *([F.desc("completeness")] if levels else []), "id"]
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        above = F.lit(None).cast("timestamp_ntz")
        for level in range(levels + 1):
            for validated in (True, False):
                at_least = (F.col("completeness") >= level if levels else F.lit(True)) & (F.col("validated") if validated else F.lit(True))
                own = (F.col("completeness") == level if levels else F.lit(True)) & (F.col("validated") == validated)
                above = F.when(own, F.max(F.when(at_least, F.col("updated"))).over(w)).otherwise(above)
        return x.withColumn("_above", above).filter("_above is null or _above < updated").drop("_above")

    salted = undominated(v.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), [*by, "_salt"]).drop("_salt")
    return undominated(salted, by)


def best(v: DataFrame, by: list[str]) -> DataFrame:
    """The policy's choice in each skyline: validated, then confidence, then recency, then the smallest id."""
    w = Window.partitionBy(*by).orderBy(F.desc("validated"), F.desc("confidence"), F.desc("updated"), "id")
    return skyline(v, by).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def field_survivors(meta: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(g, field, lsr_id, value)"""
    return best(real_values(groups(meta, entries)), ["g", "field"]).select("g", "field", F.col("id").alias("lsr_id"), "value")


#: What a surviving record takes over as a whole or has filled in from the next layers.
FILLED = ("form_orthographic", "date_start", "date_end", "period_label", "part_of_speech")


def layered(records: DataFrame) -> DataFrame:
    """(g, layer, and the FILLED fields): per group its successive dominance layers, each by its first record in policy order.

    records: (g, id, validated, confidence, updated, FILLED). Completeness is the number of filled fields. A layer is the
    skyline of what the layers before left over; layers end for a group when all fields that it has at all are filled,
    which is after the second or third one: a complete record is in the first.
    """
    full = lambda f: F.col(f).isNotNull() & (F.col(f) != F.array().cast("array<string>") if f == "part_of_speech" else F.trim(F.col(f).cast("string")) != "")
    x = written(records.withColumn("completeness", sum((F.coalesce(full(f), F.lit(False)).cast("int") for f in FILLED), F.lit(0))))
    have = x.groupBy("g").agg(*[F.max(F.coalesce(full(f), F.lit(False))).alias(f"has_{f}") for f in FILLED])
    # policy inside a layer: trust, then completeness, then recency
    order = Window.partitionBy("g").orderBy(F.desc("validated"), F.desc("confidence"), F.desc("completeness"), F.desc("updated"), "id")
    out, number = None, 1
    while True:
        top = written(skyline(x, ["g"], len(FILLED)))
        # every record of the layer may fill a field, the first one in order that has it
        span = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        chosen = [F.first(F.when(full(f), F.col(f)), ignorenulls=True).over(span).alias(f) for f in FILLED]
        one = top.select("g", "id", F.row_number().over(order).alias("_r"), *chosen).filter("_r = 1").select("g", "id", F.lit(number).alias("layer"), *FILLED)
        out = one if out is None else out.unionByName(one)
        out = written(out)
        missing = out.groupBy("g").agg(*[F.max(F.col(f).isNotNull()).alias(f"got_{f}") for f in FILLED]).join(have, "g")
        missing = missing.filter(" or ".join(f"(has_{f} and not got_{f})" for f in FILLED)).select("g")
        x = written(x.join(missing, "g", "left_semi").join(top.select("g", "id"), ["g", "id"], "left_anti"))
        if x.isEmpty():
            return out
        number += 1


def merged(meta: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """One row per group: the record of the first layer that the policy prefers, its missing fields filled from the
    layers after it, the surviving definition and pronunciation, the highest confidence and all sources, evenly written.
    """
    g = groups(meta, entries)
    chosen = best(real_values(g), ["g", "field"])
    values = chosen.groupBy("g").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    source = F.lower(F.regexp_replace("source", r"[^\p{L}\p{N}]+", ""))
    # sources are names of databases: as many per group as there are databases
    sources = g.select("g", F.explode("source_databases").alias("source")).withColumn("source", source).filter("source <> ''").distinct().groupBy("g").agg(F.array_sort(F.collect_set("source")).alias("source_databases"))
    head = g.groupBy("g").agg(F.min("id").alias("group_id"), F.count("*").alias("members"), F.max("confidence_overall").alias("confidence_overall"))
    whole = meta.select("id", *FILLED).filter("id is not null").dropDuplicates(["id"])
    layers = layered(g.select("g", "id", *_ranks()).join(whole, "id"))
    filled = layers.groupBy("g").agg(F.min_by("id", "layer").alias("survivor"), F.max("layer").alias("layers"), *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("layer"))).alias(f) for f in FILLED])
    return head.join(filled, "g").join(values, "g", "left").join(sources, "g", "left").drop("g")
