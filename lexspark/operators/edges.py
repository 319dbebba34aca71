"""Typed edges between words (source_id, target_id, relationship_type): builders, evidence in etymologies, id lists.

Directions: a descendant points to its ancestor, a borrower to its donor, an earlier sense to a later one. Cognates are
stored once, the smaller id first, and read both ways. Edges with a null end are dropped, repeated ones counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "([^ ,.]+)"
LANG = r"((?:Old |Middle |Proto-)?[A-Z][a-z]+)"


def node(language: Column, form: Column) -> Column:
    """The id of a word: its language and form; null without a form."""
    return F.when(form != "", F.concat_ws(":", F.coalesce(language, F.lit("unknown")), form))


def edge(source: Column, target: Column, kind: str, year: Column | None = None) -> Column:
    """One edge as a struct; cognates in the order of their ids."""
    a, b = (F.least(source, target), F.greatest(source, target)) if kind == "COGNATE_OF" else (source, target)
    known = source.isNotNull() & target.isNotNull() & (source != target)
    return F.when(known, F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("relationship_type"), (F.lit(None).cast("int") if year is None else year).alias("year")))


def descent(child: Column, ancestor: Column, year: Column | None = None) -> Column:
    return edge(child, ancestor, "DESCENDS_FROM", year)


def borrowing(borrower: Column, donor: Column, year: Column | None = None) -> Column:
    return edge(borrower, donor, "BORROWED_FROM", year)


def cognates(a: Column, b: Column) -> Column:
    return edge(a, b, "COGNATE_OF")


def shift(earlier: Column, later: Column, year: Column | None = None) -> Column:
    return edge(earlier, later, "SHIFTED_TO", year)


def from_etymologies(words: DataFrame, languages: DataFrame) -> DataFrame:
    """Edges that the etymologies of words (lang, form, etymology, year) tell, with the first year and number of witnesses.

    languages (name, lang): the fixed canonical list; a name that isn't in it stands for no language.
    """
    t = F.col("etymology")
    got = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    origin = rf"^Of {LANG} origin: (.+?) → (.+?) → "
    loan = [rf"^Borrowed from {LANG} {WORD}", rf"^From {LANG} {WORD},", rf"^Loan of the [a-z]+ trade .*, cf\. {LANG} {WORD}"]
    pick = lambda g: F.coalesce(*[got(p, g) for p in loan])
    ultimate, verb, kin = rf"^From {LANG} {WORD}, ultimately from {LANG} {WORD}", rf"^From the verb {WORD},.* via {LANG} {WORD}", rf"compare {LANG} {WORD} and {LANG} {WORD}"
    parts = {
        "origin_l": got(origin, 1), "origin_a": got(origin, 2), "origin_b": got(origin, 3), "loan_l": pick(1), "loan_f": pick(2), "last_l": got(ultimate, 3), "last_f": got(ultimate, 4),
        "verb_f": got(verb, 1), "via_l": got(verb, 2), "via_f": got(verb, 3), "stem_f": got(rf"^A derivative of {WORD}", 1), "kin1_l": got(kin, 1), "kin1_f": got(kin, 2), "kin2_l": got(kin, 3), "kin2_f": got(kin, 4),
    }
    x = words.filter("form <> '' and etymology <> ''").select("lang", "form", "year", *[c.alias(k) for k, c in parts.items()])
    for name in ("origin", "loan", "last", "via", "kin1", "kin2"):
        x = x.join(F.broadcast(languages.select(F.col("name").alias(f"{name}_l"), F.col("lang").alias(f"{name}_c"))), f"{name}_l", "left")
    at = lambda name, form: F.when(F.col(f"{name}_c").isNotNull(), node(F.col(f"{name}_c"), F.col(form)))
    own, y = node(F.col("lang"), F.col("form")), F.col("year")
    old, mid, donor, last, via = at("origin", "origin_a"), at("origin", "origin_b"), at("loan", "loan_f"), at("last", "last_f"), at("via", "via_f")
    verb_, stem = node(F.col("lang"), F.col("verb_f")), node(F.col("lang"), F.col("stem_f"))
    every = [descent(own, mid, y), descent(mid, old, y), borrowing(own, donor, y), descent(donor, last, y), borrowing(own, via, y), descent(own, verb_, y), descent(own, stem, y)]
    every += [cognates(own, at(k, f"{k}_f")).withField("year", y) for k in ("kin1", "kin2")]
    e = x.select(F.explode(F.array_compact(F.array(*every))).alias("e")).select("e.*")
    return e.groupBy("source_id", "target_id", "relationship_type").agg(F.min("year").alias("first_year"), F.count("*").alias("witnesses"))


def id_lists(edges: DataFrame) -> DataFrame:
    """(id, list, other): each word's ancestors, descendants, cognates, donors and loans as rows, so that a word with any
    number of them is no large value."""
    pair = lambda a, b, name: F.struct(F.col(a).alias("id"), F.lit(name).alias("list"), F.col(b).alias("other"))
    k = F.col("relationship_type")
    rows = F.when(k == "DESCENDS_FROM", F.array(pair("source_id", "target_id", "ancestor"), pair("target_id", "source_id", "descendant")))
    rows = rows.when(k == "BORROWED_FROM", F.array(pair("source_id", "target_id", "donor"), pair("target_id", "source_id", "loan")))
    rows = rows.when(k == "COGNATE_OF", F.array(pair("source_id", "target_id", "cognate"), pair("target_id", "source_id", "cognate")))
    return edges.select(F.explode(rows).alias("r")).select("r.*").distinct()


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (id): what stays when nodes are deleted with their edges."""
    gone = nodes.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)


def implausible(edges: DataFrame, families: DataFrame) -> DataFrame:
    """Descent across families: edges whose ends belong to different families; families (lang, family), the fixed list."""
    f = lambda c: F.broadcast(families.select(F.col("lang").alias(f"{c}_lang"), F.col("family").alias(f"{c}_family")))
    x = edges.filter("relationship_type = 'DESCENDS_FROM'").withColumns({f"{c}_lang": F.substring_index(f"{c}_id", ":", 1) for c in ("source", "target")})
    return x.join(f("source"), "source_lang").join(f("target"), "target_lang").filter("source_family <> target_family").select("source_id", "target_id", "source_family", "target_family")


def backwards(edges: DataFrame, years: DataFrame) -> DataFrame:
    """Descent against time: (source_id, target_id, child, ancestor) where the ancestor is attested later than the child.

    years (id, first): the first year of a word; words without one are left out.
    """
    y = lambda c, name: years.select(F.col("id").alias(c), F.col("first").alias(name))
    x = edges.filter("relationship_type = 'DESCENDS_FROM'").join(y("source_id", "child"), "source_id").join(y("target_id", "ancestor"), "target_id")
    return x.filter("ancestor > child").select("source_id", "target_id", "child", "ancestor")


def ranked_degree(edges: DataFrame) -> DataFrame:
    """Words by the number of their edges: (id, degree, rank), equal degrees with equal rank."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    ranks = ends.groupBy("degree").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"))))  # different degrees are few
    return ends.join(F.broadcast(ranks.select("degree", "rank")), "degree")
