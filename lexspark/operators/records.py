"""Lexical records: search, projections for sinks, confidence, widening, merging, entry conversion.

All functions are lazy DataFrame transformations; nulls are kept unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import normal_form


def search(lsr: DataFrame, form: str | None = None, language: str | None = None, date_start: int | None = None, date_end: int | None = None, mode: str = "containment") -> DataFrame:
    """Filter by part of a form, language and period; an absent argument doesn't filter, an open period always passes.

    mode "containment" wants the record's period inside the asked one, "overlap" wants both known and overlapping.
    """
    if form is not None:
        lsr = lsr.filter(F.contains(F.col("form_normalized"), normal_form(F.lit(form))) | F.contains(F.col("form_orthographic"), F.lit(form)))
    if language is not None:
        lsr = lsr.filter(F.col("language_code") == language)
    s, e = F.col("date_start"), F.col("date_end")
    if mode == "overlap":
        known = s.isNotNull() & e.isNotNull()
        lsr = lsr.filter(known & ~((e < (date_start if date_start is not None else -10_000)) | (s > (date_end if date_end is not None else 10_000))))
    else:
        if date_start is not None:
            lsr = lsr.filter(s.isNull() | (s >= date_start))
        if date_end is not None:
            lsr = lsr.filter(e.isNull() | (e <= date_end))
    return lsr


def page(x: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Search order: confidence, form, id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return x.orderBy(F.desc_nulls_first("confidence_overall"), "form_orthographic", "id").offset(offset).limit(limit)


def graph_node(lsr: DataFrame) -> DataFrame:
    """The projection for the property graph."""
    return lsr.select(
        "id", F.col("form_orthographic").alias("form"), "form_normalized", "language_code", "period_label", "date_start", "date_end",
        F.col("definition_primary").alias("definition"), F.col("confidence_overall").alias("confidence"), F.col("reconstruction_flag").alias("reconstruction"),
    )


def search_document(lsr: DataFrame) -> DataFrame:
    """The projection for a search index, one JSON text per record."""
    fields = ["id", "form_orthographic", "form_phonetic", "form_normalized", "language_code", "period_label", "date_start", "date_end", "definition_primary", "part_of_speech", "semantic_fields", "source_databases", "confidence_overall", "reconstruction_flag", "human_validated"]
    return lsr.select("id", F.to_json(F.struct(*fields)).alias("document"))


def graph_edge(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "relationship_type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def n_triples(lsr: DataFrame, base: str = "urn:lsr:") -> DataFrame:
    """One N-Triples line per record and known field."""
    def esc(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    parts = [F.struct(F.lit(f).alias("p"), F.col(f).cast("string").alias("o")) for f in ("form_orthographic", "language_code", "definition_primary", "date_start")]
    x = lsr.select("id", F.explode(F.array(*parts)).alias("x")).filter("x.o is not null")
    return x.select(F.concat(F.lit(f"<{base}"), "id", F.lit(f"> <{base}"), "x.p", F.lit('> "'), esc(F.col("x.o")), F.lit('" .')).alias("line"))


def confidence(date_confidence: Column, attestations: Column, reconstructed: Column, validated: Column) -> Column:
    """Mean of the scores that apply: date, attestation count, reconstruction, validation."""
    att = F.when(attestations > 0, F.least(F.lit(1.0), 0.1 * attestations + 0.5)).otherwise(0.3)
    scores = F.filter(F.array(date_confidence, att, F.when(reconstructed, 0.6), F.when(validated, 1.0)), lambda x: x.isNotNull())
    return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)


def attestation_facts(attestations: DataFrame, key: Column) -> DataFrame:
    """(lsr_id, n, first, last): attestation counts and years; partial sums first, so a frequent record is no hot spot."""
    return attestations.select(key.alias("lsr_id"), "text_date").filter("lsr_id is not null").groupBy("lsr_id").agg(F.count("*").alias("n"), F.min("text_date").alias("first"), F.max("text_date").alias("last"))


def widened(lsr: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, date_start, date_end, attestations, confidence): periods widened to the attested years."""
    x = lsr.join(facts, lsr["id"] == facts["lsr_id"], "left")
    n = F.coalesce("n", F.lit(0))
    c = confidence(F.col("date_confidence"), n, F.coalesce("reconstruction_flag", F.lit(False)), F.coalesce("human_validated", F.lit(False)))
    return x.select("id", F.least("date_start", "first").alias("date_start"), F.greatest("date_end", "last").alias("date_end"), n.alias("attestations"), F.round(c, 6).alias("confidence"))


def merged(lsr: DataFrame, key: list[str]) -> DataFrame:
    """Records of one key as one: smallest id, widest period, all sources, other definitions as alternates, version."""
    g = lsr.groupBy(*key).agg(
        F.min("id").alias("id"), F.min("date_start").alias("date_start"), F.max("date_end").alias("date_end"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_databases")))).alias("sources"),
        F.min_by("definition_primary", F.struct("created_at", "id")).alias("definition"), F.array_sort(F.collect_set("definition_primary")).alias("every"), F.count("*").alias("version"),
    )
    return g.select(*key, "id", "date_start", "date_end", F.array_join("sources", "|").alias("sources"), "definition", F.size(F.filter("every", lambda x: x != F.coalesce("definition", F.lit("")))).alias("alternates"), "version")


def from_entries(entries: DataFrame) -> DataFrame:
    """Entries as records: first definition primary, the rest alternate; a year of 0 is no year."""
    year = F.when(F.col("date_attested") != 0, F.col("date_attested"))
    return entries.select(
        "entry_id", F.col("form").alias("form_orthographic"), normal_form(F.col("form")).alias("form_normalized"), "language_code", F.try_element_at("definitions", F.lit(1)).alias("definition_primary"),
        F.greatest(F.coalesce(F.size("definitions"), F.lit(0)) - 1, F.lit(0)).alias("alternates"), year.alias("date_start"), year.alias("date_end"), F.col("source_name").alias("source_database"),
    )


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry per source id and content hash, the first fetched."""
    h = F.sha2(F.concat_ws("\x1f", "form", "language", "etymology"), 256)
    return entries.withColumn("content_hash", h).groupBy("source_name", "source_id", "content_hash").agg(F.min(F.struct("fetched_at", "entry_id")).alias("x"), F.count("*").alias("deliveries")).select("source_name", "source_id", "content_hash", F.col("x.entry_id").alias("entry_id"), "deliveries")
