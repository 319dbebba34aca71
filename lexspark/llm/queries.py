"""The queries of problems 1, 2 and 4 to 10 over the tables of a data folder, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm import canonical, encoding, leakage, lookalike, matching, packing, residue, scans, survivors
from lexspark.sources.tables import table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attestations", "id", "text_excerpt")
    e = table(spark, d, "raw_entries", "entry_id", "form", "etymology")
    x = encoding.garbled(a, ["text_excerpt"], F.col("id"), "attestations")
    return x.unionByName(encoding.garbled(e, ["form", "etymology"], F.col("entry_id"), "raw_entries"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "record_id", "field").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled values with their restored text and whether everything could be restored."""
    return _garbled(spark, d).withColumn("whole", ~F.col("restored").rlike(f"[{encoding.LOST_JAVA}]"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text", "source")).select("doc_id").distinct()


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay: doc_id and length."""
    x = residue.evidence(table(spark, d, "documents", "doc_id", "text", "source", "n_chars"))
    return x.filter("not (placeholder or response or filler or duplicated)").select("doc_id", "n_chars")


def _deviating(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lsr_metadata", "id", "language_code", *lookalike.FORM_FIELDS, *lookalike.PHONETIC_FIELDS)
    return lookalike.deviating(m, table(spark, d, "languages", "iso_code", "script"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _deviating(spark, d).select("lsr_id", "field").distinct()


def p6_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Deviating values with their one consistent form."""
    return _deviating(spark, d)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entries", "entry_id", "language", "language_code")
    return canonical.resolve(e, table(spark, d, "languages"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("not exact").select("entry_id", "iso_code").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entered values without a canonical entry, with their number of rows."""
    x = _resolved(spark, d).filter(F.col("iso_code") == canonical.UNMATCHED)
    return x.groupBy("language", "language_code").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.field_survivors(table(spark, d, "lsr_metadata", *survivors.COLUMNS), table(spark, d, "raw_entries", "entry_id", "definitions")).select("lsr_id", "field").distinct()


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """One record per duplicate group."""
    return survivors.merged(table(spark, d, "lsr_metadata", *survivors.COLUMNS), table(spark, d, "raw_entries", "entry_id", "definitions"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the rule that found them and its confidence."""
    e = table(spark, d, "raw_entries", "entry_id", "form", "form_phonetic", "language", "language_code", "definitions", "part_of_speech")
    m = table(spark, d, "lsr_metadata", "id", "form_orthographic", "form_normalized", "form_phonetic", "language_code", "definition_primary", "part_of_speech")
    return matching.match(e, m, table(spark, d, "languages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("entry_id", "lsr_id").distinct()


def _quotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attestations", "id", "text_excerpt", "text_source", "page_reference")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(_quotations(spark, d)).distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_quotations(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Removal spans in words, overlapping ones of a document merged, with the number of items in them."""
    x = _leaks(spark, d)
    w = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("new", F.when(F.col("first_word") <= before, 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    return x.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.count_distinct("item_id").alias("items"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), table(spark, d, "container_sizes"))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_spans": p9_spans, "p2_found": p2_found, "p2_repaired": p2_repaired, "p5_found": p5_found, "p5_pairs": p5_pairs, "p4_found": p4_found, "p4_merged": p4_merged, "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p6_found": p6_found, "p6_rewritten": p6_rewritten, "p7_found": p7_found, "p7_restored": p7_restored, "p10_found": p10_found, "p10_clean": p10_clean}
SQL: dict[str, str] = {}
