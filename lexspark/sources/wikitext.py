"""Wikitext pages (title, wikitext) as raw entries, by built-in functions only.

Text before the first level-2 heading is ignored; a section's language decides its code. Null texts give no entries.
Also here: etymology templates and phrases as candidate edges, and a Python data source that pages any adapter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexspark.schema import HEADING_CODES, PARTS_OF_SPEECH


def cleaned(c: Column) -> Column:
    """Without templates, link targets and quotes of emphasis."""
    x = F.regexp_replace(c, r"\{\{[^}]*\}\}", "")
    x = F.regexp_replace(x, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(x, "'{2,3}", ""))


def year_of(c: Column) -> Column:
    """First year of the first century named, else the least four-digit year from 800 to 2100, else null."""
    century = F.nullif(F.regexp_extract(c, r"(\d{1,2})(?:st|nd|rd|th) century", 1), F.lit("")).cast("int")
    years = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: (y >= 800) & (y <= 2100))
    return F.coalesce((century - 1) * 100 + 1, F.array_min(years))


def sections(pages: DataFrame) -> DataFrame:
    """(title, language, content) of every level-2 section."""
    heading = r"(?m)^==\s*([^=\n]+?)\s*==[ \t]*$"
    x = pages.filter("wikitext is not null").select("title", F.regexp_extract_all("wikitext", F.lit(heading), F.lit(1)).alias("h"), F.split("wikitext", heading).alias("c"))
    # the pieces are one more than the headings: the first comes before them
    x = x.select("title", F.explode(F.arrays_zip(F.col("h"), F.slice("c", F.lit(2), F.greatest(F.lit(0), F.size("c") - 1)).alias("c"))).alias("s"))
    return x.select("title", F.trim("s.h").alias("language"), F.coalesce("s.c", F.lit("")).alias("content"))


def entries(pages: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(title, source_id, language, language_code, form_phonetic, etymology, definitions, part_of_speech, date_attested)."""
    x = sections(pages)
    if languages:
        x = x.filter(F.col("language").isin(*languages))
    codes = F.create_map(*[F.lit(v) for pair in HEADING_CODES.items() for v in pair])
    code = F.coalesce(F.try_element_at(codes, F.col("language")), F.lower(F.substring("language", 1, 3)))
    c = F.col("content")
    section = F.regexp_extract(c, r"(?s)===+\s*Etymology[^=]*===+\s*\n(.*?)(?=\n==|\z)", 1)
    lines = F.slice(F.regexp_extract_all(c, F.lit(r"(?m)^#\s+([^#\n*:][^\n]*)"), F.lit(1)), 1, 10)
    defs = F.filter(F.transform(lines, cleaned), lambda d: F.length(d) > 2)
    pos = F.filter(F.array(*[F.when(c.rlike(rf"(?im)^===+\s*{p}\s*===+"), F.lit(p.lower())) for p in PARTS_OF_SPEECH]), lambda p: p.isNotNull())
    return x.select(
        "title", F.concat(F.lit("wikt-"), "title", F.lit("-"), code).alias("source_id"), "language", code.alias("language_code"),
        F.nullif(F.regexp_extract(c, r"\{\{IPA\|[^|]*\|/([^/]+)/", 1), F.lit("")).alias("form_phonetic"), F.nullif(cleaned(section), F.lit("")).alias("etymology"),
        F.when(F.size(defs) > 0, defs).otherwise(F.array(F.lit("(definition not extracted)"))).alias("definitions"), pos.alias("part_of_speech"), year_of(c).alias("date_attested"),
    )


def template_edges(pages: DataFrame) -> DataFrame:
    """Candidate edges (title, relationship_type, language_code, form) of etymology templates."""
    kinds = F.create_map(*[F.lit(v) for v in ("inh", "DESCENDS_FROM", "bor", "BORROWED_FROM", "cog", "COGNATE_OF", "der", "DESCENDS_FROM")])
    # cognates name their language first, the others the language of the page before it
    found = F.regexp_extract_all("wikitext", F.lit(r"\{\{(?:inh|bor|der|cog)\|[^}]*\}\}"), F.lit(0))
    x = pages.select("title", F.explode(found).alias("t")).select("title", F.split(F.regexp_replace("t", r"[{}]", ""), r"\|").alias("p"))
    kind = F.col("p")[0]
    first = F.when(kind == "cog", 1).otherwise(2)
    return x.select("title", kinds[kind].alias("relationship_type"), F.try_element_at("p", first + 1).alias("language_code"), F.try_element_at("p", first + 2).alias("form")).filter("form is not null")


class PagedSource(DataSource):
    """spark.read.format("paged"): a source that is read in batches by offset; option `count` and `batch_size`.

    Stands for an adapter with fetch(offset, limit): each batch is a partition, so a full scan is parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "offset bigint, key string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _PagedReader(int(self.options.get("count", 0)), int(self.options.get("batch_size", 1000)))


class _Batch(InputPartition):
    def __init__(self, offset: int, limit: int) -> None:
        self.offset, self.limit = offset, limit


class _PagedReader(DataSourceReader):
    def __init__(self, count: int, batch: int) -> None:
        self.count, self.batch = count, max(1, batch)

    def partitions(self) -> list[_Batch]:
        return [_Batch(o, min(self.batch, self.count - o)) for o in range(0, self.count, self.batch)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for i in range(partition.offset, partition.offset + partition.limit):
            yield i, f"item-{i}"
