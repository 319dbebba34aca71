"""Sources of entries: paged adapters, cross-linguistic data tables, dated corpora, reference data, exports.

An adapter is anything with count() and fetch(offset, limit); AdapterSource reads it in parallel, a batch a partition.
Rows that an adapter can't read are skipped one by one and counted by no one else: they come out as null keys nowhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexspark.functions.text import ascii_words
from lexspark.schema import SEED_LANGUAGES


class WordList:
    """A text file with one JSON object a line, read by slices; broken lines are skipped."""

    def __init__(self, path: str) -> None:
        self.path = path

    def count(self) -> int:
        with open(self.path, encoding="utf-8") as f:
            return sum(1 for _ in f)

    def fetch(self, offset: int, limit: int) -> Iterator[tuple[str, str]]:
        """(title, the line) of the lines from offset on."""
        with open(self.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if i >= offset + limit:
                    break
                if i >= offset:
                    try:
                        yield str(json.loads(line)["title"]), line.rstrip("\n")
                    except (ValueError, KeyError, TypeError):
                        continue


class ParquetRows:
    """A Parquet file whose column is read by slices of row groups."""

    def __init__(self, path: str, column: str) -> None:
        self.path, self.column = path, column

    def count(self) -> int:
        import pyarrow.parquet as pq

        return pq.ParquetFile(self.path).metadata.num_rows

    def fetch(self, offset: int, limit: int) -> Iterator[tuple[str, str]]:
        """(row number, value as text); only the row groups that the slice touches are read."""
        import pyarrow.parquet as pq

        file, start = pq.ParquetFile(self.path), 0
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if start < offset + limit and start + n > offset:
                values = file.read_row_group(g, columns=[self.column]).column(0)
                for i in range(max(0, offset - start), min(n, offset + limit - start)):
                    if (v := values[i].as_py()) is not None:
                        yield str(start + i), str(v)
            start += n


class AdapterSource(DataSource):
    """spark.read.format("adapter"): options path, column (for Parquet), batch_size, and the slice offset and limit."""

    @classmethod
    def name(cls) -> str:
        return "adapter"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        o = self.options
        adapter = ParquetRows(o["path"], o["column"]) if "column" in o else WordList(o["path"])
        return _AdapterReader(adapter, int(o.get("batch_size", 1000)), int(o.get("offset", 0)), int(o["limit"]) if "limit" in o else None)


class _Slice(InputPartition):
    def __init__(self, offset: int, limit: int) -> None:
        self.offset, self.limit = offset, limit


class _AdapterReader(DataSourceReader):
    def __init__(self, adapter: WordList | ParquetRows, batch: int, offset: int, limit: int | None) -> None:
        self.adapter, self.batch, self.offset, self.limit = adapter, max(1, batch), offset, limit

    def partitions(self) -> list[_Slice]:
        end = self.adapter.count() if self.limit is None else min(self.adapter.count(), self.offset + self.limit)
        return [_Slice(o, min(self.batch, end - o)) for o in range(self.offset, end, self.batch)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.adapter.fetch(partition.offset, partition.limit)


def scan(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(AdapterSource)
    return spark.read.format("adapter").options(path=path, **options).load()


def cross_linguistic(forms: DataFrame, languages: DataFrame, parameters: DataFrame) -> DataFrame:
    """Entries of cross-linguistic data tables: forms (ID, Language_ID, Parameter_ID, Form), languages (ID, Name, ISO639P3code),
    parameters (ID, Name). Forms of unknown languages or concepts stay, with nulls there.
    """
    x = forms.join(F.broadcast(languages.select(F.col("ID").alias("Language_ID"), F.col("Name").alias("language"), F.col("ISO639P3code").alias("language_code"))), "Language_ID", "left")
    x = x.join(parameters.select(F.col("ID").alias("Parameter_ID"), F.col("Name").alias("concept")), "Parameter_ID", "left")
    return x.select(F.lit("cldf").alias("source_name"), F.concat(F.lit("cldf-"), "ID").alias("source_id"), F.col("Form").alias("form"), "language", "language_code", F.array_compact(F.array("concept")).alias("definitions"))


def corpus_entries(docs: DataFrame, least: int = 2) -> DataFrame:
    """Words of a dated corpus (lang, text, year) as entries: (source_id, form, language_code, date_attested, uses) of the words
    used at least so often, with the first year.
    """
    x = docs.filter("year is not null").select("lang", "year", F.explode(ascii_words(F.col("text"))).alias("form"))
    g = x.groupBy("lang", "form").agg(F.min("year").alias("date_attested"), F.count("*").alias("uses")).filter(F.col("uses") >= least)
    return g.select(F.concat_ws("-", F.lit("corpus"), "lang", "form").alias("source_id"), "form", F.col("lang").alias("language_code"), "date_attested", "uses")


def reference_languages(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(iso_code, name): the languages loaded first and the known ones; a code once, the known name before the seed's."""
    seed = spark.createDataFrame(SEED_LANGUAGES, "iso_code string, name string").withColumn("rank", F.lit(1))
    x = seed if known is None else seed.unionByName(known.select("iso_code", "name", F.lit(0).alias("rank")))
    return x.groupBy("iso_code").agg(F.min(F.struct("rank", "name")).alias("x")).select("iso_code", "x.name")


def json_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("line"))


def csv_lines(records: DataFrame) -> DataFrame:
    """One line a record, every value in quotes; null is an empty value without."""
    def cell(c: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    return records.select(F.concat_ws(",", *[cell(c) for c in records.columns]).alias("line"))


def weekly(records: DataFrame, at: str) -> DataFrame:
    """(week, rows, last): the parts of a weekly dump by the Monday of a time column; nulls aside."""
    w = F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")
    return records.filter(F.col(at).isNotNull()).groupBy(w.alias("week")).agg(F.count("*").alias("rows"), F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss").alias("last"))


def dump(records: DataFrame, at: str, folder: str) -> None:
    """The dump itself: one folder a week, so that a later run adds or replaces whole weeks."""
    records.withColumn("week", F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")).write.mode("overwrite").partitionBy("week").parquet(folder)
