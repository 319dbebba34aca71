"""Queries of scalar functions that no other query uses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import collections as C
from lexspark.functions import phonetics as P
from lexspark.sources.tables import table

_M = lambda s, d, *c: table(s, d, "lsr_metadata", "id", *c)
_E = lambda s, d, *c: table(s, d, "raw_entries", "entry_id", *c)


def chunks(s, d):
    """Records of each language in chunks of 100 in order of id, with their sizes."""
    w = Window.partitionBy("language_code").orderBy("id")
    x = _M(s, d, "language_code").select("language_code", C.chunk_of(F.row_number().over(w) - 1, 100).alias("chunk"))
    return x.groupBy("language_code", "chunk").agg(F.count("*").alias("n"))


def merged_raw_data(s, d):
    """The names in each entry's raw data after two more were merged into it."""
    more = F.create_map(F.lit("page"), F.lit("0"), F.lit("kept"), F.lit("1"))
    m = C.merged_maps(F.from_json("raw_data", "map<string,string>"), more)
    return _E(s, d, "raw_data").select("entry_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


def ascii_words_of(c):
    return F.regexp_replace(c, "[^A-Za-z]", "")


QUERIES = {
    "composed_forms": lambda s, d: _M(s, d, "form_phonetic", "form_normalized").select("id", C.composed(F.col("form_phonetic")).alias("phonetic"), C.composed(F.col("form_normalized")).alias("normalized")),
    "sanitized_lists": lambda s, d: _E(s, d, "definitions").select("entry_id", F.array_join(C.sanitized_list(F.col("definitions"), 2, 40), "|").alias("definitions")),
    "cache_keys": lambda s, d: _E(s, d, "form", "language").filter("form is not null and language is not null").select("entry_id", C.cache_key("entry", "language", "form").alias("key")),
    "chunks": chunks,
    "merged_raw_data": merged_raw_data,
    "stored_values": lambda s, d: _M(s, d, "part_of_speech", "date_start").filter("size(part_of_speech) > 0").select("id", F.to_json(F.struct("part_of_speech", "date_start")).alias("v")).select("id", C.json_value(F.col("v"), "$.part_of_speech[0]").alias("first"), C.json_value(F.col("v"), "$.date_start").alias("date")),
    "sound_codes": lambda s, d: _M(s, d, "form_normalized").select("id", P.code(F.col("form_normalized")).alias("code")),
    "sound_distances": lambda s, d: _M(s, d, "form_phonetic", "form_normalized").select("id", F.round(P.distance(ascii_words_of(F.col("form_phonetic")), ascii_words_of(F.col("form_normalized"))), 6).alias("distance")),
}
_S = "replace(replace(replace(replace(replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_A = lambda c: f"regexp_replace({c}, '[^A-Za-z]', '', 'g')"
SQL = {
    "composed_forms": "select id, nfc_normalize(form_phonetic) as phonetic, nfc_normalize(form_normalized) as normalized from lsr_metadata",
    "sanitized_lists": f"with x as (select entry_id, list_transform(definitions[1:2], lambda t: substr({_S}, 1, 40)) as l from raw_entries) select entry_id, case when l is not null then coalesce(array_to_string(list_filter(l, lambda t: t <> ''), '|'), '') end as definitions from x",
    "cache_keys": "select entry_id, 'entry:' || substr(md5('{\"form\":' || to_json(form)::varchar || ',\"language\":' || to_json(language)::varchar || '}'), 1, 16) as key from raw_entries where form is not null and language is not null",
    "chunks": "with x as (select language_code, (row_number() over (partition by language_code order by id) - 1) // 100 as chunk from lsr_metadata) select language_code, chunk, count(*) as n from x group by all",
    "merged_raw_data": "select entry_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(json_keys(raw_data), []), ['page', 'kept']))), ',') as keys from raw_entries",
    "stored_values": "select id, part_of_speech[1] as first, date_start::varchar as date from lsr_metadata where len(part_of_speech) > 0",
    "sound_distances": f"with x as (select id, {_A('form_phonetic')} as a, {_A('form_normalized')} as b from lsr_metadata) select id, round(case when greatest(length(a), length(b)) = 0 then 0.0 else levenshtein(a, b) / greatest(length(a), length(b)) end, 6) as distance from x",
}
