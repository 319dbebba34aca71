"""Functions on lists, maps and stored values: Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lexspark.functions.text import sanitized


@pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(c: Column) -> Column:
    """Composed letters (NFC). Text of letters up to U+02FF, which are composed already, stays in the JVM."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x{00}-\x{2ff}]"), c)), c)


def sanitized_list(c: Column, most: int = 100, length: int = 1000) -> Column:
    """The first `most` values sanitized, without empty ones."""
    return F.filter(F.transform(F.slice(c, 1, most), lambda x: sanitized(x, length)), lambda x: x != "")


def cache_key(prefix: str, *columns: str) -> Column:
    """A prefix and 16 hex digits of the MD5 of the named values as JSON, names in order; nulls are left out."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.md5(F.to_json(F.struct(*sorted(columns)))), 1, 16))


def chunk_of(position: Column, size: int) -> Column:
    """The number of the chunk of a position, both from 0."""
    return F.floor(position / size).cast("bigint")


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps of strings as one; values of b win, nulls are empty maps."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def json_value(c: Column, path: str) -> Column:
    """A value of a JSON text by its path; null where there is none."""
    return F.get_json_object(c, path)
