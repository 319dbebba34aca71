"""Functions on dense vectors held as arrays of doubles, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0))))


def drift(a: Column, b: Column) -> Column:
    """1 - cosine over the common length, between 0 and 1; 0 for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cosine(a, b)))
    return F.when(n <= 0, 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def plane(a: Column) -> tuple[Column, Column]:
    """Two coordinates: twice the sums of even and odd places over the length; (0, 0) below two places."""
    n = F.size(a)
    even = F.aggregate(F.filter(a, lambda x, i: i % 2 == 0), F.lit(0.0), lambda s, x: s + x)
    odd = F.aggregate(F.filter(a, lambda x, i: i % 2 == 1), F.lit(0.0), lambda s, x: s + x)
    return tuple(F.when(n < 2, 0.0).otherwise(F.round(v / F.nullif(n, F.lit(0)) * 2, 4) + F.lit(0.0)) for v in (even, odd))


def embedded(text: Column, dims: int = 16) -> Column:
    """A text as a vector without a trained model: each word adds 1 or -1 to the place that its hash gives (dims to 16).

    Null and empty texts give an empty vector.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.struct((F.conv(F.substring(F.md5(w), 1, 1), 16, 10).cast("int") % dims).alias("at"), F.when(F.substring(F.md5(w), 2, 1) < "8", 1.0).otherwise(-1.0).alias("sign")))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(places, F.lit(0.0), lambda s, p: s + F.when(p["at"] == i, p["sign"]).otherwise(0.0)))
    return F.when(F.size(words) > 0, v).otherwise(F.array().cast("array<double>"))
