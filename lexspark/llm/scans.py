"""Noise in text from scanned pages (problem 2).

Three kinds of evidence: words broken at line ends (hyphen evidence), lines at page edges (running headers and page
numbers), and misread characters. For the last, every word gets an anagram hash, the sum of the fifth powers of its
characters; a rare word and a frequent one whose hashes differ by the value of a known confusion are confusable
variants, found by one equi-join for all words. Corrections are ranked by how trustworthy their confusion is: the
share of texts with such words that show other scanning damage, smoothed; confusions below MIN_TRUST are dropped.

Null and blank values are no cases. Line breaks alone and wrong encodings alone are no cases: texts are repaired
from wrong encodings first. Rows delivered twice count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lexspark.llm import encoding
from lexspark.session import bounded_broadcast, written

#: What a scanner reads, and what stands there.
CONFUSIONS = (
    "c>e e>c b>h h>b t>f f>t rn>m m>rn cl>d d>cl ii>u u>ii vv>w w>vv m>in in>m d>el el>d ſ>s i>l l>i l>t t>l n>u u>n li>h h>li o>c c>o e>o o>e a>o o>a "
    "v>y y>v g>q q>g s>f f>s nn>m ni>m m>ni lc>k tl>d j>i i>j r>v v>r k>h h>k v>u u>v ri>n n>ri lo>b ll>u"
)
#: A variant is this many times as frequent as the word that it may stand for.
RATIO = 5
#: Confusions count from this share of otherwise damaged texts on; PRIOR texts without damage are assumed seen.
MIN_TRUST, PRIOR = 0.75, 2.0
MIN_LETTERS = 3
#: Signs inside or at words that no word has.
SYMBOL = (
    r"(?=[0-9@|+$])(?:(?<=\p{L})[0-9@|+$](?=\p{L})|(?<=\p{L}{2})[0-9@|+$](?![\p{L}\d])"
    r"|(?<![\p{L}\d£$,.])(?!\d+(?:st|nd|rd|th)\b|\d+[rv]\b)[0-9@|+$]+\p{L}{2})|(?<=\p{Ll})I|ſ"
)
#: A word broken at a line's end.
BROKEN = r"\p{L}[-‐\x{ad}¬=][ \t]*\n|\x{ad}[ \t]*\n|\p{L}\x{fffd}{1,3}[ \t]*\n"
#: A line with nothing but a page number, with or without ornaments and misread digits.
PAGE_LINE = r"(?i)^[^\p{L}\d]*(?:(?:p|pp|pag|page|fol|f|col|s)[. ]{1,2})?(?=[lOISBZbo]*\d)[\dlOISBZbo]{1,5}[rv]?[^\p{L}\d]*$|^\W*[-—–.\[]\W*[\dlOISBZbo]{1,4}\W*[-—–.\]]\W*$"
#: The ways of writing a page reference.
REFERENCE = r"^(?:\d+|(?:p|col)\. \d+|pp\. \d+[–-]\d+|fol\. \d+[rv]?|§ ?\d+|vol\. \d+, p\. \d+)$"
#: A running header by its form: spaced capitals, capitals throughout, a title with volume or chapter.
HEADER_LINE = r"^(?:\p{Lu} {1,3}){4,}\p{Lu}?$|^\W*\d*\W*(?:\p{Lu}[\p{Lu}'-]+ ?){2,}[\W\d]*$|^(?:\p{Lu}[\p{L}'-]+ ?){2,}, vol\. \d+$|^Chap\. \w+\.?\]"
HEADER_WORDS = r"(?i)\b(?:vol|chap|fol|pag|the)\b"


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, HEADER_WORDS, "")), r"[^\p{L}]", "")


def is_furniture(line: Column, source: Column) -> Column:
    """Whether a line is a page number or a running header with the title of the source, whole, cut off or slightly misread."""
    a, b = _letters(line), _letters(source)
    title = (F.length(a) >= 8) & (F.length(b) >= 8) & (F.startswith(b, a) | (F.startswith(a, b) & (F.length(a) <= F.length(b) + 4)) | (F.levenshtein(a, b) <= 2))
    return line.rlike(PAGE_LINE) | line.rlike(HEADER_LINE) | F.coalesce(title, F.lit(False))


#: Powers are taken modulo this prime at each step, so that no product leaves 64 bits for any code point.
MODULUS = 1_000_000_007


def _power(x: Column) -> Column:
    """The fifth power of a character's code point modulo MODULUS."""
    n = F.ascii(x).cast("bigint")
    square = n * n % MODULUS
    return square * square % MODULUS * n % MODULUS


def _hash(c: Column) -> Column:
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda s, x: s + F.when(x == "", F.lit(0).cast("bigint")).otherwise(_power(x)))


def _py_hash(s: str) -> int:
    return sum(ord(c) ** 5 % MODULUS for c in s)


def prepared(attestations: DataFrame) -> DataFrame:
    """One row per id: text repaired from wrong encodings, the damage seen in it alone, and its distinct words."""
    x = attestations.filter("id is not null").dropDuplicates(["id"])
    x = x.withColumn("text", encoding.repaired(F.col("text_excerpt"))).withColumn("ref", F.trim(encoding.repaired(F.col("page_reference"))))
    lines = F.contains(F.col("text"), F.lit("\n"))
    x = x.withColumn("broken", lines & F.col("text").rlike(BROKEN))
    x = x.withColumn("furniture", F.when(lines, F.exists(F.split("text", "\n"), lambda s: is_furniture(s, F.col("text_source")))).otherwise(False))
    x = x.withColumn("symbol", F.col("text").rlike(SYMBOL))
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    bad_ref = F.coalesce((F.col("ref") != "") & ~F.col("ref").rlike(REFERENCE), F.lit(False))
    return x.select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("broken", "furniture", "symbol")], bad_ref.alias("bad_ref"), words.alias("words"))


def corrections(x: DataFrame) -> DataFrame:
    """(word, right, trust): the best trusted correction of each misread word. x: prepared texts."""
    damaged = (F.col("broken") | F.col("furniture") | F.col("symbol")).cast("int")
    words = x.select(damaged.alias("d"), F.explode("words").alias("word")).filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n"), F.sum("d").alias("d"))
    words = written(words.withColumn("h", _hash(F.col("word"))))
    kinds = [k.split(">") for k in CONFUSIONS.split()]
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(_py_hash(b) - _py_hash(a)).cast("bigint").alias("delta")) for a, b in kinds])
    rare = words.select("word", "n", "d", "h", F.explode(F.filter(options, lambda o: F.contains(F.col("word"), o["a"]))).alias("o")).select("word", "n", "d", "o.a", "o.b", (F.col("h") + F.col("o.delta")).alias("h"))
    pairs = rare.join(words.select("h", F.col("word").alias("right"), F.col("n").alias("m")), "h").filter(F.col("m") >= F.col("n") * RATIO)
    # equal hashes mean equal letters; the exchange must also be at one place
    one = F.expr("exists(sequence(1, length(word) - length(a) + 1), j -> substr(word, j, length(a)) = a and right = concat(substr(word, 1, j - 1), b, substr(word, j + length(a))))")
    pairs = pairs.filter(one)
    ratio = F.col("m") / F.col("n")
    pairs = pairs.withColumn("bucket", F.when(ratio < 10, 0).when(ratio < 50, 1).when(ratio < 500, 2).otherwise(3)).withColumn("long", F.length("word") >= 5)
    pairs = written(pairs)
    by = ["a", "b", "bucket", "long"]
    trust = pairs.groupBy(*by).agg((F.sum("d") / (F.sum("n") + PRIOR)).alias("trust")).filter(F.col("trust") >= MIN_TRUST)
    good = pairs.join(F.broadcast(trust), by)  # at most eight rows a confusion
    return good.groupBy("word").agg(F.max(F.struct("trust", "m", "right")).alias("x")).select("word", "x.right", "x.trust")


def damage(attestations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepared texts with `misread`, and (id, word, right) of the misread words."""
    x = written(prepared(attestations))
    fixes = bounded_broadcast(written(corrections(x)))
    hits = x.select("id", F.explode("words").alias("word")).join(fixes, "word").select("id", "word", "right")
    return x.drop("words"), hits


def found(attestations: DataFrame) -> DataFrame:
    """(attestation_id, field)"""
    x, hits = damage(attestations)
    seen = x.filter("broken or furniture or symbol").select("id").unionByName(hits.select("id")).distinct()
    text = seen.select(F.col("id").alias("attestation_id"), F.lit("text_excerpt").alias("field"))
    return text.unionByName(x.filter("bad_ref").select(F.col("id").alias("attestation_id"), F.lit("page_reference").alias("field")))


_PAGE = re.compile(PAGE_LINE.replace(r"[^\p{L}\d]", r"[\W_]"))
_HEADER = re.compile(HEADER_LINE.replace(r"\p{Lu}", r"A-Z").replace("A-Z {1,3}", "[A-Z] {1,3}").replace("A-Z?$", "[A-Z]?$").replace("(?:A-Z[A-Z'-]+", "(?:[A-Z][A-Z'-]+").replace("(?:A-Z[\\p{L}'-]+", "(?:[A-Z][\\w'-]+"))
_SIGNS = str.maketrans("0135690@|+$ſ", "olesbgoaitss")


def _skeleton(s: str) -> str:
    return "".join(c for c in re.sub(HEADER_WORDS, "", s).lower() if c.isalpha())


def rebuilt(text: str, source: str | None, fixes: dict[str, str]) -> str:
    """The text as continuous paragraphs: edge lines out, broken words joined, misread words corrected."""
    title = _skeleton(source or "")
    keep = []
    for line in text.split("\n"):
        own = _skeleton(line)
        header = len(own) >= 8 and len(title) >= 8 and (title.startswith(own) or own.startswith(title) and len(own) <= len(title) + 4)
        if not (header or _PAGE.search(line) or _HEADER.search(line)):
            keep.append(line)
    text = "\n".join(keep)
    text = re.sub("(?<=[^\\W\\d_])[-‐\xad¬=][ \t]*\n\\s*", "", text)
    text = re.sub(r"\s*\n\s*", " ", text).replace("\xad", "")

    def word(m: re.Match) -> str:
        w = m.group()
        w = re.sub(r"(?<=[a-zà-ÿ])I+", lambda i: "l" * len(i.group()), w)
        y = fixes.get(w.lower())
        if y is None and re.search(r"[0-9@|+$ſ]", w) and re.search(r"[^\W\d_]", w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|[rv])", w):
            y = w.translate(_SIGNS)
        return w if y is None else y.capitalize() if w[:1].isupper() else y

    return re.sub(r"[\w@|+$]*[^\W\d_][\w@|+$]*", word, text).strip()


def repaired(attestations: DataFrame) -> DataFrame:
    """(attestation_id, text): every damaged text as continuous readable text."""
    @pandas_udf(StringType())
    def rebuild(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sources, fixes in it:
            yield pd.Series([rebuilt(t, s, dict(p.split("\t") for p in f.split("\n") if p)) for t, s, f in zip(texts, sources, fixes)], dtype=object)

    x, hits = damage(attestations)
    fixes = hits.groupBy("id").agg(F.array_join(F.collect_set(F.concat_ws("\t", "word", "right")), "\n").alias("fixes"))
    flagged = x.filter("broken or furniture or symbol").select("id").unionByName(hits.select("id")).distinct().join(fixes, "id", "left")
    texts = attestations.dropDuplicates(["id"]).select("id", "text_source", encoding.repaired(F.col("text_excerpt")).alias("text"))
    y = texts.join(flagged, "id").filter("text is not null")
    return y.select(F.col("id").alias("attestation_id"), rebuild("text", "text_source", F.coalesce("fixes", F.lit(""))).alias("text"))
