"""Visually identical text with different characters (problem 6).

Look-alike classes are the connected components (union-find) of strings and code points that look the same: a
composed letter and its parts, a compatibility form and its plain form, and homoglyphs of other scripts, all
transitively (a Cyrillic letter with a combining accent joins the composed Latin letter). In each context (the
script of the record's language, or the phonetic alphabet) the most frequent eligible member stands for its
class, by counts over all values. A multi-pattern automaton rewrites values greedily, leftmost longest first.
Invisible characters vanish, every kind of space becomes a plain one between words.

Null values and stand-ins for a missing pronunciation are no cases; an unknown language takes the script that
most letters of the value have. Empty tables give no classes and no cases.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Letters of different scripts that look the same, one group a word.
HOMOGLYPHS = (
    "aаα eе oоο pрρ cсϲ xхχ yуу iіιı jјϳ sѕ hһ dԁ qԛ wԝ vνѵ uυ kκ nη tτ bЬ rг mм lӏ gɡ "
    "AАΑ BВΒ EЕΕ KКΚ MМΜ HНΗ OОΟ PРΡ CСϹ TТΤ XХΧ YУΥ IІΙӀ JЈ SЅ ZΖ NΝ FϜ QԚ WԜ DꓓᎠ GԌ LᏞ VѴᏙ RᏒ "
    "ɛεԑєɜ θөѳϴ əәǝ ɔͻᴐ ʃ∫ ˈ'ʹ′’ʼ ː:꞉ ˌ, ɾᴦ ɪᴉ ʊᴜ ŋŋ ɑ⍺ æӕ ðծ ɣɤ øөꬾ κк γᵞ φɸф β ßꞵ иᴎ пπᴨ лᴧ дᴅ вʙ нʜ"
)
#: Pairs of that list that are separate letters inside one alphabet stay apart there, as no member is rewritten
#: that is itself frequent in its context: from this share of the class's count on.
OWN_LETTER = 0.2
#: Stand-ins for a missing pronunciation.
STAND_INS = frozenset(("", "n/a", "//", "-", "[?]", "?", "—", "–", "none", "null", "tbd", "/", "[]", "...", "N/A", "unknown"))
FORM_FIELDS, PHONETIC_FIELDS = ("form_orthographic", "form_normalized"), ("form_phonetic",)
PHONETIC = "phonetic"
#: Alphabets by the beginning of their letters' Unicode names.
NAMES = {"latin": ("LATIN ",), "greek": ("GREEK ",), "cyrillic": ("CYRILLIC ",), PHONETIC: ("LATIN ", "MODIFIER LETTER ", "GREEK SMALL LETTER THETA", "GREEK SMALL LETTER BETA", "GREEK SMALL LETTER CHI", "TIE", "COMBINING ")}


def invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc", "Cs", "Co") and c not in "\t\n\r" or c == "͏"


def space(c: str) -> bool:
    return c.isspace()


def in_alphabet(c: str, context: str) -> bool:
    """Whether a letter or mark belongs to the context by its name; other characters belong everywhere if ASCII."""
    kind = unicodedata.category(c)[0]
    if context == PHONETIC and ord(c) > 0xFF00:
        return False
    if kind in "LM":
        name = unicodedata.name(c, "")
        if "FULLWIDTH" in name or "MATHEMATICAL" in name:
            return False
        return name.startswith(NAMES[context]) or (kind == "M" and name.startswith("COMBINING"))
    return c < "\x80"


def compatible(c: str) -> str:
    """The plain form of a compatibility character that looks like it: of another width, font or ligature, but not raised or lowered."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    return c if kind in ("<super>", "<sub>", "<fraction>", "<circle>", "<square>") else unicodedata.normalize("NFKC", c)


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def classes(chars: set[str]) -> list[set[str]]:
    """Classes of look-alike strings over the given characters and those that they lead to."""
    u = UnionFind()
    groups = [set(g) for g in HOMOGLYPHS.split()]
    for g in groups:
        first, *rest = sorted(g)
        for c in rest:
            u.union(first, c)
    every = set(chars) | {c for g in groups for c in g}
    for c in list(every):
        plain = compatible(c)
        if plain != c and not invisible(c) and not space(c):
            u.union(c, plain)
            every.update(plain)
    marks = {c for c in every if unicodedata.combining(c)} | {d for c in every for d in unicodedata.normalize("NFD", c)[1:]}
    alike = defaultdict(set)
    for c in every:
        if len(c) == 1:
            alike[u.find(c)].add(c)
    # accents: any look-alike of the base with the same mark is one class, composed where such a letter exists
    for base in sorted(c for c in every if unicodedata.category(c)[0] == "L"):
        for m in sorted(marks):
            s = base + m
            one = unicodedata.normalize("NFC", s)
            others = [x for b in alike[u.find(base)] for x in (b + m, unicodedata.normalize("NFC", b + m))]
            if len(one) == 1 or any(len(x) == 1 for x in others):
                for x in (one, *others):
                    u.union(s, x)
    found = defaultdict(set)
    for x in u.up:
        found[u.find(x)].add(x)
    return [g for g in found.values() if len(g) > 1]


def rewrites(counts: dict[str, dict[str, int]]) -> dict[str, dict[str, str]]:
    """By context: what each look-alike string is rewritten to.

    A member is eligible if its letters belong to the context and it is composed; of those the most frequent
    represents the class, at equal counts the smallest code point.
    """
    all_chars = {c for n in counts.values() for c in n}
    out: dict[str, dict[str, str]] = {}
    groups = classes(all_chars)
    for context, n in counts.items():
        rules = {c: "" for c in all_chars if invisible(c)} | {c: " " for c in all_chars if space(c) and c != " "}
        for g in groups:
            own = [x for x in g if unicodedata.normalize("NFC", x) == x and all(compatible(c) == c and in_alphabet(c, context) for c in x)]
            own = [x for x in own if len(x) == 1] or own
            if not own:
                continue
            best = min(own, key=lambda x: (-sum(n.get(c, 0) for c in x), x))
            total = sum(n.get(x, 0) for x in own if len(x) == 1)
            for x in g - {best}:
                if not (x in own and n.get(x, 0) > OWN_LETTER * total):
                    # an unseen spelling never replaces one that the context has itself
                    if n.get(best, 0) or x not in own:
                        rules[x] = best
        out[context] = rules
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton."""

    def __init__(self, rules: dict[str, str], context: str) -> None:
        self.rules, self.context = rules, context
        self.firsts = {x[0] for x in rules} | {x[-1] for x in rules if len(x) > 1}
        self.auto = ahocorasick.Automaton()
        for x, y in rules.items():
            self.auto.add_word(x, (len(x), y))
        if rules:
            self.auto.make_automaton()

    def __call__(self, text: str) -> str:
        if self.rules and not self.firsts.isdisjoint(text):
            out, at = [], 0
            for end, (n, y) in self.auto.iter_long(text):
                start = end - n + 1
                if start >= at:
                    out.append(text[at:start])
                    out.append(y)
                    at = end + 1
            out.append(text[at:])
            text = "".join(out)
        return " ".join(unicodedata.normalize("NFC", text).split())

    def strange(self, text: str) -> bool:
        """Whether letters of another alphabet remain."""
        return any(c > "\x7f" and not in_alphabet(c, self.context) for c in text)


def majority_script(text: str) -> str:
    n = Counter(s for c in text for s in ("latin", "greek", "cyrillic") if c.isalpha() and in_alphabet(c, s))
    return n.most_common(1)[0][0] if n else "latin"


def character_counts(values: DataFrame) -> dict[str, dict[str, int]]:
    """Counts by context and character over all rows of (context, value). Bounded by the size of Unicode."""
    x = values.filter("value is not null and context is not null").select("context", F.explode(F.split("value", "")).alias("c")).filter("c <> ''")
    out: dict[str, dict[str, int]] = {k: {} for k in NAMES}
    for r in x.groupBy("context", "c").count().collect():
        out.setdefault(r["context"], {})[r["c"]] = r["count"]
    return out


def field_values(records: DataFrame, languages: DataFrame) -> DataFrame:
    """(lsr_id, field, context, value) of all three fields; languages is the fixed canonical list, hence broadcast."""
    scripts = F.broadcast(languages.select(F.col("iso_code").alias("language_code"), "script").dropDuplicates(["language_code"]))
    records = records.select("id", "language_code", *FORM_FIELDS, *PHONETIC_FIELDS)
    x = records.join(scripts, "language_code", "left")

    def part(f: str, context: Column) -> Column:
        return F.struct(F.lit(f).alias("field"), context.alias("context"), F.col(f).alias("value"))

    parts = [part(f, F.col("script")) for f in FORM_FIELDS] + [part(f, F.lit(PHONETIC)) for f in PHONETIC_FIELDS]
    x = x.select(F.col("id").alias("lsr_id"), F.explode(F.array(*parts)).alias("x"))
    x = x.select("lsr_id", "x.field", "x.context", "x.value").filter("value is not null")
    stand_in = (F.col("context") == PHONETIC) & F.trim(F.col("value")).isin(*STAND_INS)
    return x.filter(~F.coalesce(stand_in, F.lit(False)))


def consistent(values: DataFrame, rules: dict[str, dict[str, str]]) -> DataFrame:
    """values with `written`, the value in its one consistent form, and `strange`."""
    @pandas_udf(StringType())
    def rewrite(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = {k: Rewriter(r, k) for k, r in rules.items()}

        def one(context: str | None, value: str) -> str:
            w = made[context if context in made else majority_script(value)]
            y = w(value)
            return y + "\0" if w.strange(y) else y

        for contexts, texts in it:
            yield pd.Series([None if v is None else one(c, v) for c, v in zip(contexts, texts)], dtype=object)

    x = values.withColumn("_w", rewrite("context", "value"))
    return x.withColumn("written", F.rtrim(F.translate("_w", "\0", ""))).withColumn("strange", F.contains(F.col("_w"), F.lit("\0"))).drop("_w")


def deviating(records: DataFrame, languages: DataFrame) -> DataFrame:
    """(lsr_id, field, value, written) of every value that isn't in the consistent form."""
    values = field_values(records, languages)
    x = consistent(values, rewrites(character_counts(values)))
    return x.filter("value <> written or strange").select("lsr_id", "field", "value", "written").distinct()
