"""Template residue and error-page text (problem 10).

A page that answers with an error or an unfilled template differs from real content in three ways, each of which
is one kind of evidence here:

* placeholder detectors: a field name in the delimiters of some template language, words that stand for one, and
  filler: sentences of dummy Latin or of one token repeated;
* mismatched responses: sentences that servers and browsers say, in the languages of the corpus, and that share no
  terms with the title and the body around them. A text that treats of such a sentence takes its terms up again;
  then the sentence counts only where its shape (letters alone) recurs over hosts or its host delivers little else;
* duplicated low information: a body that shares no term with its title and has words that servers use, under the same
  conditions of shape and host.

documents has no address: the slug is taken from the terms of language_code's title line, the host is `source`.
What a text mentions or quotes is taken out first: quoted spans, filled-in markup ({{IPA|...}}, [[form]]) and
sentences about a word or a notation. Null and empty texts are never residue; length has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser as regex

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from lexspark.llm.lexemes import identity
from lexspark.session import bounded_broadcast, written

#: Quoted spans of the corpus languages, at most one sentence long.
QUOTED = r"“[^”\n]{0,200}”|„[^“\n]{0,200}“|«[^»\n]*[ \x{a0}][^»\n]{0,200}»|\"[^\"\n]{0,200}\""
#: Markup that is filled in.
FILLED = r"\{\{[\w-]+\|[^{}\n]*\}\}|\[\[[^\[\]\n]+\]\]"
#: Sentences that speak about a word, a sign or a notation.
MENTION = r"(?i)\b(?:in the notation|stands? for nothing|the word \S+ is (?:used|found)|a marker such as|the phrase|the message|the template|we print|filler words)\b"
#: Field names of entries; in quotation marks alone they are a merge field, not a quotation.
FIELDS = "headword|lemma|gloss|sense|period|century|language|source|citation|editor|title|note|page|form|author|date|name|value|field"
#: Placeholders of template languages. _F is a field name.
_F = r"[A-Za-z][\w.]*"
PLACEHOLDERS = (
    rf"\{{\{{\{{?\s*{_F}\s*\}}?\}}\}}", rf"[$#%@]\{{\s*{_F}\s*\}}", rf"(?<!\{{)\{{\s*{_F}\s*\}}(?!\}})", rf"%\({_F}\)[sdf]", r"(?<![\w%])%[sd](?!\w)",
    rf"\(\({_F}\)\)", rf"@@?{_F}@@?", rf"<<\s*{_F}\s*>>", r"<[a-z_]+(?:\.[a-z_]+)*>", r"(?i)<\s*(?:insert|your|enter|add)\b[^<>\n]{0,40}>",
    r"(?i)\[\s*(?:\.\.\.)?\s*(?:insert|your|enter|add)\b[^\[\]\n]{0,40}\]", r"(?i)\[[\w. ]{1,30} (?:to come|goes here|here|tbd|tba|pending)\]", r"\$[A-Z][A-Z_.]{2,}\$",
    r"\{\d+\}", rf"\{{%\s*{_F}\s*%\}}", rf"\{{{_F}\|[\w ]*\}}", rf"«\s*(?:{FIELDS}|[a-z]+[._][a-z]+)\s*»", rf"[~|^#*%@§¤]\s*(?:{FIELDS}|[a-z]+[._][a-z]+)\s*[~|^#*%@§¤]", rf"__{_F}__", r"_{4,}", r"\[object Object\]", rf"<%=?\s*{_F}\s*%>", rf"\[%\s*{_F}\s*%\]", rf"\[\[\s*{_F}\s*\]\]\s*$", r"\bX{3,}(?:-X{2,})+\b", r"\b(?:TODO|FIXME|TBD|TKTK)\b", r"(?i)(?:^|(?<=[.!?]\s))Your [a-z]+ here\b",
    r"(?i)\b(?:sample|placeholder|dummy|example) (?:gloss|definition|text|entry|headword|sense)\b(?: goes here)?[.\n]", r"(?i)\b[a-z]+ goes here\b", r"(?i)(?:^|(?<=[.!?]\s))(?:text|content|entry|gloss|definition|more) (?:to follow|to come|coming soon|pending)\b", r"(?i)(?:^|\n)[a-z ]{3,20}:\s*(?:undefined|null|NaN|none|n/a|tbd)\s*(?:\n|$)",
    r"(?<=\b(?:the|of|about|in|for|is|a|an|gives|keep) )(?:undefined|null|NaN)\b",
)
#: What servers and browsers say instead of content.
RESPONSES = (
    r"(?:^|\n)(?:HTTP )?(?:Error|Erreur|Fehler|ERROR) ?:? ?[45]\d\d\b", r"\((?:Error|Erreur|Fehler) [45]\d\d\)", r"(?:^|\n)[45]\d\d [A-Z][a-z]+",
    r"\[[45]\d\d\] while \w+", r"(?i)\b(?:internal server error|bad gateway|gateway timeout|service unavailable|access denied|page not found|too many requests|rate limited|temporarily unavailable|permission denied)\b",
    r"\b[A-Z]\w+(?:Error|Exception)(?:\(|:)", r"(?i)\bsegmentation fault\b", r"(?i)\btraceback\b.{0,30}most recent call",
    r"(?i)\bjava ?script\b", r"(?i)\b(?:requires?|allow|enable|blocks?|disabled?|turn on) scripts?\b", r"(?i)\bscripts (?:must|may|should|need|are)\b", r"(?i)\bchecking your browser\b", r"(?i)\byour browser is not supported\b",
    r"(?i)\byour session has expired\b", r"(?i)\bplease sign in again\b", r"(?i)\byou do not have permission\b", r"(?i)no tiene permiso", r"(?i)cette page n'existe plus", r"(?i)seite nicht gefunden", r"(?i)nicht verfügbar",
    r"(?i)n'a pas pu traiter la demande", r"(?i)\bsorry, (?:we|the|this|that)\b", r"(?i)\b(?:something went wrong|nothing here|nothing was found)\b", r"(?i)\b(?:down|closed) for maintenance\b", r"(?i)\bcould not (?:be found|find|load|be loaded)\b.{0,40}\b(?:server|file|page|record|entry)\b",
    r"(?i)\bis (?:not|no longer) available\b", r"(?i)página (?:no encontrada|que busca)", r"(?i)\bvuelva a intentarlo\b", r"(?i)\bmay have been moved or deleted\b", r"(?i)\bwhile (?:fetching|loading|parsing|reading) (?:record|headword|entry|quotation|page)\b",
    r"(?m)^(?:fatal|panic|ERROR|FATAL|Warning|Uncaught \w+): ", r"(?i)\byou requested\b", r"(?i)\bmust be (?:signed|logged) in\b", r"(?i)\b(?:database|server|socket|connection) (?:failed|refused|error|closed|reset|lost|did not|is down|was lost)\b",
    r"(?i)\b(?:unexpected end of file|no such file|out of memory|stack overflow|core dumped|connection (?:failed|refused|timed out))\b", r"(?i)\bdoes not exist at character\b",
)
#: Lines of page furniture: menus, sign-in and cookie links; two of them make an answer.
FURNITURE = r"(?m)^(?:[\p{L} ]+(?: \| [\p{L} ]+)+|Sign in|Log in|Accept cookies|Back to top|Menu|Contact the editors|Skip to content)$"
FURNITURE_LINES = 2
#: Weaker words of such answers; they count with duplication only.
WEAK = r"(?i)\b(?:retry|reload|sign in|log in|cookies|expired|unavailable|forbidden|timeout|maintenance|site owner|go back|moved|deleted|loading|server|request|home \| |contact the)\b"
#: Dummy Latin.
LOREM = "lorem ipsum dolor sit amet mauris magna nunc porta eros viverra ornare quis sed tempor nullam velit felis dapibus lectus consectetur adipiscing elit vestibulum"
#: A sentence is dummy text from this share of such words on, and this many words.
LOREM_SHARE, LOREM_WORDS = 0.7, 4
#: A run of one token, this many times: with the first, nine.
REPEATED = r"(?i)(?:^|[.\n]\s*)(\S{2,12})(?:\s+\1\b){5,}"
#: A shape is duplicated from this many hosts on.
COPIES = 2
#: An answer belongs to its text from this many terms on that it shares with the rest of it.
SHARED = 2
#: A host answers in place of its documents from this share of low information on, and this many texts of it.
HOST_SHARE, HOST_TEXTS = 0.5, 4


#: Dummy Latin words, as words.
DUMMY = rf"\b(?:{LOREM.replace(' ', '|')})\b"


#: Characters too common in plain texts to tell anything on their own.
COMMON = " .,;:!?'-()\n"


def needles(pattern: str, most: int = 1) -> set[str] | None:
    """Lower-case strings one of which, case aside, is in every match of the pattern; None if it has no telling ones.

    Alternatives beside literal text are multiplied out with it up to `most` strings.
    """

    def telling(s: str) -> bool:
        return len(s) > 2 or any(not c.isalnum() and c not in COMMON for c in s)

    def plain(items) -> set[str] | None:
        """All strings that a part of a pattern stands for, if it is literal."""
        out = {""}
        for op, arg in items:
            if op is regex.LITERAL:
                got = {chr(arg).lower()}
            elif op is regex.SUBPATTERN:
                got = plain(arg[3])
            elif op is regex.BRANCH:
                each = [plain(x) for x in arg[1]]
                got = None if None in each else set().union(*each)
            elif op is regex.AT:
                got = {""}
            else:
                got = None
            if not got or len(out) * len(got) > most:
                return None
            out = {x + y for x in out for y in got}
        return out

    def walk(items) -> set[str] | None:
        found: list[set[str]] = []
        run = {""}
        for op, arg in [*items, (None, None)]:
            if op is not None and op is not regex.AT and (more := plain([(op, arg)])) and len(run) * len(more) <= most:
                run = {x + y for x in run for y in more}
                continue
            if op is regex.AT:
                continue
            if all(map(telling, run)):
                found.append(run)
            run, got = {""}, None
            if op is regex.SUBPATTERN:
                got = walk(arg[3])
            elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT) and arg[0] > 0:
                one = len(arg[2]) == 1 and arg[2][0][0] is regex.LITERAL
                got = walk(list(arg[2]) * arg[0] if one else arg[2])
            elif op is regex.BRANCH:
                each = [walk(x) for x in arg[1]]
                got = None if None in each else set().union(*each)
            elif op is regex.IN and all(k is regex.LITERAL and telling(chr(c)) for k, c in arg):
                got = {chr(c).lower() for _, c in arg}
            if got:
                found.append(got)
        # strings with a sign, then long ones, are the rarest
        return max(found, key=lambda f: (all(not n.replace(" ", "").isalnum() for n in f), min(map(len, f)), -len(f)), default=None)

    return walk(regex.parse(pattern.replace(r"\p{L}", "a")))


#: Alternatives of a pattern are multiplied out up to this many strings: longer ones are rarer.
MOST_NEEDLES = 64


def _prefilter(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(strings, patterns): a text without any of the strings, case aside, and matches of the patterns has no match."""
    got = {p: needles(p, MOST_NEEDLES) for p in patterns}
    strings = set().union(*[n for n in got.values() if n])
    # a string within another one finds all that the longer one does
    return sorted(n for n in strings if not any(m != n and m in n for m in strings)), [p for p, n in got.items() if not n]


#: What the kinds of detectors look for, each a bit of the prefilter's result.
KINDS = {"placeholder": PLACEHOLDERS, "response": RESPONSES, "furniture": (FURNITURE,), "weak": (WEAK,)}
BITS = {k: 1 << i for i, k in enumerate([*KINDS, "filler"])}
PREFILTERS = {k: _prefilter([*ps]) for k, ps in KINDS.items()}
STRINGS, REST = (sorted(set().union(*[p[i] for p in PREFILTERS.values()])) for i in (0, 1))
#: Equal words in a row that a repeated token has at least.
ROW = 4


class Prefilter:
    """The kinds of detectors that may match a text, as bits: one automaton of all strings, and the few patterns without one."""

    def __init__(self) -> None:
        self.every = sum(BITS.values())
        self.automaton = ahocorasick.Automaton()
        for n in STRINGS:
            self.automaton.add_word(n, sum(BITS[k] for k, (strings, _) in PREFILTERS.items() if n in strings))
        self.automaton.make_automaton()
        # the content of a text has line ends that the text hasn't: beginnings of lines are anywhere here
        relaxed = {k: [p.replace(r"(?:^|\n)", "") for p in rest] for k, (_, rest) in PREFILTERS.items()}
        self.rest = [(BITS[k], re.compile("|".join(f"(?:{p})" for p in ps), re.MULTILINE | re.IGNORECASE)) for k, ps in {**relaxed, "filler": [DUMMY]}.items() if ps]

    def __call__(self, text: str) -> int:
        low, out = text.lower(), 0
        for _, bits in self.automaton.iter(low):
            out |= bits
        for bit, pattern in self.rest:
            if not out & bit and pattern.search(low):
                out |= bit
        if not out & BITS["filler"]:
            words = low.split()
            if any(a == b == c == d for a, b, c, d in zip(words, words[1:], words[2:], words[ROW - 1 :])):
                out |= BITS["filler"]
        return out


@pandas_udf(IntegerType())
def _kinds(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    test = Prefilter()
    for s in it:
        yield s.map(lambda t: test(t) if t else 0).astype("int32")


def _may(kind: str) -> Column:
    """Whether a detector of the kind may match; true wherever one does."""
    return F.col("_may").bitwiseAND(BITS[kind]) != 0


def content(text: Column) -> Column:
    """The text without what it merely mentions or quotes, one sentence or line a line."""
    x = F.regexp_replace(text, QUOTED, "“”")
    x = F.regexp_replace(x, FILLED, "\ufffc")  # no word or sign grows together over it
    return F.array_join(F.filter(F.split(x, r"(?<=[.!?…]) +|\n"), lambda s: ~s.rlike(MENTION)), "\n")


def _terms(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda w: F.length(w) > 3)


def _lorem(x: Column) -> Column:
    words = F.array(*map(F.lit, LOREM.split()))

    def dummy(s: Column) -> Column:
        w = F.filter(F.split(F.lower(s), r"[^\p{L}]+"), lambda t: t != "")
        return (F.size(w) >= LOREM_WORDS) & (F.size(F.filter(w, lambda t: F.array_contains(words, t))) >= LOREM_SHARE * F.size(w))

    return F.when(x.rlike("(?i)" + DUMMY), F.exists(F.split(x, r"[.!?\n]+"), dummy)).otherwise(False)


def evidence(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) with placeholder, filler, response and duplicated in place of the text.

    Repeated rows are judged alike; a null source counts as one host. Shapes are reduced to one row a host before
    their hosts are counted (partial sums first), so a page copied any number of times stays one row of that count.
    """
    kept = [c for c in docs.columns if c not in ("text", "_c", "_may", "_parts", "answered", "mismatched", "shape", "host", "low", *SIGNS)]
    x = docs.select(*kept, "text").withColumn("_may", _kinds("text"))
    # the texts are read once; each step is written out, so that what the next one uses several times is computed once
    x = written(x.select(*kept, "_may", F.when(F.col("_may") != 0, content(F.col("text"))).alias("_c")))
    spared = x.filter("_may = 0").select(*kept, *[F.lit(False).alias(c) for c in ("placeholder", "filler", "answered", "mismatched", "low")], F.lit(None).cast("string").alias("shape"))
    x = x.filter("_may <> 0")
    single, c = "|".join(f"(?:{p})" for p in RESPONSES), F.col("_c")
    lines = F.split("_c", "\n")
    # the sentences of an answer, if there are any: lines of furniture count together
    furniture = F.when(_may("furniture"), F.size(F.filter(lines, lambda s: s.rlike(FURNITURE))) >= FURNITURE_LINES).otherwise(False)
    parts = F.transform(lines, lambda s: F.struct(s.alias("s"), (s.rlike(single) | (F.col("_furniture") & s.rlike(FURNITURE))).alias("speaks")))
    x = x.withColumn("placeholder", F.when(_may("placeholder"), c.rlike("(?m)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS))).otherwise(False))
    x = x.withColumn("filler", F.when(_may("filler"), _lorem(c) | c.rlike(REPEATED)).otherwise(False))
    x = x.withColumn("_furniture", furniture)
    x = x.withColumn("_parts", F.when(F.when(_may("response"), c.rlike(single)).otherwise(False) | F.col("_furniture"), parts))
    title, body = F.element_at(lines, 1), F.regexp_replace("_c", r"^[^\n]*(?:\n|$)", "")
    # low information: weak words, and the body takes up no term of its title, where there is one
    low = F.when(_may("weak"), c.rlike(WEAK) & (F.size(F.array_intersect(_terms(title), _terms(body))) == 0)).otherwise(False)
    x = written(x.select(*kept, "placeholder", "filler", low.alias("low"), "_parts", F.when(low, c).alias("_c")))
    # mismatched: what is answered shares no terms with the title and the body around it
    text = lambda speaks: F.array_join(F.transform(F.filter("_parts", lambda p: p["speaks"] == speaks), lambda p: p["s"]), "\n")
    x = x.withColumn("answer", F.nullif(text(True), F.lit(""))).withColumn("answered", F.col("answer").isNotNull())
    x = x.withColumn("mismatched", F.when(F.col("answered"), F.size(F.array_intersect(_terms(F.col("answer")), _terms(text(False)))) < SHARED).otherwise(False))
    said = F.regexp_replace(F.lower(F.coalesce("answer", F.when(F.col("low"), F.col("_c")))), r"[^\p{L}]+", " ")
    x = x.withColumn("shape", F.when(said.isNotNull(), identity(said))).withColumn("low", F.col("low") & ~F.col("answered"))
    x = written(x.select(*kept, "placeholder", "filler", "answered", "mismatched", "low", "shape").unionByName(spared))
    told = x.filter("shape is not null").withColumn("host", F.coalesce("source", F.lit("")))
    hosts = told.groupBy("shape", "host").agg(F.count("*").alias("n")).groupBy("shape").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= COPIES).select("shape", F.lit(True).alias("recurs"))
    lead = x.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.count("shape").alias("k"))
    lead = lead.filter((F.col("k") >= HOST_TEXTS) & (F.col("k") >= HOST_SHARE * F.col("n"))).select("host", F.lit(True).alias("leads"))
    # texts without such words, nearly all of them, stay out of the joins: they share the null key
    told = told.join(bounded_broadcast(written(hosts)), "shape", "left").join(bounded_broadcast(written(lead)), "host", "left")
    told = told.withColumn("common", F.col("recurs").isNotNull() | F.col("leads").isNotNull())
    told = told.withColumn("response", F.col("answered") & (F.col("mismatched") | F.col("common"))).withColumn("duplicated", F.col("low") & F.col("common"))
    rest = x.filter("shape is null").withColumns({"response": F.lit(False), "duplicated": F.lit(False)})
    return told.select(*kept, *SIGNS).unionByName(rest.select(*kept, *SIGNS))


#: What evidence() adds.
SIGNS = ("placeholder", "response", "filler", "duplicated")


def residue(docs: DataFrame) -> DataFrame:
    """Documents in which residue stands in place of content, with the evidence."""
    return evidence(docs).filter("placeholder or response or filler or duplicated")
