"""Queries of language contact; borrowings are read out of the etymologies of raw entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import contact as C
from lexspark.schema import CONTACT_PARTS, DOMAIN_WORDS
from lexspark.sources.tables import table

LANG = r"((?:Old |Middle |Proto-)?[A-Z][a-z]+)"
PATTERNS = (rf"^Borrowed from {LANG} ([^ ,]+)", rf"^From {LANG} ([^ ,]+),", rf"^Loan of the [a-z]+ trade .*, cf\. {LANG} ([^ .]+)")
FIELD = r"^Loan of the ([a-z]+) trade"


#: The recipient of entries whose language is not in the list.
UNKNOWN = "unknown"


def _clean(x):
    return F.nullif(F.lower(F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " "))), F.lit(""))


def recipients(x, languages):
    """x (language, language_code) with recipient: by cleaned name, else other name, else cleaned code, else unknown.

    The list is fixed; another name of two languages stands for neither.
    """
    names = languages.select(_clean(F.col("name")).alias("k"), "iso_code", F.lit(0).alias("rank"))
    others = languages.select(F.explode("alt_names").alias("k"), "iso_code").select(_clean(F.col("k")).alias("k"), "iso_code", F.lit(1).alias("rank"))
    n = names.unionByName(others).filter("k is not null").groupBy("k").agg(F.min("rank").alias("rank"), F.collect_set(F.struct("rank", "iso_code")).alias("all"))
    n = n.select("k", F.filter("all", lambda v: v["rank"] == F.col("rank"))["iso_code"].alias("codes")).filter("size(codes) = 1").select("k", F.col("codes")[0].alias("by_name"))
    c = languages.select(_clean(F.col("iso_code")).alias("c"), F.col("iso_code").alias("by_code"))
    x = x.withColumn("k", _clean(F.col("language"))).withColumn("c", _clean(F.col("language_code")))
    x = x.join(F.broadcast(n), "k", "left").join(F.broadcast(c), "c", "left")
    return x.withColumn("recipient", F.coalesce("by_name", "by_code", F.lit(UNKNOWN))).drop("k", "c", "by_name", "by_code")


def borrowings(s, d, every=False):
    """Borrowings with a listed donor: every one, the recipient resolved from how it is written, or those whose language is exactly a name."""
    e = table(s, d, "raw_entries", "entry_id", "form", "language", "language_code", "etymology", "definitions", "date_attested")
    pick = lambda g: F.coalesce(*[F.nullif(F.regexp_extract("etymology", p, g), F.lit("")) for p in PATTERNS])
    lang = F.broadcast(table(s, d, "languages", "name", F.col("iso_code").alias("donor")))  # the fixed canonical list
    field = F.regexp_extract("etymology", FIELD, 1)
    x = e.select("form", "language", "language_code", pick(1).alias("name"), pick(2).alias("source_form"), F.when(field != "", F.array(field)).alias("fields"), F.try_element_at("definitions", F.lit(1)).alias("definition"), F.col("date_attested").alias("year"))
    x = x.join(lang, "name")
    if not every:
        x = x.join(lang.select(F.col("name").alias("language")), "language", "left_semi")
    return recipients(x, table(s, d, "languages", "name", "iso_code", "alt_names")).select("donor", "recipient", "year", "form", "source_form", "fields", "definition")


_PICK = lambda g: "coalesce(" + ", ".join(f"nullif(regexp_extract(etymology, '{p}', {g}), '')" for p in PATTERNS) + ")"
_DOMAIN = "case " + " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in ws) + f" then '{k}'" for k, ws in DOMAIN_WORDS.items()) + " end"
_CLEAN = lambda c: rf"nullif(lower(trim(regexp_replace({c}, '[\s\x{{a0}}]+', ' ', 'g'), ' ')), '')"
#: Resolution of freely written languages to `recipient`, of a relation with language and language_code.
NAMES = f"""nm as (select k, iso_code, min(rank) over (partition by k) as best, rank from (select {_CLEAN('name')} as k, iso_code, 0 as rank from languages union all select {_CLEAN('k')}, iso_code, 1 from (select unnest(alt_names) as k, iso_code from languages)) where k is not null),
nu as (select k, min(iso_code) as by_name from nm where rank = best group by k having count(distinct iso_code) = 1)"""
BORROW = f"""{NAMES}, e as (select form, {_CLEAN('language')} as k, {_CLEAN('language_code')} as c, {_PICK(1)} as name, {_PICK(2)} as source_form, nullif(regexp_extract(etymology, '{FIELD}', 1), '') as field, lower(coalesce(definitions[1], '')) as t, date_attested as year from raw_entries),
b as (select a.iso_code as donor, coalesce(by_name, r.iso_code, '{UNKNOWN}') as recipient, year, form, source_form, coalesce(field, {_DOMAIN}) as domain from e join languages a on a.name = e.name left join nu on nu.k = e.k left join languages r on lower(r.iso_code) = e.c)"""
_TYPES = " union all ".join(f"select '{k}' as type, {i} as o, unnest({ps}) as part" for i, (k, ps) in enumerate(CONTACT_PARTS.items()))
_SIDES = "s as (select recipient as language, donor as other, 'incoming' as direction, year, domain from b where year is not null union all select donor, recipient, 'outgoing', year, domain from b where year is not null), sc as (select *, cast(floor(year / 100) * 100 as int) as century from s)"
_K = "language, other, direction, century"

QUERIES = {
    "contact_events": lambda s, d: C.events(borrowings(s, d, True), min_borrowings=2),
    "borrowing_by_century": lambda s, d: C.by_century(borrowings(s, d, True)),
    "borrowing_by_domain": lambda s, d: C.by_domain(borrowings(s, d, True)),
    "borrowing_peaks": lambda s, d: C.peak_century(borrowings(s, d, True)),
    "suffix_adaptations": lambda s, d: C.adaptations(borrowings(s, d, True)),
    "contact_intensity": lambda s, d: C.intensity(borrowings(s, d, True)),
    "contact_events_ordered": lambda s, d: C.ordered_events(C.events(borrowings(s, d, True), min_borrowings=2), "vrd"),
    "borrowings_between": lambda s, d: C.between(borrowings(s, d, True), 1500, 1700).groupBy("donor").agg(F.count("*").alias("n"), F.count("year").alias("dated")),
    "borrowing_patterns": lambda s, d: C.patterns(borrowings(s, d, True)),
    "borrowing_labels": lambda s, d: C.century_labels(borrowings(s, d, True)),
}
_EVENTS = f"""with {BORROW}, {_SIDES}, g as (select {_K}, count(*) as n, stddev_pop(year) as sd from sc group by all),
dc as (select {_K}, domain, count(*) as c from sc where domain is not null group by all), dp as (select *, c / sum(c) over (partition by {_K}) as p from dc),
h as (select {_K}, sum(-p * log2(p)) as h from dp group by all), ty as ({_TYPES}), ds as (select distinct domain, type, o from (select distinct domain from dc) join ty on contains(lower(domain), part)),
tc as (select {_K}, type, o, sum(c) as c from dc join ds using (domain) group by all),
tr as (select *, row_number() over (partition by {_K} order by c desc, o) as r from tc),
x as (select g.*, round(0.4 * least(1.0, n / 20) + 0.3 * (1 - coalesce(h, 0) / log2(10)) + 0.3 * greatest(0.0, 1 - sd / 100), 3) as confidence, type as contact_type from g left join h using ({_K}) left join (select * from tr where r = 1) t using ({_K}) where n >= 2)
select {_K}, n as borrowings, round(least(1.0, n / 50), 3) as intensity, confidence, contact_type from x where confidence >= 0.3"""
_LABEL = "(cast(floor(abs(year) / 100) as int) + 1) || case when year >= 0 then 'th century CE' else 'th century BCE' end"
SQL = {
    "contact_events": _EVENTS,
    "contact_events_ordered": f"select *, row_number() over (order by confidence desc, century, direction, other) as place from ({_EVENTS}) where language = 'vrd'",
    "borrowings_between": f"with {BORROW} select donor, count(*) as n, count(year) as dated from b where year is null or year between 1500 and 1700 group by 1",
    "borrowing_labels": f"with {BORROW} select donor, recipient, {_LABEL} as label, count(*) as n from b where year is not null group by all",
    "borrowing_patterns": f"""with {BORROW}, t as (select donor, recipient, count(*) as total from b group by all), c as (select donor, recipient, cast(floor(year / 100) * 100 as int) as c, {_LABEL} as label, count(*) as n from b where year is not null group by all),
l as (select donor, recipient, string_agg(label || '=' || n, '; ' order by c, label) as centuries, arg_min(c, -n * 100000 + c) as peak from c group by all),
f as (select donor, recipient, string_agg(domain || '=' || n, '; ' order by domain) as domains from (select donor, recipient, domain, count(*) as n from b where domain is not null group by all) group by all),
r as (select donor, recipient, form, row_number() over (partition by donor, recipient order by year nulls last, form, source_form) as r from b), s as (select donor, recipient, string_agg(form, ', ' order by r) as first_forms from r where r <= 10 group by all)
select donor, recipient, total, centuries, peak, domains, first_forms from t left join l using (donor, recipient) left join f using (donor, recipient) left join s using (donor, recipient)""",
    "borrowing_by_century": f"with {BORROW} select donor, recipient, cast(floor(year / 100) * 100 as int) as century, count(*) as n from b where year is not null group by all",
    "borrowing_by_domain": f"with {BORROW} select donor, recipient, domain, count(*) as n from b where domain is not null group by all",
    "borrowing_peaks": f"with {BORROW}, c as (select donor, recipient, cast(floor(year / 100) * 100 as int) as century, count(*) as n from b where year is not null group by all), r as (select *, row_number() over (partition by donor, recipient order by n desc, century) as k from c) select donor, recipient, century, n from r where k = 1",
    "suffix_adaptations": f"with {BORROW}, c as (select recipient, '-' || right(source_form, 2) || ' > -' || right(form, 2) as change, count(*) as n from b where length(source_form) > 2 and length(form) > 2 and right(source_form, 2) <> right(form, 2) group by all), r as (select *, row_number() over (partition by recipient order by n desc, change) as rank from c) select recipient, change, n, rank from r where rank <= 5 and n >= 2",
    "contact_intensity": f"""with {BORROW}, g as (select least(donor, recipient) as a, greatest(donor, recipient) as b, count(*) as n, count(*) filter (donor < recipient) as ab, count(distinct domain) as domains from b where donor <> recipient group by all)
select a, b, n, ab, domains, round(least(1.0, n / 100 * (0.5 + 0.5 * domains / 10)), 3) as intensity, round(abs(2 * ab / n - 1), 3) as asymmetry, case when ab > n - ab then a else b end as dominant from g""",
}
