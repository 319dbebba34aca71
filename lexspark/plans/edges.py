"""Queries of the typed edge table that the etymologies of the entries give, and walks over all of it.

Searches start from every word whose id has a hash divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import edges as E
from lexspark.operators import graph as G
from lexspark.plans.contact import NAMES, _CLEAN, recipients
from lexspark.session import written
from lexspark.sources.tables import table


def words(s, d):
    x = table(s, d, "raw_entries", "form", "language", "language_code", "etymology", F.col("date_attested").alias("year"))
    return recipients(x, table(s, d, "languages", "name", "iso_code", "alt_names")).withColumnRenamed("recipient", "lang")


def edge_table(s, d):
    return E.from_etymologies(words(s, d), table(s, d, "languages", "name", F.col("iso_code").alias("lang")))


def _starts(e):
    ids = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ids.filter(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 == 0)


def _all(e):
    return e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def _walk(s, d, f):
    e = written(edge_table(s, d))
    return f(e, _starts(e))


def edge_counts(s, d):
    """Edges by type and number of witnesses, and mean witnesses: gauges of the graph."""
    return edge_table(s, d).groupBy("relationship_type", F.least("witnesses", F.lit(3)).alias("bucket")).agg(F.count("*").alias("n"))


def etymology_paths(s, d):
    e = written(edge_table(s, d))
    return G.chains(e, _all(e))


def cognate_sets(s, d):
    """Words below each root by language: members and the first of them."""
    e = written(edge_table(s, d))
    c = G.chains(e, _all(e)).filter("depth > 0").withColumn("lang", F.substring_index("start", ":", 1))
    return c.groupBy("proto", "lang").agg(F.count("*").alias("members"), F.min("start").alias("first"))


def cognate_members(s, d):
    """The first hundred words below each root by language, as rows; a hundred is the operator's own limit."""
    from pyspark.sql import Window

    e = written(edge_table(s, d))
    c = G.chains(e, _all(e)).filter("depth > 0").select("proto", F.substring_index("start", ":", 1).alias("lang"), F.col("start").alias("member"))
    w = Window.partitionBy("proto").orderBy("lang", "member")
    return c.withColumn("place", F.row_number().over(w)).filter("place <= 100")


def word_borrowings(s, d):
    """Borrowings of the starting words, both ways."""
    e = edge_table(s, d)
    return E.id_lists(e.filter("relationship_type = 'BORROWED_FROM'")).join(_starts(e), "id")


def family_gaps(s, d):
    return E.implausible(edge_table(s, d), table(s, d, "languages", F.col("iso_code").alias("lang"), "family"))


def temporal_order(s, d):
    """First years of words come from entries and records."""
    own = words(s, d).select(E.node(F.col("lang"), F.col("form")).alias("id"), "year")
    m = table(s, d, "lsr_metadata", E.node(F.col("language_code"), F.col("form_orthographic")).alias("id"), F.col("date_start").alias("year"))
    return E.backwards(edge_table(s, d), own.unionByName(m).filter("id is not null and year is not null").groupBy("id").agg(F.min("year").alias("first")))


def _descendants(s, d):
    """All words below the starting ones, to ten levels."""
    return _walk(s, d, lambda e, x: G.walk(G.reversed_(G.of_types(e, "DESCENDS_FROM")), x, 10).filter("depth > 0"))


def edges_after_deletion(s, d):
    """What stays of the edges when the starting words are deleted with theirs."""
    e = written(edge_table(s, d))
    return E.without(e, _starts(e)).select("source_id", "target_id", "relationship_type")


def edge_sink(s, d):
    from lexspark.operators.records import graph_edge

    return graph_edge(edge_table(s, d).withColumn("confidence", F.when(F.col("witnesses") > 1, F.round(1 - 1 / F.col("witnesses"), 6))))


QUERIES = {
    "edge_table": edge_table, "edge_counts": edge_counts, "edge_id_lists": lambda s, d: E.id_lists(edge_table(s, d)), "etymology_paths": etymology_paths, "cognate_sets": cognate_sets, "cognate_members": cognate_members,
    "word_borrowings": word_borrowings, "all_shortest_paths": lambda s, d: _walk(s, d, lambda e, x: G.shortest_paths(e, x, 4)),
    "descent_paths": lambda s, d: _walk(s, d, lambda e, x: G.shortest_paths(e, x, 5, 10, "DESCENDS_FROM")),
    "edge_neighbours": lambda s, d: _walk(s, d, lambda e, x: G.neighbours(e, x, 2, "BORROWED_FROM", "COGNATE_OF")), "word_descendants": _descendants,
    "edges_after_deletion": edges_after_deletion, "edge_sink": edge_sink, "family_gaps": family_gaps, "temporal_order": temporal_order,
    "word_degrees": lambda s, d: E.ranked_degree(edge_table(s, d)), "edge_cycles": lambda s, d: G.on_cycles(G.both_ways(edge_table(s, d).filter("relationship_type = 'COGNATE_OF'")).unionByName(edge_table(s, d).select("source_id", "target_id", "relationship_type").filter("relationship_type <> 'COGNATE_OF'"))),
}
_W, _L = "([^ ,.]+)", "((?:Old |Middle |Proto-)?[A-Z][a-z]+)"
_G = lambda p, g: f"nullif(regexp_extract(etymology, '{p}', {g}), '')"
_ORIGIN = f"^Of {_L} origin: (.+?) → (.+?) → "
_LOANS = (f"^Borrowed from {_L} {_W}", f"^From {_L} {_W},", rf"^Loan of the [a-z]+ trade .*, cf\. {_L} {_W}")
_LOAN = lambda g: "coalesce(" + ", ".join(_G(p, g) for p in _LOANS) + ")"
_LAST, _VERB, _KIN = f"^From {_L} {_W}, ultimately from {_L} {_W}", f"^From the verb {_W},.* via {_L} {_W}", f"compare {_L} {_W} and {_L} {_W}"
_CODE = lambda c: f"(select iso_code from languages l where l.name = {c})"
EDGES = f"""{NAMES}, w as (select coalesce(by_name, r.iso_code, 'unknown') || ':' || form as own, coalesce(by_name, r.iso_code, 'unknown') as lang, date_attested as year,
 {_G(_ORIGIN, 1)} as ol, {_G(_ORIGIN, 2)} as oa, {_G(_ORIGIN, 3)} as ob, {_LOAN(1)} as ll, {_LOAN(2)} as lf, {_G(_LAST, 3)} as ul, {_G(_LAST, 4)} as uf, {_G(_VERB, 1)} as vf, {_G(_VERB, 2)} as vl, {_G(_VERB, 3)} as vv,
 {_G(f'^A derivative of {_W}', 1)} as sf, {_G(_KIN, 1)} as k1, {_G(_KIN, 2)} as f1, {_G(_KIN, 3)} as k2, {_G(_KIN, 4)} as f2
 from raw_entries x left join nu on nu.k = {_CLEAN('x.language')} left join languages r on lower(r.iso_code) = {_CLEAN('x.language_code')} where form <> '' and etymology <> ''),
n as (select own, lang, year, vf, sf, lo.iso_code || ':' || oa as old, lo.iso_code || ':' || ob as mid, ld.iso_code || ':' || lf as donor, lu.iso_code || ':' || uf as last, lv.iso_code || ':' || vv as via, a.iso_code || ':' || f1 as kin1, b.iso_code || ':' || f2 as kin2
 from w left join languages lo on lo.name = ol left join languages ld on ld.name = ll left join languages lu on lu.name = ul left join languages lv on lv.name = vl left join languages a on a.name = k1 left join languages b on b.name = k2),
ea as (select own as s, mid as t, 'DESCENDS_FROM' as k, year from n union all select mid, old, 'DESCENDS_FROM', year from n union all select own, donor, 'BORROWED_FROM', year from n union all select donor, last, 'DESCENDS_FROM', year from n
 union all select own, via, 'BORROWED_FROM', year from n union all select own, lang || ':' || vf, 'DESCENDS_FROM', year from n union all select own, lang || ':' || sf, 'DESCENDS_FROM', year from n
 union all select least(own, kin1), greatest(own, kin1), 'COGNATE_OF', year from n where kin1 is not null union all select least(own, kin2), greatest(own, kin2), 'COGNATE_OF', year from n where kin2 is not null),
e as materialized (select s as source_id, t as target_id, k as relationship_type, min(year) as first_year, count(*) as witnesses from ea where s is not null and t is not null and s <> t group by all),
ids as (select source_id as id from e union select target_id from e), st as (select id from ids where cast('0x' || substr(md5(id), 1, 4) as int) % 20 = 0),
bw as (select source_id as id, target_id as nxt, relationship_type as k from e union select target_id, source_id, relationship_type from e)"""
_LISTS = """il as (select source_id as id, 'ancestor' as list, target_id as other from e where relationship_type = 'DESCENDS_FROM' union select target_id, 'descendant', source_id from e where relationship_type = 'DESCENDS_FROM'
 union select source_id, 'donor', target_id from e where relationship_type = 'BORROWED_FROM' union select target_id, 'loan', source_id from e where relationship_type = 'BORROWED_FROM'
 union select source_id, 'cognate', target_id from e where relationship_type = 'COGNATE_OF' union select target_id, 'cognate', source_id from e where relationship_type = 'COGNATE_OF')"""
_CHAIN = """ds as (select distinct source_id, target_id from e where relationship_type = 'DESCENDS_FROM'), ch as (select id as start, id, [id] as path from ids union all select start, target_id, list_append(path, target_id) from ch join ds on source_id = id where not list_contains(path, target_id) and len(path) <= 20),
en as (select start, path, id as proto, row_number() over (partition by start order by len(path) desc, array_to_string(path, ' > ')) as r from ch where not exists (select 1 from ds where source_id = ch.id and not list_contains(path, target_id)) or len(path) = 21),
cs as (select start, proto, len(path) - 1 as depth, array_to_string(path, ' > ') as path from en where r = 1)"""


def _paths(types: str, hops: int) -> str:
    return f"""pb as (select distinct id, nxt from bw {types}), p as (select id as start, id, [id] as seen, id as path, 0 as hops from st union all select start, nxt, list_append(seen, nxt), path || ' - ' || nxt, hops + 1 from p join pb using (id) where hops < {hops} and not list_contains(seen, nxt)),
m as (select *, min(hops) over (partition by start, id) as least from p), r as (select *, row_number() over (partition by start, id order by path) as r from m where hops = least and hops > 0) select start, id, hops, path from r where r <= 10"""


SQL = {
    "edge_table": f"with {EDGES} select * from e",
    "edge_counts": f"with {EDGES} select relationship_type, least(witnesses, 3) as bucket, count(*) as n from e group by all",
    "edge_id_lists": f"with {EDGES}, {_LISTS} select * from il",
    "etymology_paths": f"with recursive {EDGES}, {_CHAIN} select * from cs",
    "cognate_sets": f"with recursive {EDGES}, {_CHAIN} select proto, split_part(start, ':', 1) as lang, count(*) as members, min(start) as first from cs where depth > 0 group by all",
    "cognate_members": f"with recursive {EDGES}, {_CHAIN}, c as (select proto, split_part(start, ':', 1) as lang, start as member from cs where depth > 0), r as (select *, row_number() over (partition by proto order by lang, member) as place from c) select * from r where place <= 100",
    "word_borrowings": f"with {EDGES}, {_LISTS} select * from il join st using (id) where list in ('donor', 'loan')",
    "all_shortest_paths": f"with recursive {EDGES}, " + _paths("", 4),
    "descent_paths": f"with recursive {EDGES}, " + _paths("where k = 'DESCENDS_FROM'", 5),
    "edge_neighbours": f"with {EDGES}, b2 as (select distinct id, nxt from bw where k in ('BORROWED_FROM', 'COGNATE_OF')), a as (select st.id as start, nxt as id from st join b2 using (id)), x as (select start, id, 1 as depth from a union select start, b2.nxt, 2 from a join b2 using (id)) select start, id, min(depth) as depth from x where start <> id group by all",
    "word_descendants": f"with recursive {EDGES}, ds as (select distinct source_id, target_id from e where relationship_type = 'DESCENDS_FROM'), c as (select id as start, id, 0 as depth from st union select start, source_id, depth + 1 from c join ds on target_id = id where depth < 10) select start, id, min(depth) as depth from c where start <> id group by all",
    "edges_after_deletion": f"with {EDGES} select source_id, target_id, relationship_type from e where source_id not in (select id from st) and target_id not in (select id from st)",
    "edge_sink": f"with {EDGES} select source_id, target_id, relationship_type, case when witnesses > 1 then round(1 - 1 / witnesses, 6) else 1.0 end as confidence from e",
    "family_gaps": f"with {EDGES} select source_id, target_id, a.family as source_family, b.family as target_family from e join languages a on a.iso_code = split_part(source_id, ':', 1) join languages b on b.iso_code = split_part(target_id, ':', 1) where relationship_type = 'DESCENDS_FROM' and a.family <> b.family",
    "temporal_order": f"with {EDGES}, y as (select id, min(year) as first from (select coalesce(by_name, r.iso_code, 'unknown') || ':' || form as id, date_attested as year from raw_entries x left join nu on nu.k = {_CLEAN('x.language')} left join languages r on lower(r.iso_code) = {_CLEAN('x.language_code')} where form <> '' union all select coalesce(language_code, 'unknown') || ':' || form_orthographic, date_start from lsr_metadata where form_orthographic <> '') where year is not null group by 1) select source_id, target_id, a.first as child, b.first as ancestor from e join y a on a.id = source_id join y b on b.id = target_id where relationship_type = 'DESCENDS_FROM' and b.first > a.first",
    "word_degrees": f"with {EDGES}, g as (select id, count(*) as degree from (select source_id as id from e union all select target_id from e) group by 1) select id, degree, dense_rank() over (order by degree desc) as rank from g",
    # cognates are both ways: every word with one lies on a cycle, and so does what lies between two of one component
    "edge_cycles": f"with recursive {EDGES}, f as (select source_id as a, target_id as b from e union select target_id, source_id from e where relationship_type = 'COGNATE_OF'), c as (select a as s, b from f union select c.s, f.b from c join f on f.a = c.b) select distinct s as id from c where s = b",
}
