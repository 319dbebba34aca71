"""Queries of semantic drift over embeddings: each vector and a copy with every eighth place masked a year later."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import vectors as V
from lexspark.operators import drift as D
from lexspark.operators.drift import shift_type
from lexspark.schema import SHIFT_WORDS
from lexspark.sources.tables import dedup_deliveries, table


def series(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("form"), (F.col("vec_id") % 4).cast("int").alias("lang"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    masked = F.transform("vec", lambda x, i: F.when(i % 8 == 0, 0.0).otherwise(x))
    both = F.array(F.struct((1000 + 2 * F.col("vec_id")).alias("date"), F.col("vec").alias("vec")), F.struct((1001 + 2 * F.col("vec_id")).alias("date"), masked.alias("vec")))
    return e.select("form", "lang", F.explode(both).alias("p")).select("form", "lang", F.col("p.date").alias("date"), F.col("p.date").alias("id"), F.col("p.vec").alias("vec"))


def definition_shifts(s, d):
    """Type of change between a record's definition and its graph node's."""
    n = table(s, d, "graph_nodes", "node_id", "definition")
    m = table(s, d, "lsr_metadata", "id", "neo4j_id", "definition_primary").join(n, F.col("neo4j_id") == F.col("node_id"))
    return m.select("id", shift_type(F.col("definition"), F.col("definition_primary")).alias("shift_type")).groupBy("shift_type").agg(F.count("*").alias("n"))


def words(s, d):
    """Records as points: their definitions embedded, dated by the middle of their period."""
    from lexspark.functions.text import midpoint
    from lexspark.operators.records import attestation_facts
    from lexspark.operators.references import clean_uuid

    a = dedup_deliveries(table(s, d, "attestations", "id", "lsr_id", "text_date"), "id")
    m = table(s, d, "lsr_metadata", "id", "form_normalized", "language_code", "date_start", "date_end", "definition_primary", "confidence_overall", "semantic_fields")
    m = m.join(attestation_facts(a, clean_uuid(F.col("lsr_id"))).select(F.col("lsr_id").alias("id"), "n"), "id", "left")
    return m.select(F.col("form_normalized").alias("form"), F.col("language_code").alias("lang"), "id", midpoint(F.col("date_start"), F.col("date_end")).alias("date"), V.embedded(F.col("definition_primary")).alias("vec"), F.col("definition_primary").alias("definition"), F.col("confidence_overall").alias("confidence"), F.coalesce("n", F.lit(0)).alias("attestations"), "semantic_fields")


def _fields(s, d):
    return D.field_evolution(words(s, d).select(F.explode("semantic_fields").alias("field"), "date", "vec"))


def vector_functions(s, d):
    """Distance of each vector to the next one, and its length after scaling."""
    v = table(s, d, "embeddings", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("next"))
    return v.join(n, "vec_id").select("vec_id", F.round(V.euclidean(F.col("v"), F.col("next")), 6).alias("distance"), F.round(V.norm(V.unit(F.col("v"))), 6).alias("unit"))


def nearest(s, d, k: int = 5):
    """The k forms' centroids closest to each form's, by cosine.

    Labels are the stated queries: the list of centroids is broadcast below a counted bound; beyond it, forms are met in
    blocks: every form with one block of the others at a time.
    """
    from pyspark.sql import Window

    from lexspark.session import BROADCAST_ROWS, written

    v = series(s, d)
    c = D.centroids(v).groupBy("form").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("p")).select("form", F.transform("p", lambda x: x["mean"]).alias("c"))
    c = written(c)
    blocks = max(1, -(-c.count() // (BROADCAST_ROWS // 100)))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    best = None
    for block in range(blocks):
        part = c.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block).agg(F.collect_list(F.struct("form", "c")).alias("all"))  # one block, of bounded size
        x = c.join(F.broadcast(part)).select(F.col("form").alias("a"), F.col("c").alias("ca"), F.explode("all").alias("o")).filter("a <> o.form")
        x = x.select("a", F.col("o.form").alias("b"), F.round(V.cosine(F.col("ca"), F.col("o.c")), 6).alias("cosine"))
        x = (x if best is None else best.unionByName(x)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        best = x.drop("rank") if block + 1 < blocks else x
    return best.select("a", "b", "rank", "cosine")


_V = """v0 as (select vec_id, label as form, cast(vec_id % 4 as int) as lang, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings),
v as (select form, lang, 1000 + 2 * vec_id as date, vec from v0 union all select form, lang, 1001 + 2 * vec_id, list_transform(vec, lambda x, i: case when (i - 1) % 8 = 0 then 0.0 else x end) from v0),
l as (select *, lag(vec) over (partition by form, lang order by date) as before from v),
m as (select *, case when before is null then 0.0 else least(1.0, greatest(0.0, 1 - list_cosine_similarity(before, vec))) end as m from l),
t as (select form, lang, count(*) as points, sum(m) as tot, sum(case when m > 0.2 then m else 0 end) as shifted, arg_max(vec, date) as final from m group by all)"""
_COUNT = lambda t, ws: "len(list_filter([" + ", ".join(f"'{w}'" for w in ws) + f"], lambda w: contains({t}, w)))"
_SCORES = ", ".join(f"{{'s': {_COUNT('b', ws)} - {_COUNT('a', ws)}, 'o': {-i}, 'k': '{k}'}}" for i, (k, ws) in enumerate(SHIFT_WORDS.items()))
QUERIES = {
    "trajectory_points": lambda s, d: D.points(series(s, d)),
    "semantic_shifts": lambda s, d: D.shifts(series(s, d)),
    "drift_stability": lambda s, d: D.totals(series(s, d)).drop("final"),
    "trajectory_divergence": lambda s, d: D.divergence(series(s, d)),
    "vector_centroids": lambda s, d: D.centroids(series(s, d)),
    "cosine_topk": nearest,
    "definition_shifts": definition_shifts,
    "word_trajectories": lambda s, d: D.trajectory(words(s, d)).drop("distance"),
    "word_shifts": lambda s, d: D.shift_rows(words(s, d)),
    "shift_edges": lambda s, d: D.shift_edges(words(s, d)),
    "trajectory_lookup": lambda s, d: D.found_or_form(table(s, d, "graph_nodes", F.col("form_normalized").alias("form"), F.col("language_code").alias("lang")).filter("form is not null and lang is not null"), words(s, d)),
    "divergence_extremes": lambda s, d: D.extremes(D.divergence(series(s, d))),
    "field_evolution": _fields,
    "vector_functions": vector_functions,
}
_HEX = "strpos('0123456789abcdef', substr(md5(w), {0}, 1)) - 1"
_KIND = lambda before, after: f"case when coalesce({before}, '') = '' or coalesce({after}, '') = '' then 'unknown' when top.s > 0 then top.k when length({after}) / length({before}) > 1.5 then 'generalization' when length({after}) / length({before}) < 0.7 then 'specialization' else 'general' end"
_CLEANED = r"lower(regexp_replace(lsr_id, '^[\s\x{a0}{(]+|[\s\x{a0})}]+$', '', 'g'))"
_P = f"""acs as (select k, count(*) as n from (select distinct on (id) id, {_CLEANED} as k from attestations) where k <> '' group by k),
ew as (select id, unnest(list_filter(string_split_regex(lower(definition_primary), '[^\\p{{L}}]+'), lambda w: w <> '')) as w from lsr_metadata),
ep as (select id, {_HEX.replace('{0}', '1')} as place, sum(case when {_HEX.replace('{0}', '2')} < 8 then 1.0::double else -1.0::double end) as v from ew group by all),
eg as (select i.id, list(coalesce(v, 0.0::double) order by j) as vec from (select distinct id from ew) i cross join (select unnest(generate_series(0, 15)) as j) left join ep on ep.id = i.id and ep.place = j group by i.id),
pt as (select form_normalized as form, language_code as lang, m.id, cast(floor((date_start + case when date_end is null or date_end = 0 then date_start else date_end end) / 2) as int) as date, vec, definition_primary as definition, confidence_overall as confidence, coalesce(n, 0) as attestations, semantic_fields from lsr_metadata m left join eg on eg.id = m.id left join acs on acs.k = m.id),
pl as (select *, lag(vec) over w as pv, lag(definition) over w as before, lag(confidence) over w as trust, lag(id) over w as prev from pt where date is not null window w as (partition by form, lang order by date, id)),
pm as (select *, case when pv is null or vec is null then 0.0 else coalesce(case when list_sum(list_transform(vec, lambda x: x * x)) = 0 or list_sum(list_transform(pv, lambda x: x * x)) = 0 then 0.0 else least(1.0, greatest(0.0, 1 - list_cosine_similarity(pv, vec))) end, 0.0) end as step, lower(before) as a, lower(definition) as b from pl),
pk as (select *, list_max([{_SCORES}]) as top from pm),
tr as (select form, lang, id, date, case when vec is null then 0.0 else round(list_sum(list_filter(vec, lambda x, i: (i - 1) % 2 = 0)) / 16 * 2, 4) + 0.0 end as x, case when vec is null then 0.0 else round(list_sum(list_filter(vec, lambda x, i: (i - 1) % 2 = 1)) / 16 * 2, 4) + 0.0 end as y, definition, attestations, confidence,
 round(step, 4) as magnitude, step > 0.2 as shifted, case when step > 0.2 then {_KIND('a', 'b')} end as shift_type, case when step > 0.2 then least(trust, confidence) end as shift_confidence, round(sum(step) over (partition by form, lang order by date, id rows unbounded preceding), 4) as running, prev, step from pk)"""
_DIV = f"with {_V} select a.form, a.lang as a, b.lang as b, round(0.7 * least(1.0, greatest(0.0, 1 - list_cosine_similarity(a.final, b.final))) + 0.3 * least(1.0, abs(round(a.tot, 4) - round(b.tot, 4))), 4) as divergence from t a join t b on a.form = b.form and a.lang < b.lang"
SQL = {
    "word_trajectories": f"with {_P} select form, lang, id, date, x, y, definition, attestations, confidence, magnitude, shifted, shift_type, shift_confidence, running from tr",
    "word_shifts": f"with {_P} select form, lang, id, date, magnitude, shift_type, shift_confidence, printf('distance %.3f at %d', step, date) as evidence from tr where shifted and magnitude >= 0.3",
    "shift_edges": f"with {_P} select prev as source_id, id as target_id, 'SHIFTED_TO' as relationship_type, date as date_of_change from tr where shifted",
    "trajectory_lookup": f"with {_P}, o as (select form, lang, count(*) as own from pt group by all), f as (select form, count(*) as every from pt group by all), q as (select distinct form_normalized as form, language_code as lang from graph_nodes where form_normalized is not null and language_code is not null) select form, lang, coalesce(own, every, 0) as points, case when own is not null then 'language' when every is not null then 'form' else 'none' end as found_by from q left join o using (form, lang) left join f using (form)",
    "divergence_extremes": f"select form, first(p order by divergence, p) as most_similar, first(p order by divergence desc, p) as most_divergent from (select form, a || '-' || b as p, divergence from ({_DIV})) group by form",
    "field_evolution": f"with {_P}, x as (select unnest(semantic_fields) as field, cast(floor(date / 100) * 100 as int) as century, vec from pt where date is not null and vec is not null), n as (select field, century, count(*) as n from x group by all), u as (select field, century, unnest(vec) as v, generate_subscripts(vec, 1) as i from x), a as (select field, century, i, avg(v) as v from u group by all), c as (select field, century, list(v order by i) as c from a group by all), l as (select *, lag(c) over (partition by field order by century) as p from c) select field, century, n, case when p is null then null when list_sum(list_transform(c, lambda x: x * x)) = 0 or list_sum(list_transform(p, lambda x: x * x)) = 0 then 0.0 else round(least(1.0, greatest(0.0, 1 - list_cosine_similarity(p, c))), 4) end as moved from l join n using (field, century)",
    "vector_functions": "with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) select a.vec_id, round(list_distance(a.v, b.v), 6) as distance, 1.0::double as unit from v a join v b on b.vec_id = a.vec_id + 1",
    "definition_shifts": f"""with x as (select m.id, lower(n.definition) as a, lower(m.definition_primary) as b from lsr_metadata m join graph_nodes n on neo4j_id = node_id),
y as (select *, list_max([{_SCORES}]) as top from x)
select case when a is null or b is null or a = '' or b = '' then 'unknown' when top.s > 0 then top.k when length(b) / length(a) > 1.5 then 'generalization' when length(b) / length(a) < 0.7 then 'specialization' else 'general' end as shift_type, count(*) as n from y group by 1""",
    "trajectory_points": f"""with {_V} select form, lang, date as id, date, round(list_sum(list_filter(vec, lambda x, i: (i - 1) % 2 = 0)) / len(vec) * 2, 4) + 0.0 as x, round(list_sum(list_filter(vec, lambda x, i: (i - 1) % 2 = 1)) / len(vec) * 2, 4) + 0.0 as y from v""",
    "semantic_shifts": f"with {_V} select form, lang, date as id, date, round(m, 4) as magnitude from m where m > 0.2",
    "drift_stability": f"with {_V} select form, lang, points, round(tot, 4) as total, round(case when points < 2 then 1.0 else greatest(0.0, 1 - shifted / points) end, 4) as stability from t",
    "trajectory_divergence": f"with {_V} select a.form, a.lang as a, b.lang as b, round(0.7 * least(1.0, greatest(0.0, 1 - list_cosine_similarity(a.final, b.final))) + 0.3 * least(1.0, abs(round(a.tot, 4) - round(b.tot, 4))), 4) as divergence from t a join t b on a.form = b.form and a.lang < b.lang",
    "vector_centroids": f"with {_V}, x as (select form, unnest(vec) as v, generate_subscripts(vec, 1) - 1 as place from v) select form, place, round(avg(v), 6) as mean from x group by all",
    "cosine_topk": f"""with {_V}, x as (select form, unnest(vec) as v, generate_subscripts(vec, 1) as place from v), c as (select form, place, round(avg(v), 6) as mean from x group by all), cl as (select form, list(mean order by place) as c from c group by 1),
r as (select a.form as a, b.form as b, round(list_cosine_similarity(a.c, b.c), 6) as cosine from cl a join cl b on a.form <> b.form), k as (select *, row_number() over (partition by a order by cosine desc, b) as rank from r) select a, b, rank, cosine from k where rank <= 5""",
}
