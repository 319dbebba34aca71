"""Operators on small fixtures: branches that the tables don't reach, edge cases, brute force."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions import vectors as V
from lexspark.operators import contact, corpus, dating, drift, graph, learning, quality, records, references, resolve
from lexspark.sources import tables, wikitext
from lexspark.streaming import metrics


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


# -- text and years


@pytest.mark.parametrize(("t", "year", "strict"), [("500 BCE", -500, -500), (" 44 bc", -44, -44), ("1500x", 1500, None), ("-500", None, None), ("1066 ad", 1066, 1066), ("", None, None), ("x", None, None), (None, None, None)])
def test_years(spark, t, year, strict):
    c = F.lit(t).cast("string")
    assert one(spark, T.parse_year(c)) == year and one(spark, T.strict_year(c)) == strict


@pytest.mark.parametrize(("y", "label", "start"), [(1500, "16th century CE", 1500), (0, "1th century CE", 0), (-100, "2th century BCE", -200), (-1, "1th century BCE", -100)])
def test_centuries(spark, y, label, start):
    got = one(spark, T.century_label(F.lit(y)))
    assert got == label and one(spark, T.label_range(F.lit(got)))["start"] == start
    assert one(spark, T.century_start(F.lit(-150))) == -200


def test_text(spark):
    assert one(spark, T.normal_form(F.lit("Wäter ÉTÉ æß"))) == "water ete æß"
    assert one(spark, T.sanitized(F.lit(" <b>'x' & \"y\" "))) == "&lt;b&gt;&#x27;x&#x27; &amp; &quot;y&quot;"
    assert one(spark, T.truncated(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, T.ascii_words(F.lit("The wæter abc_d été No9 ok"))) == ["the", "ok"]
    assert one(spark, T.jaccard(T.word_set(F.lit("a b")), T.word_set(F.lit("b c")))) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(T.word_set(F.lit("")), T.word_set(F.lit(" ")))) == 0
    assert one(spark, T.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, T.overlap_ratio(*[F.lit(float(x)) for x in (100, 200, 150, 250)])) == 0.5
    assert one(spark, T.overlap_ratio(F.lit(100.0), F.lit(100.0), F.lit(50.0), F.lit(150.0))) == 1.0
    assert one(spark, T.date_proximity(F.lit(0), F.lit(1), F.lit(2))) == 0.5 and one(spark, T.date_proximity(F.lit(1250), F.lit(1300), F.lit(1400))) == 0.5
    assert one(spark, T.midpoint(F.lit(-101), F.lit(0))) == -101
    assert one(spark, T.suffix_change(F.lit("water"), F.lit("watos"))) == "-er > -os" and one(spark, T.suffix_change(F.lit("ab"), F.lit("abc"))) is None


def test_vectors(spark):
    a, z, e = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array().cast("array<double>")
    b = F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, V.drift(a, b)) == 1 and one(spark, V.drift(a, a)) == 0 and one(spark, V.drift(a, z)) == 0 and one(spark, V.drift(a, e)) == 0
    assert one(spark, V.unit(b)) == [0.0, 1.0] and one(spark, V.unit(z)) == [0.0, 0.0]
    assert one(spark, V.euclidean(a, b)) == pytest.approx(5**0.5)


# -- dating


def lex(spark, *rows):
    return spark.createDataFrame(rows, "form string, lang string, date_start int, date_end int")


def test_dating_branches(spark):
    x = lex(spark, ("alpha", "en", 1000, 1100), ("beta", "en", 1050, 1200), ("gamma", "en", 1500, 1600), ("delta", "en", 1700, 1650), ("open", "en", None, None))
    docs = spark.createDataFrame([(1, "en", "the alpha beta", 900), (2, "en", "alpha gamma", 1000), (3, "en", "gamma delta alpha", None), (4, "en", "the of", 1000), (5, "en", None, 1000), (6, None, "alpha", 1000), (7, "en", "open alpha", 1500)], "doc_id bigint, lang string, text string, year int")
    got = {r["doc_id"]: (r["date_start"], r["date_end"], r["confidence"]) for r in dating.date_texts(docs, x).collect()}
    assert got[1] == (1050, 1100, 1.0)
    assert got[2] == (1250, 1350, 0.5)  # medians 1250 and 1350; no period holds the middle
    assert got[4] == got[5] == got[6] == (0, 0, 0.0)
    assert got[7] == (1000, 1100, 0.75)
    v = {r["doc_id"]: (r["found"], r["suspicious"], r["verdict"], r["confidence"]) for r in dating.verdicts(docs, x).collect()}
    assert v[1] == (2, 2, "suspicious", 0.6) and v[2] == (1, 1, "suspicious", 0.6) and v[4] == (0, 0, "consistent", 1.0) and 3 not in v
    assert dating.date_texts(docs.limit(0), x).count() == 0 and dating.date_texts(docs, x.limit(0)).count() == 7


def test_dating_fallback(spark):
    x = lex(spark, ("one", "en", 1500, 1400))
    docs = spark.createDataFrame([(1, "en", "one")], "doc_id bigint, lang string, text string").withColumn("text", F.lit("uno onex one one"))
    x = x.unionByName(lex(spark, ("uno", "en", 1500, 1400)))
    r = dating.date_texts(docs, x.filter("form = 'uno'")).first()
    assert (r["date_start"], r["date_end"]) == (1400, 1500)


# -- references


REF = "table_name string, record_id string, ref string, at timestamp_ntz"


def test_references(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(6)] + ["ffffffff-0000-4000-8000-000000000001"]
    parents = spark.createDataFrame([(i, day(1)) for i in ids[:3]] + [(ids[4], day(20)), (ids[6], day(1)), ("odd key", day(1)), (None, day(1))], "key string, created timestamp_ntz")
    refs = [("t", "a", ids[0], day(5)), ("t", "b", " {" + ids[1].upper() + "} ", day(5)), ("t", "c", ids[3], day(5)), ("t", "d", ids[5], day(5)), ("t", "e", ids[4], day(5)), ("t", "f", ids[4], day(25)), ("t", "g", ids[6], day(5)), ("t", "h", None, day(5)), ("t", "i", "  ", day(5)), ("t", "j", "odd key", day(5)), ("t", "k", "odder key", day(5)), ("t", "l", ids[4], None), ("t", "m", ids[3], None)]
    audit = spark.createDataFrame([("delete", "lsr", ids[3], day(2)), ("restore", "lsr", ids[3], day(1)), ("delete", "lsr", ids[5], day(2)), ("restore", "lsr", ids[5], day(3)), ("update", "lsr", ids[5], day(4)), ("delete", "graph_node", ids[5], day(9))], "action string, entity_type string, entity_id string, created_at timestamp_ntz")
    r = spark.createDataFrame(refs + refs[:4], REF)
    got = {(x["record_id"], x["kind"]) for x in references.orphans(r, parents, audit, "lsr", references.clean_uuid).collect()}
    assert got == {("c", "deleted"), ("d", "missing"), ("e", "late"), ("k", "missing"), ("m", "deleted")}
    assert references.orphans(r.limit(0), parents, audit, "lsr", references.clean_uuid).count() == 0
    assert references.orphans(r, parents.limit(0), audit.limit(0), "lsr", references.clean_uuid).filter("kind = 'missing'").count() == 11


def test_runs(spark):
    keys = [1, 2, 3, 7, 8, 20, (1 << references.RUN_BITS) - 1, 1 << references.RUN_BITS]
    p = spark.createDataFrame([(f"lsr:{k:09d}", dt.datetime(2024, 1, 1)) for k in keys], "_key string, created timestamp_ntz")
    got = {(r["lo"], r["end_lo"]) for r in references.runs(references._keyed(p)).collect()}
    assert got == {(1, 3), (7, 8), (20, 20), (keys[-2], keys[-2]), (keys[-1], keys[-1])}


# -- resolution


def test_segment_join_is_lossless(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    a, b = {make() for _ in range(120)}, {make() for _ in range(120)}
    fa = spark.createDataFrame([("x", w) for w in a] * 2 + [(None, "ab"), ("x", None), ("x", "")], "lang string, form string")
    fb = spark.createDataFrame([("x", w) for w in b] + [("y", "ab")], "lang string, form string")

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    got = {(r["fa"], r["fb"]): r["distance"] for r in resolve.form_pairs(fa, fb).collect()}
    assert got == {(s, t): d for s in a for t in b if (d := distance(s, t)) <= 2}


def test_resolution(spark):
    store = spark.createDataFrame([("a", "eng", "water", "clear liquid", 1000, 2000, ["w"]), ("b", "eng", "wader", None, None, None, None), ("c", "deu", "wasser", "flüssig", 1, 2, [])], "id string, lang string, form string, definition string, date_start int, date_end int, sources array<string>")
    entries = spark.createDataFrame([(1, "eng", "water", "clear liquid", 1200, "w"), (2, "eng", "watar", None, None, None), (3, "eng", "fire", "x", 1, "w"), (4, None, "water", "x", 1, "w")], "id bigint, lang string, form string, definition string, year int, source string")
    got = {r["entry_id"]: (r["action"], r["lsr_id"]) for r in resolve.resolution(entries, store).collect()}
    assert got == {1: ("auto_merge", "a"), 2: ("create_new", None), 3: ("create_new", None), 4: ("create_new", None)}


# -- contact, drift


def test_contact(spark):
    rows = [("lat", "eng", 1100 + i, f"for{i}", "forum", None, "a god of war") for i in range(6)] + [("eng", "lat", None, "x", "y", ["food"], None)]
    b = spark.createDataFrame(rows, "donor string, recipient string, year int, form string, source_form string, fields array<string>, definition string")
    e = {(r["language"], r["direction"]): r for r in contact.events(b).collect()}
    assert set(e) == {("eng", "incoming"), ("lat", "outgoing")}
    assert e["eng", "incoming"]["contact_type"] == "conquest" and e["eng", "incoming"]["borrowings"] == 6
    i = contact.intensity(b).first()
    assert (i["a"], i["b"], i["n"], i["ab"], i["dominant"]) == ("eng", "lat", 7, 1, "lat")
    assert contact.events(b.limit(0)).count() == 0


def test_drift(spark):
    rows = [("w", "eng", 1, 1, [1.0, 0.0]), ("w", "eng", 2, 2, []), ("w", "eng", 3, 3, [0.0, 1.0]), ("w", "eng", None, 4, [1.0, 1.0]), ("w", "deu", 1, 5, [1.0, 0.0])]
    s = spark.createDataFrame(rows, "form string, lang string, date int, id int, vec array<double>")
    assert drift.shifts(s).count() == 0  # the empty vector between them breaks the shift
    t = {r["lang"]: (r["points"], r["total"], r["stability"]) for r in drift.totals(s).collect()}
    assert t == {"eng": (3, 1.0, 1.0), "deu": (1, 0.0, 1.0)}
    kinds = [("a thing", "a general broad thing", "generalization"), ("abc", "abc and much more to say", "generalization"), ("a very long text", "short", "specialization"), (None, "x", "unknown"), ("abcd", "abce", "general")]
    for a, b, k in kinds:
        assert one(spark, drift.shift_type(F.lit(a).cast("string"), F.lit(b))) == k


# -- graph


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "DESCENDS_FROM") for a, b in pairs], "source_id bigint, target_id bigint, relationship_type string")


def test_graph(spark):
    e = edges(spark, (5, 4), (4, 3), (3, 1), (2, 1), (10, 11), (11, 12), (12, 10), (13, 10))
    assert {(r["id"], r["root"], r["depth"]) for r in graph.roots(e.filter("source_id < 10")).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 1, 3)}
    assert {r["id"] for r in graph.roots(e, 5).filter("root is null").collect()} == {10, 11, 12, 13}
    assert {r["id"] for r in graph.on_cycles(e, 5).collect()} == {10, 11, 12}
    start = spark.createDataFrame([(5,)], "id bigint")
    assert {(r["id"], r["depth"]) for r in graph.walk(graph.both_ways(e), start, 9).collect()} == {(5, 0), (4, 1), (3, 2), (1, 3), (2, 4)}
    with pytest.raises(ValueError):
        graph.of_types(e, "DROP")


# -- wikitext


PAGE = """ignored
==English==
===Etymology===
From {{inh|en|enm|watir}}, from [[Old English|OE]] ''wæter''.
===Noun===
{{IPA|en|/ˈwɔːtə/}}
# A [[clear]] liquid.
#: not this
# {{lb|x}} ab
==Old Norse==
===Verb===
12th century or 1350. {{cog|la|unda}}
"""


def test_wikitext(spark):
    p = spark.createDataFrame([("water", PAGE), ("none", None), ("bare", "no heading")], "title string, wikitext string")
    got = {r["language_code"]: r for r in wikitext.entries(p).collect()}
    assert set(got) == {"eng", "non"}
    e = got["eng"]
    assert (e["source_id"], e["form_phonetic"], e["definitions"], e["part_of_speech"], e["etymology"]) == ("wikt-water-eng", "ˈwɔːtə", ["A clear liquid."], ["noun"], "From , from OE wæter.")
    assert got["non"]["definitions"] == ["(definition not extracted)"] and got["non"]["date_attested"] == 1101
    assert wikitext.entries(p, ["Old Norse"]).count() == 1
    assert {(r["relationship_type"], r["language_code"], r["form"]) for r in wikitext.template_edges(p).collect()} == {("DESCENDS_FROM", "enm", "watir"), ("COGNATE_OF", "la", "unda")}


def test_paged_source(spark):
    spark.dataSource.register(wikitext.PagedSource)
    x = spark.read.format("paged").option("count", 25).option("batch_size", 10).load()
    assert x.count() == 25 and x.rdd.getNumPartitions() == 3


# -- records, quality, corpus, models


def test_search(spark):
    x = spark.createDataFrame([("1", "Wäter", "water", "eng", 1500, 2000, 0.5), ("2", "wine", "wine", "eng", None, None, None)], "id string, form_orthographic string, form_normalized string, language_code string, date_start int, date_end int, confidence_overall double")
    assert {r["id"] for r in records.search(x, form="WÄT").collect()} == {"1"}
    assert {r["id"] for r in records.search(x, date_start=1600).collect()} == {"2"}
    assert {r["id"] for r in records.search(x, date_start=1600, mode="overlap").collect()} == {"1"}
    assert [r["id"] for r in records.page(x).collect()] == ["2", "1"]
    with pytest.raises(ValueError):
        records.page(x, 1000)


def test_models(spark):
    docs = spark.createDataFrame([(i, f"old word{i % 2} thing" if i % 2 else f"new word{i % 2} item", 1000 + 900 * (i % 2)) for i in range(40)] + [(99, None, None)], "doc_id bigint, text string, year int")
    got = learning.classify(docs, learning.fit_dating(docs)).filter("claimed is not null").collect()
    assert all(r["period"] == r["claimed"] for r in got)
    a = np.random.default_rng(1).normal(size=(20, 4))
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(4, 4)))
    assert np.allclose(a @ learning.procrustes(a, a @ q), a @ q)


def test_trees(spark):
    t = lambda *c: spark.createDataFrame([(list(x),) for x in c], "clade array<string>")
    assert corpus.robinson_foulds(t("ab", "abc"), t("ab", "bc")).first()["distance"] == 2
    assert one(spark, quality.calibrated(F.lit(0.95), F.lit(3), F.lit(True), F.lit(False))) == 1.0
    assert one(spark, quality.verdict(F.lit(0), F.lit(2))) == "warn"


# -- streaming


def test_limiter():
    ok, kept = metrics.admit([0, 1, 2, 3, 61.5, 62], [], 3, 60)
    assert ok == [True, True, True, False, True, True] and kept == [61.5, 62]


def events(spark, n=200):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(seconds=7 * i), i % 5, "click" if i % 3 else "error", float(i)) for i in range(n)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"/tmp/lexspark-test-{time.time_ns()}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "e"))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    stream = lambda: metrics.read_events(spark, str(tmp_path / "e"), schema)
    got = run(spark, metrics.counters(stream(), "5 minutes"), "counted", "complete")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(metrics.counters(e, "5 minutes"))
    limited = run(spark, metrics.limited(stream(), 3, 60), "limited", "append")
    assert limited.count() == 200
    batch = {r["event_id"]: r["accepted"] for r in metrics.limited_batch(e, 3, 60).collect()}
    assert {r["event_id"]: r["accepted"] for r in limited.collect()} == batch
    once = run(spark, metrics.idempotent(stream()).select("event_id"), "once", "append")
    assert once.count() == 200


def test_route(spark, tmp_path):
    metrics.route(events(spark, 9), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_dedup(spark):
    x = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2)], "id string, v int")
    assert tables.dedup_deliveries(x, "id").count() == 3


def test_relations(spark):
    from lexspark.functions import phonetics
    from lexspark.operators import relations

    assert one(spark, phonetics.code(F.lit("Robert"))) == "R163" and one(spark, phonetics.code(F.lit(""))) == ""
    assert one(spark, phonetics.distance(F.lit("ˈabc"), F.lit("abd"))) == pytest.approx(1 / 3) and one(spark, phonetics.distance(F.lit(""), F.lit(""))) == 0
    assert one(spark, phonetics.sound_law(F.lit("pater bhrater"))) == "father brather"
    rng = random.Random(1)
    rows = [("x", i, s := rng.randint(-500, 500), s + rng.randint(-20, 400)) for i in range(80)] + [("x", 99, None, 5)]
    a = spark.createDataFrame(rows, "k string, id int, s int, e int")
    got = {(r["a_id"], r["b_id"]) for r in relations.overlapping(a, a, ["k"]).collect()}
    ok = [r for r in rows if r[2] is not None and r[2] <= r[3]]
    assert got == {(x[1], y[1]) for x in ok for y in ok if x[2] <= y[3] and y[2] <= x[3]}
    assert relations.overlapping(a, a, ["k"]).count() == len(got)
    assert relations.read_only_sql("select 'drop' -- drop\n;") == "select 'drop'"
    for bad in ("drop table x", "select 1; drop table x", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            relations.read_only_sql(bad)


def test_every_borrowing_has_a_recipient(spark):
    from lexspark.plans import contact as P

    languages = spark.createDataFrame([("Latin", "lat", ["Lingua Latina", "both"]), ("Greek", "grc", ["both", "Latin"])], "name string, iso_code string, alt_names array<string>")
    rows = [("Latin", "lat", "lat"), (" latin ", None, "lat"), ("lingua  latina", "grc", "lat"), ("both", " GRC", "grc"), ("Latyn", "LAT ", "lat"), (None, "grc", "grc"), ("", None, "unknown"), ("Elvish", "qya", "unknown"), ("Latin", "lat", "lat")]
    got = P.recipients(spark.createDataFrame(rows, "language string, language_code string, want string"), languages).collect()
    assert len(got) == len(rows) and all(r["recipient"] == r["want"] for r in got)


def test_every_borrowing_stays(spark, sf):
    from lexspark.plans import contact as P

    some, every = P.borrowings(spark, sf), P.borrowings(spark, sf, True)
    assert every.count() > some.count() and some.exceptAll(every).isEmpty()
