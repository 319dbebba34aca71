"""Records, requests, edges, trajectories, adapters, alerts and hot keys on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexspark import session
from lexspark.functions import collections as C
from lexspark.functions import vectors as V
from lexspark.operators import contact, corpus, drift, edges, graph, quality, resolve, store
from lexspark.sources import adapters
from lexspark.streaming import alerts


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_letters_outside_ascii_differ(spark):
    a = spark.createDataFrame([(1, "ang", "þorn", None, None, None)], "id bigint, lang string, form string, definition string, year int, source string")
    b = spark.createDataFrame([("x", "ang", "ðorn", None, None, None, None), ("y", "ang", "þorn", None, None, None, None)], "id string, lang string, form string, definition string, date_start int, date_end int, sources array<string>")
    assert rows(resolve.features(a, b), "lsr_id", "distance", "exact") == {("x", 1, 0.0), ("y", 0, 1.0)}


def test_open_contact_types(spark):
    d = spark.createDataFrame([("seafaring and ships",), ("warfare",), ("kinship",), ("herding",), (None,)], "d string")
    got = {r["d"]: [k for k in contact.CONTACT_PARTS if r[k]] for r in d.select("d", *[contact.speaks_for(F.col("d"), k).alias(k) for k in contact.CONTACT_PARTS]).collect()}
    assert got["warfare"] == ["conquest"] and got["kinship"] == ["trade"] and got["herding"] == [] and got["seafaring and ships"] == ["trade"] and got[None] == []
    b = spark.createDataFrame([("a", "b", y) for y in (None, 1400, 1500, 1600)], "donor string, recipient string, year int")
    assert contact.between(b, 1450, 1550).count() == 2 and contact.between(b).count() == 4


def test_records(spark):
    base = spark.createDataFrame([("1", "a", 1, 0.5), ("2", "b", 1, None)], "id string, form string, version int, confidence double")
    new = spark.createDataFrame([("2", "z"), ("3", "c"), ("3", "c"), (None, "n")], "id string, form string")
    assert rows(store.created(base, new), "id", "form", "version") == {("1", "a", 1), ("2", "b", 1), ("3", "c", 1)}
    change = spark.createDataFrame([("1", None, 0.5), ("2", "bb", None), ("9", "x", 1.0)], "id string, form string, confidence double")
    up = store.updated(base, change, "form", "confidence")
    assert rows(up, "id", "form", "version", "confidence") == {("1", "a", 1, 0.5), ("2", "bb", 2, None)}
    assert rows(store.current(base.unionByName(up)), "id", "version") == {("1", 1), ("2", 2)}
    assert store.get(base, "1").count() == 1
    with pytest.raises(KeyError):
        store.get(base, "9")
    asked = spark.createDataFrame([("1",), ("9",), (None,), ("1",)], "id string")
    assert sorted((r["id"] or "", r["found"]) for r in store.lookup(base, asked).collect()) == [("", False), ("1", True), ("1", True), ("9", False)]
    log = spark.createDataFrame([("1", "delete", 1), ("1", "restore", 2), ("2", "delete", 1), ("1", "update", 9)], "entity_id string, action string, created_at int")
    assert rows(store.deleted(base, log), "id") == {("1",)}


def test_merge(spark):
    r = spark.createDataFrame([("1", "k", "one"), ("2", "k", "two"), ("3", "k", "one"), ("4", None, "x"), ("5", None, None)], "id string, k string, definition_primary string")
    a = spark.createDataFrame([("a", "1", 1500), ("b", "2", 1600), ("a", "2", 1500), ("c", "9", 1)], "id string, lsr_id string, text_date int")
    assert rows(store.merge_log(r, ["k"]), "target_id", "source_id") == {("1", "2"), ("1", "3"), ("4", "5")}
    assert rows(store.merged_attestations(r, a, ["k"]), "lsr_id", "id") == {("1", "a"), ("1", "b")}
    assert rows(store.alternates(r, ["k"]), "survivor", "definition") == {("1", "two")}
    assert store.merge_log(r.limit(0), ["k"]).count() == 0


def test_requests(spark):
    x = spark.createDataFrame([(1, "ok", "eng", None, None, 1500), (2, "", "e1", "d" * 2001, 4000, None), (3, "x" * 201, None, "", -20000, 1)], "id int, form string, language_code string, definition string, date_start int, date_end int")
    assert {r["id"]: r["issues"] for r in store.create_requests(x).collect()} == {1: "", 2: "form,language_code,definition,date_start", 3: "form,language_code,date_start"}
    t = spark.createDataFrame([(1, "long enough text", "en", None), (2, " short   ", "english language", 9999), (3, None, None, None)], "id int, text string, language string, claimed int")
    assert {r["id"]: r["issues"] for r in store.text_requests(t).collect()} == {1: "", 2: "text,language,claimed", 3: "text,language"}
    assert store.search_arguments("a", limit=5)["limit"] == 5
    for bad in ({"query": ""}, {"query": "a", "limit": 0}, {"query": "a", "offset": -1}, {"query": "a", "date_start": 9999}, {"query": "a", "language": "x" * 11}):
        with pytest.raises(ValueError):
            store.search_arguments(**bad)
    q = spark.createDataFrame([("MATCH (n) detach delete n",), ("select 1",), (None,)], "q string")
    assert [r["d"] for r in q.select(store.denied(F.col("q")).alias("d")).collect()] == [True, False, False]
    v = spark.createDataFrame([("1", "pass"), ("2", "warn"), ("3", "fail"), (None, "fail")], "id string, verdict string")
    assert rows(store.routed(v), "route") == {("production",), ("production, flagged",), ("validation queue",), ("log",)}
    assert rows(store.pages(spark.createDataFrame([("a", 45), ("b", 0)], "k string, n int")), "k", "page", "has_next") == {("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)}


def words(spark, *rows_):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows_)], "entry_id string, lang string, form string, etymology string, year int")


def test_edges(spark):
    langs = spark.createDataFrame([("Vardic", "vrd"), ("Old Vardic", "ovd"), ("Yltic", "ylt")], "name string, lang string")
    w = words(spark, ("vrd", "c d", "Of Old Vardic origin: a → b → c d. More.", 1500), ("vrd", "x", "From Old Vardic y, ultimately from Yltic z “q”.", 1600), ("vrd", "x", "From Old Vardic y, ultimately from Yltic z.", 1500), ("vrd", "m", "Inherited; compare Old Vardic n and Yltic o.", None), ("vrd", "p", "Borrowed from Nowhere q, itself.", 1), ("vrd", "r", None, 1), ("vrd", None, "A derivative of s with x", 1), ("vrd", "s", "A derivative of s with loss", 1))
    e = edges.from_etymologies(w, langs)
    got = rows(e, "source_id", "target_id", "relationship_type", "first_year", "witnesses")
    assert got == {
        ("vrd:c d", "ovd:b", "DESCENDS_FROM", 1500, 1), ("ovd:b", "ovd:a", "DESCENDS_FROM", 1500, 1), ("vrd:x", "ovd:y", "BORROWED_FROM", 1500, 2), ("ovd:y", "ylt:z", "DESCENDS_FROM", 1500, 2),
        ("ovd:n", "vrd:m", "COGNATE_OF", None, 1), ("vrd:m", "ylt:o", "COGNATE_OF", None, 1),
    }
    assert ("ovd:b", "descendant", "vrd:c d") in rows(edges.id_lists(e), "id", "list", "other")
    gone = spark.createDataFrame([("ovd:b",)], "id string")
    assert edges.without(e, gone).count() == 4
    starts = spark.createDataFrame([("vrd:c d",), ("ovd:a",), ("alone",)], "id string")
    assert rows(graph.chains(e, starts), "start", "proto", "depth") == {("vrd:c d", "ovd:a", 2), ("ovd:a", "ovd:a", 0), ("alone", "alone", 0)}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_id string, target_id string").withColumn("relationship_type", F.lit("DESCENDS_FROM"))
    assert rows(graph.chains(loop, spark.createDataFrame([("a",)], "id string")), "proto", "depth") == {("d", 3)}
    years = spark.createDataFrame([("vrd:c d", 1400), ("ovd:b", 1450)], "id string, first int")
    assert rows(edges.backwards(e, years), "source_id", "target_id", "child", "ancestor") == {("vrd:c d", "ovd:b", 1400, 1450)}
    fam = spark.createDataFrame([("vrd", "A"), ("ovd", "A"), ("ylt", "B")], "lang string, family string")
    assert rows(edges.implausible(e, fam), "source_id") == {("ovd:y",)}


def test_paths(spark):
    square = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (9, 9)], "source_id int, target_id int").withColumn("relationship_type", F.lit("COGNATE_OF"))
    start = spark.createDataFrame([(1,)], "id int")
    p = rows(graph.shortest_paths(square, start, 3), "id", "hops", "path")
    assert p == {(2, 1, "1 - 2"), (3, 1, "1 - 3"), (4, 2, "1 - 2 - 4"), (4, 2, "1 - 3 - 4"), (5, 3, "1 - 2 - 4 - 5"), (5, 3, "1 - 3 - 4 - 5")}
    assert graph.shortest_paths(square, start, 3, 1).filter("id = 4").count() == 1
    assert graph.shortest_paths(square, start, 3, 10, "BORROWED_FROM").count() == 0
    assert rows(graph.neighbours(square, start, 2), "id", "depth") == {(2, 1), (3, 1), (4, 2)}


def test_cycles_of_any_length(spark):
    n = 14
    ring = [(i, (i + 1) % n) for i in range(n)] + [(n, 0), (5, 50), (50, 51), (51, 52), (52, 51), (60, 60), (61, 60)]
    e = spark.createDataFrame(ring, "source_id int, target_id int").withColumn("relationship_type", F.lit("DESCENDS_FROM"))
    assert rows(graph.on_cycles(e), "id") == {(i,) for i in range(n)} | {(51,), (52,), (60,)}
    assert graph.on_cycles(e.limit(0)).count() == 0


def test_trajectories(spark):
    s = spark.createDataFrame([("f", "l", "1", 1000, [1.0, 0.0], "narrow tool", 0.9, 2), ("f", "l", "2", 1100, [0.0, 1.0], "any broad tool", 0.4, 1), ("f", "l", "3", None, [1.0, 1.0], "x", 0.1, 0), ("f", "m", "4", 1200, [], None, None, 0)], "form string, lang string, id string, date int, vec array<double>, definition string, confidence double, attestations int")
    t = {r["id"]: r for r in drift.trajectory(s).collect()}
    assert set(t) == {"1", "2", "4"} and t["2"]["shifted"] and t["2"]["shift_type"] == "generalization" and t["2"]["shift_confidence"] == 0.4 and t["2"]["running"] == 1.0 and not t["4"]["shifted"]
    assert rows(drift.shift_rows(s), "id", "evidence") == {("2", "distance 1.000 at 1100")} and rows(drift.shift_edges(s), "source_id", "target_id") == {("1", "2")}
    asked = spark.createDataFrame([("f", "l"), ("f", "z"), ("g", "l")], "form string, lang string")
    assert rows(drift.found_or_form(asked, s), "form", "lang", "points", "found_by") == {("f", "l", 3, "language"), ("f", "z", 4, "form"), ("g", "l", 0, "none")}
    assert [len(r["v"]) for r in spark.createDataFrame([("two words",), ("",), (None,)], "t string").select(F.coalesce(V.embedded(F.col("t")), F.array().cast("array<double>")).alias("v")).collect()] == [16, 0, 0]


def test_adapters(spark, tmp_path):
    f = tmp_path / "words.jsonl"
    f.write_text("\n".join([*(json.dumps({"title": f"w{i}"}) for i in range(7)), "{broken", json.dumps({"no": 1}), json.dumps({"title": "last"})]))
    x = adapters.scan(spark, str(f), batch_size=4)
    assert {r["key"] for r in x.collect()} == {*(f"w{i}" for i in range(7)), "last"} and x.rdd.getNumPartitions() == 3
    assert {r["key"] for r in adapters.scan(spark, str(f), batch_size=2, offset=2, limit=3).collect()} == {"w2", "w3", "w4"}
    known = spark.createDataFrame([("eng", "Own English"), ("xxx", "X")], "iso_code string, name string")
    got = dict(rows(adapters.reference_languages(spark, known), "iso_code", "name"))
    assert got["eng"] == "Own English" and got["lat"] == "Latin" and got["xxx"] == "X"
    forms = spark.createDataFrame([("1", "l1", "p1", "aqua"), ("2", "l9", None, "x")], "ID string, Language_ID string, Parameter_ID string, Form string")
    e = adapters.cross_linguistic(forms, spark.createDataFrame([("l1", "Latin", "lat")], "ID string, Name string, ISO639P3code string"), spark.createDataFrame([("p1", "WATER")], "ID string, Name string"))
    assert {(r["source_id"], r["language_code"], tuple(r["definitions"])) for r in e.collect()} == {("cldf-1", "lat", ("WATER",)), ("cldf-2", None, ())}
    assert [r["line"] for r in adapters.csv_lines(spark.createDataFrame([('a"b', None, 1)], "x string, y string, z int")).collect()] == ['"a""b",,"1"']
    adapters.dump(spark.createDataFrame([(1, "2024-01-03 10:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz")), "t", str(tmp_path / "dump"))
    assert (tmp_path / "dump" / "week=2024-01-01").exists()


def test_alerts(spark):
    x = spark.createDataFrame([(1, "2024-01-01 01:00:00", "ok", 0.9), (2, "2024-01-01 02:00:00", "Failed ", 0.9), (3, "2024-01-04 01:00:00", "ok", 0.9), (4, None, "ok", 0.1), (5, "2024-01-08 01:00:00", "ok", 0.2)], "id int, t string, status string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {str(r["day"]) for r in alerts.silent_days(x, "t").collect()} == {"2024-01-02", "2024-01-03", "2024-01-05", "2024-01-06", "2024-01-07"}
    assert {(str(r["day"]), r["share"]) for r in alerts.failing_days(x, "t").collect()} == {("2024-01-01", 0.5)}
    assert {(str(r["day"]), r["moved"]) for r in alerts.moved_means(x, "t", "v").collect()} == {("2024-01-08", 0.7)}
    assert alerts.silent_days(x.limit(0), "t").count() == 0
    q = x.select(F.col("t").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    assert {r["open"] for r in alerts.long_queues(q, 2).collect()} == {3, 4}


def test_collections(spark):
    x = spark.createDataFrame([(["<a> ", "", None, "b"], {"a": "1"}, "éː"), (None, None, None)], "l array<string>, m map<string,string>, t string")
    more = F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))
    got = x.select(C.sanitized_list(F.col("l")).alias("l"), C.merged_maps(F.col("m"), more).alias("m"), C.composed(F.col("t")).alias("t")).collect()
    assert got[0]["l"] == ["&lt;a&gt;", "b"] and got[0]["m"] == {"a": "2", "b": "3"} and got[0]["t"] == "éː" and got[1]["l"] is None and got[1]["m"] == {"a": "2", "b": "3"} and got[1]["t"] is None


def test_strata(spark):
    r = spark.createDataFrame([(f"i{k}", "A" if k % 3 else None, k % 2) for k in range(300)], "id string, family string, period int")
    got = corpus.split(r, ["family", "period"]).groupBy("family", "period", "part").count().collect()
    for family in ("A", None):
        for period in (0, 1):
            n = {x["part"]: x["count"] for x in got if x["family"] == family and x["period"] == period}
            assert abs(n["train"] / sum(n.values()) - 0.8) < 0.02 and abs(n["validation"] / sum(n.values()) - 0.1) < 0.02


def test_queue_places(spark):
    v = spark.createDataFrame([("a", None, 1, "pending", 1), ("b", None, 2, " Pending", 2), ("c", None, 1, "pending", 0), ("d", "x", None, "pending", 1), ("e", "x", 3, "done", 1), ("f", "x", 3, "pending", 1)], "id string, assigned_to string, priority int, status string, created_at int")
    assert rows(quality.queue(v), "id", "place") == {("b", 1), ("c", 2), ("a", 3), ("f", 1), ("d", 2)}


def test_split_join(spark):
    big = session.written(spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"))
    small = session.written(spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int"))
    for how in ("inner", "left"):
        want = rows(big.join(small, "k", how), "k", "id", "v")
        assert rows(session.split_join(big, small, ["k"], how), "k", "id", "v") == want
    assert session.split_join(big.limit(0), small, ["k"]).count() == 0
    folder = session.shared_dir(spark)
    assert folder.startswith("file:")


def test_release(spark):
    t = session.written(spark.range(3))
    assert t.count() == 3 and session.release(spark) >= 1 and not session._written
