"""Problems 1, 4, 5 and 6: language names, survivors, matches, look-alikes."""

from __future__ import annotations

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.llm import canonical, lexemes, lookalike, matching, survivors

LANGS = "iso_code string, name string, alt_names array<string>, script string, score double, word string"
META = (
    "id string, form_orthographic string, form_normalized string, form_phonetic string, language_code string, date_start int, date_end int, period_label string, definition_primary string, "
    "part_of_speech array<string>, source_databases array<string>, confidence_overall double, human_validated boolean, updated_at timestamp_ntz, k string, g string, w string"
)
ENTRY = "entry_id bigint, form string, form_phonetic string, language string, language_code string, definitions array<string>, part_of_speech array<string>, score double, sk string"


@pytest.fixture(scope="module")
def languages(spark):
    rows = [("vrd", "Vardic", ["Vardaska", "Lower Tavric", "vd"], "latin", 1.0, "x"), ("ovd", "Old Vardic", [], "latin", 1.0, "x"), ("mvd", "Middle Vardic", None, "latin", 1.0, "x"), ("plg", "Pelagorn", ["Pelagorika", "pg"], "greek", 1.0, "x"), ("tav-pro", "Proto-Tavric", ["Common Tavric"], "latin", None, None)]
    return spark.createDataFrame(rows, LANGS)


NAMES = {
    ("Vardic", "vrd"): "vrd", ("vadric", None): "vrd", ("VARDIC ", ""): "vrd", ("Vardíc", "vrd."): "vrd", ("Vardic (northern dialect)", ""): "vrd", ("the Vardic tongue", ""): "vrd",
    ("oldvardic", ""): "ovd", ("Vardic, Old", ""): "ovd", ("O. Vardic", ""): "ovd", ("Vardic (Middle)", ""): "mvd", ("Mid. Vardic", None): "mvd", ("vd", ""): "vrd", ("[vrd]", ""): "vrd", ("ovd: Old Vardic", ""): "ovd",
    ("Pelgaorn", None): "plg", ("P-Tavric", ""): "tav-pro", ("Lower Tavric", ""): "vrd", ("", "VRD"): "vrd", (None, " plg"): "plg", ("  ", None): "none", (None, None): "none", ("Kesp", "vrd"): "none", ("n/a", ""): "none",
    ("x" * 5000, ""): "none", ("?", "??"): "none",
}


def test_names(spark, languages):
    rows = [(i, None, None, a, b, None, None, 1.0, "s") for i, (a, b) in enumerate(NAMES)] * 2
    got = canonical.resolve(spark.createDataFrame(rows, ENTRY), languages).select("entry_id", "iso_code", "exact").collect()
    assert len(got) == len(rows)
    by = {r["entry_id"]: r for r in got}
    assert {k: by[i]["iso_code"] for i, k in enumerate(NAMES)} == NAMES
    assert [i for i in by if by[i]["exact"]] == [0]


def test_near_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 9)))
    ref = sorted({word() for _ in range(60)})
    tokens = sorted({word() for _ in range(150)} | {"".join([r[1:2], r[:1], r[2:]]) for r in ref})
    a = spark.createDataFrame([(t, True) for t in tokens], "t string, part boolean")
    b = spark.createDataFrame([(r, True, 1.0) for r in ref], "token string, part boolean, idf double")
    got = {(r["t"], r["token"]): round(r["sim"], 9) for r in canonical.near(a, b).collect()}

    def sim(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        d = 1 if row[-1] == 2 and sorted(x) == sorted(y) else row[-1]
        return 1 - d / max(len(x), len(y))

    assert got == {(t, r): round(v, 9) for t in tokens for r in ref if (v := sim(t, r)) >= canonical.MIN_TOKEN}


def test_names_empty(spark, languages):
    empty = spark.createDataFrame([], ENTRY)
    assert canonical.resolve(empty, languages).count() == 0
    one = spark.createDataFrame([(1, None, None, "Vardic", "vrd", None, None, 0.0, "")], ENTRY)
    assert canonical.resolve(one, languages.limit(0)).first()["iso_code"] == "none"


def record(i, form, definition, **kw):
    x = {"form_normalized": form, "form_phonetic": None, "language_code": "vrd", "date_start": 1500, "date_end": 1600, "period_label": None, "part_of_speech": ["noun"], "source_databases": ["A"], "confidence_overall": 0.5, "human_validated": False, "updated_at": dt.datetime(2024, 1, 1)} | kw
    return (i, form, x["form_normalized"], x["form_phonetic"], x["language_code"], x["date_start"], x["date_end"], x["period_label"], definition, x["part_of_speech"], x["source_databases"], x["confidence_overall"], x["human_validated"], x["updated_at"], "k", "g", "w")


def test_survivors(spark):
    rows = [
        record("a", "bráu", "a heavy chisel used for bartering berries", confidence_overall=0.9),
        record("b", "Brau", "heavy chisel with which berries were bartered", confidence_overall=0.4, human_validated=True),
        record("c", "brau", "heavy chisel with which", confidence_overall=0.99, human_validated=True, form_phonetic="brau"),
        record("d", "brau", None, form_phonetic="n/a", date_start=None, date_end=None),
        record("e", "brau", "any hollow ladle; one made for washing eggs"),
        record("f", "brau", "a heavy chisel used for bartering berries", date_start=1900, date_end=1950),
        record("g", "brau", "a heavy chisel used for bartering berries", language_code="olm"),
        record("h", None, None, form_normalized=None),
        record("i", "flo", "tbd"), record("j", "flo", None, confidence_overall=None, updated_at=None, human_validated=None), record("k", "", "x"),
    ]
    x = spark.createDataFrame(rows + rows[:3], META)
    got = {(r["field"], r["lsr_id"]) for r in survivors.field_survivors(x).collect()}
    # c is cut off; d fits both senses of the form, so it joins none
    assert got == {("definition_primary", "b"), ("form_phonetic", "c")}
    m = {r["group_id"]: r for r in survivors.merged(x).collect()}
    assert m["a"]["members"] == 3 and m["a"]["definition_primary"].startswith("heavy chisel") and m["a"]["source_databases"] == ["a"]
    assert m["i"]["members"] == 2 and m["i"]["definition_primary"] is None
    assert survivors.field_survivors(x.limit(0)).count() == 0


def test_skyline_equals_brute_force(spark):
    rows = [("g", str(i), bool(i * 7 % 3 == 0), (i * 37 % 11) / 10, dt.datetime(2020, 1, 1 + i * 13 % 17)) for i in range(120)]
    x = spark.createDataFrame(rows, "g string, id string, validated boolean, confidence double, updated timestamp_ntz")
    got = {r["id"] for r in survivors.skyline(x, ["g"]).collect()}

    def beats(a, b):
        return a[2] >= b[2] and a[3] >= b[3] and a[4] >= b[4] and (a[2:] != b[2:] or a[1] < b[1])

    assert got == {b[1] for b in rows if not any(beats(a, b) for a in rows)}


def test_layers_decide(spark):
    """Without the layers the second record's period would be lost, and a full but dominated one would win nothing."""
    c = "a heavy chisel used for bartering berries"
    rows = [
        record("a", "brau", c, confidence_overall=0.9, human_validated=True, part_of_speech=None, period_label=None, updated_at=dt.datetime(2024, 5, 1)),
        record("b", "brau", c, confidence_overall=0.5, period_label="late", part_of_speech=None, updated_at=dt.datetime(2024, 4, 1)),
        record("c", "brau", c, confidence_overall=0.4, period_label="early", updated_at=dt.datetime(2024, 3, 1)),
        record("d", "brau", c, confidence_overall=0.3, period_label="never", part_of_speech=["verb"], updated_at=dt.datetime(2024, 2, 1)),
    ]
    m = survivors.merged(spark.createDataFrame(rows, META)).collect()
    assert [(r["survivor"], r["period_label"], r["part_of_speech"]) for r in m] == [("a", "late", ["noun"])]
    # the first record alone, which the policy without layers would keep, has neither
    g = survivors.groups(spark.createDataFrame(rows, META)).select("g", "id", *survivors._ranks())
    layers = survivors.layered(g.join(spark.createDataFrame(rows, META).select("id", *survivors.FILLED), "id")).collect()
    assert {r["layer"]: r["id"] for r in layers}[1] == "a"
    # the same without later layers: fields stay empty
    first = next(r for r in layers if r["layer"] == 1)
    assert first["form_orthographic"] == "brau"


def test_synonyms_of_any_number(spark):
    """Long definitions, places with several words and synonyms found beside others; both ways of rewriting agree."""
    forms = [f"f{i}" for i in range(6)]
    base = [f"w{i}" for i in range(12)]
    rows = [(k, sorted([*base, w])) for k in forms for w in ("jug", "pot", "urn")] + [(f"x{i}", sorted(["red", "jug"])) for i in range(9)]
    words = spark.createDataFrame(rows, "k string, w array<string>")
    same = lexemes.learned(words)
    assert {r["word"]: r["same"] for r in same.collect()} == {"pot": "jug", "urn": "jug"}
    x = spark.createDataFrame([("a", ["pot", "red"]), ("b", []), ("c", None), ("a", ["pot", "red"])], "id string, w array<string>")
    one, two = (sorted((r["id"], str(r["cw"])) for r in y.collect()) for y in (lexemes.rewritten(x, same), lexemes.rewritten(x, same, 1)))
    assert one == two and ("a", "['jug', 'red']") in one and len(one) == 4
    assert lexemes.learned(words.limit(0)).count() == 0


def test_synonyms_of_shared_forms_only(spark, monkeypatch):
    """Rounds compare definitions of forms with several ones alone; the words of all forms count for their frequencies."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(3)
    pick = lambda: sorted({rng.choice("abcdefgh"), rng.choice(["jug", "pot", "urn"]), rng.choice(["red", "rosy"])})
    rows = [(f"s{i}", pick()) for i in range(30) for _ in range(4)] + [(f"l{i}", pick()) for i in range(50)] + [("one", ["jug"])]
    seen, synonyms = [], lexemes.synonyms
    monkeypatch.setattr(lexemes, "synonyms", lambda d, *rest: seen.append({r["k"] for r in d.select("k").collect()}) or synonyms(d, *rest))
    got = {r["word"]: r["same"] for r in lexemes.learned(spark.createDataFrame(rows, "k string, w array<string>")).collect()}
    assert seen and all(k.startswith("s") for x in seen for k in x)

    want, new = {}, {"": ""}
    while new:
        d = {(k, frozenset(want.get(t, t) for t in w)) for k, w in rows}
        d = {x for x in d if len(x[1]) > 1}
        f, places, pairs, best = Counter(t for _, w in d for t in w), defaultdict(set), Counter(), {}
        for k, w in d:
            for t in w:
                places[k, w - {t}].add(t)
        for p in places.values():
            top = min(p, key=lambda t: (-f[t], t))
            pairs.update((t, top) for t in p - {top})
        for (t, top), n in pairs.items():
            if n >= 3 and n >= 0.1 * f[t]:
                best[t] = max(best.get(t, (0, "")), (n, top))
        new = {t: top for t, (_, top) in best.items()}
        want = {t: new.get(s, s) for t, s in want.items()} | {t: s for t, s in new.items() if t not in want}
    assert got == want and len(got) > 2


def test_matches(spark, languages):
    meta = [record("a", "bráuker", "a heavy chisel used for bartering berries"), record("b", "brauker", "any hollow ladle; one made for washing eggs"), record("c", "stoumel", None), record("d", "trewaukroen", "to smoke horses with a dented lantern", part_of_speech=["verb"])]
    entries = [
        (1, "BRAUKER", None, "vadric", None, ["heavy chisel with which berries were bartered"], ["noun"], 0.0, ""), (2, "braukker,", None, "Vardic", "vrd", ["chisel of a heavy sort, for bartering berries", "other"], [], 0.0, ""),
        (3, "brauker", None, "Pelagorn", "plg", ["a heavy chisel used for bartering berries"], ["noun"], 0.0, ""), (4, "stoumel", None, "Vardic", "vrd", [], ["noun"], 0.0, ""), (5, "brauker", None, "Vardic", "vrd", None, None, 0.0, ""),
        (6, None, None, "Vardic", "vrd", None, None, 0.0, ""), (7, "trwaukroen", None, "Vardic", "vrd", ["smoking of horses, done with a dented lantern"], ["verb"], 0.0, ""), (8, "brÃ¡uker", None, "Vardic", None, ["a heavy chisel used for bartering berries"], ["noun"], 0.0, ""),
    ]
    e, m = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(meta, META)
    got = matching.match(e, m, languages).collect()
    assert {(r["entry_id"], r["lsr_id"]) for r in got} == {(1, "a"), (2, "a"), (4, "c"), (7, "d"), (8, "a")}
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert matching.match(e.limit(0), m, languages).count() == 0
    assert matching.match(e, m.limit(0), languages).count() == 0


def test_lookalikes(spark, languages):
    good = [record(str(i), f, None, form_phonetic=p) for i, (f, p) in enumerate([("bráu stel", "ˈbɾau"), ("karelo", "ˈkaɾɛlɔ"), ("plomi", "ˈplɔmi"), ("seto", "ˈsɛtɔ"), ("nuva", "n/a")])]
    bad = {
        "cyrillic": "brаu", "fullwidth": "ｂrau", "accent": "bráu", "zero": "br​au", "nbsp": "brau stel", "edge": " brau", "both": "brа́u", "ligature": "ﬂo",
    }
    rows = good * 3 + [record(k, v, None, form_phonetic=None) for k, v in bad.items()] + [record("ipa", "seto", None, form_phonetic="'sεtɔ"), record("null", None, None, form_normalized=None)]
    rows = [r[:2] + ("plomi" if r[0] in bad else r[2],) + r[3:] for r in rows]
    got = {(r["lsr_id"], r["field"]): r["written"] for r in lookalike.deviating(spark.createDataFrame(rows, META), languages).collect()}
    assert set(got) == {(k, "form_orthographic") for k in bad} | {("ipa", "form_phonetic")}
    assert got[("both", "form_orthographic")] == "bráu" and got[("ligature", "form_orthographic")] == "flo" and got[("ipa", "form_phonetic")] == "ˈsɛtɔ"
    assert all(unicodedata.normalize("NFC", v) == v for v in got.values())
    assert lookalike.deviating(spark.createDataFrame([], META), languages).count() == 0


def test_union_find_is_transitive():
    groups = lookalike.classes({"a", "а", "α", "ａ", "á"})
    assert any({"a", "а", "α", "ａ"} <= g for g in groups)
    assert any({"á", "а́", "á"} <= g for g in groups)


def test_stems_and_cuts(spark):
    x = spark.createDataFrame([("in milling: a heavy chisel kept for the bartering of berries",), ("heavy chisel with which berries were bartered",), ("to sort (coins), especially by",), (None,), ("",)], "d string")
    got = [r["s"] for r in x.select(lexemes.stems(F.col("d")).alias("s")).collect()]
    assert got[0] == got[1] and len(got[0]) == 4 and got[3] is None
    cut = [r["s"] for r in x.select(lexemes.seems_cut(lexemes.real_definition(F.col("d"))).alias("s")).collect()]
    assert cut[:2] == [False, False] and not cut[3] and not cut[4]
