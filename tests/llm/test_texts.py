"""Problems 2, 7, 8, 9 and 10: scans, encodings, packing, leaks, residue."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm import encoding, leakage, packing, residue, scans

WORDS = "plêivom thêx zufis kraűs bréir naïve “quoted” — été ñandú σταυρός κλειν ѡаӯт скол £82".split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8), st.sampled_from(["cp1252", "mac_roman", "cp437", "latin-1"]))
def test_encoding_round_trip(words, page):
    text = " ".join(words)
    raw = text.encode("utf-8")
    try:
        garbled = raw.decode(page)
    except UnicodeDecodeError:
        garbled = "".join(c if (c := bytes([b]).decode(page, "ignore")) else chr(b) for b in raw)
    assert encoding.repair(garbled) == text
    assert not encoding.is_garbled(text)
    assert encoding.is_garbled(garbled) == (garbled != text)


def test_encoding_repeats_to_the_end():
    text = "zufis “kůt” été"
    for _ in range(7):
        text = text.encode("utf-8").decode("latin-1")
    assert encoding.repair(text) == "zufis “kůt” été"


def test_encoding_edges(spark):
    rows = [("a", "sÃ£upikirÃµr", "x"), ("b", None, "x"), ("c", "", "x"), ("d", "wepaigr��ileth", "x"), ("e", "bráu", "x"), (None, "Ã©", "x"), ("f", "kÃ©" * 20000, "x"), ("a", "sÃ£upikirÃµr", "x"), ("g", "ÃƒÂ©tÃƒÂ©", "x"), ("h", "êåâåâèåòõ", "x"), ("i", "\x93kot\x94", "x")]
    x = spark.createDataFrame(rows, "id string, text string, field string")
    got = {r["record_id"]: r["restored"] for r in encoding.garbled(x, ["text"], F.col("id"), "t").collect()}
    assert set(got) == {"a", "d", "f", "g", "h", "i"}
    assert got["a"] == "sãupikirõr" and got["g"] == "été" and got["f"] == "ké" * 20000 and got["h"] == "кевевиетх" and got["i"] == "“kot”"
    assert encoding.garbled(x.limit(0), ["text"], F.col("id"), "t").count() == 0


ATT = "id string, text_excerpt string, text_source string, page_reference string, word string, n int"


def test_scans_of_any_script(spark):
    assert all(scans._py_hash(c) >= 0 for c in "ἀ中한𐍈")
    texts = ["ἀρχή τοῦ λόγου ἦν", "中文字 漢字漢字", "한국어 말씀이라", "ႠႡႢ ႣႤႥ", "𐌰𐌱𐌲𐌳 𐌴𐌵𐌶"]
    rows = [(f"u{i}-{k}", t, None, None, "x", 1) for i in range(6) for k, t in enumerate(texts)]
    x = spark.createDataFrame(rows, ATT)
    assert scans.found(x).count() == 0
    words = spark.createDataFrame([(w,) for t in texts for w in t.split()], "word string")
    assert {r["word"]: r["h"] for r in words.withColumn("h", scans._hash(F.col("word"))).collect()} == {w: scans._py_hash(w) for t in texts for w in t.split()}


def test_scans(spark):
    clean = ["They pressed the acorns and named it ever after.", "The ribbed basket stood beside the fence until 1003.", "Let the seed be soaked on the 4th day, and the honey on the 9th.", "Two hands were\nseen here.", "She said no —\nand left the table."]
    rows = [(f"c{i}-{k}", t, "Vashny Chronicle", "p. 12", "x", 1) for i in range(90) for k, t in enumerate(clean)]
    bad = {
        "hyphen": "They pressed the aco-\nrns and named it.", "soft": "They pressed the aco\xad\nrns.", "number": "They pressed\n— 211 —\nthe acorns.", "header": "They pressed\nVASHNY CHRONICLE [106]\nthe acorns.",
        "spaced": "They pressed\nV A S H N Y   C H R O N I C\nthe acorns.", "digit": "Th3y pressed the acorns.", "sign": "They pr@ssed the acorns.", "garbled": "They pressed the acoâ\x80\x90\nrns.",
    }
    # misread letters show beside other damage often enough to be trusted
    rows += [(f"m{i}", "Thcy pressed the ac0rns.", None, None, "x", 1) for i in range(12)] + [("letters", "Thcy pressed the acorns.", None, "", "x", 1)]
    rows += [(k, v, "Vashny Chronicle", "", "x", 1) for k, v in bad.items()]
    rows += [("null", None, None, None, None, None), ("empty", "", "", "", "x", 1), ("ref", "Two hands.", None, "p. 9 9", "x", 1), ("ref2", None, None, "co1. 12", "x", 1), ("ref3", None, None, "Â§ 15", "x", 1), ("long", "acorns " * 20000, None, "12", "x", 1), (None, "Th3y", None, "??", "x", 1)]
    x = spark.createDataFrame(rows + rows[-5:], ATT)
    got = {(r["attestation_id"], r["field"]) for r in scans.found(x).collect()}
    assert {a for a, f in got if f == "text_excerpt" and not a.startswith("m")} == set(bad) | {"letters"}
    assert {a for a, f in got if f == "page_reference"} == {"ref", "ref2"}
    fixed = {r["attestation_id"]: r["text"] for r in scans.repaired(x).collect()}
    assert fixed["letters"] == "They pressed the acorns." and fixed["hyphen"] == "They pressed the acorns and named it." and fixed["header"] == "They pressed the acorns." and fixed["garbled"] == "They pressed the acorns."
    assert scans.found(x.limit(0)).count() == 0


def test_each_limit_decides():
    sizes = [100] * 6
    used = lambda *limit: len({c for c, _ in packing.best_fit(sizes, *limit)})
    assert used(600, 99, 1e9) == 1
    assert used(300, 99, 1e9) == 2  # tokens
    assert used(600, 2, 1e9) == 3  # places
    assert used(600, 99, 10_000.0) == 6  # cost
    assert used(600, 99, 20_000.0) == 3
    assert packing.best_fit([100], 100, 1, 5.0) == [(0, 0)]  # alone it is let in
    # the norm of the rest decides between two containers with room: fewer free tokens win
    assert [c for c, _ in packing.best_fit([90, 60, 10], 100, 9, 1e9)] == [0, 1, 0]


def test_limits_of_a_kind(spark):
    docs = spark.createDataFrame([(i, "word " * 40) for i in range(60)], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("few", 2048, 2, None), ("cheap", 2048, None, 4000.0), ("plain", 2048, None, None)], "container_kind string, capacity_tokens int, capacity_documents int, capacity_cost double")
    got = packing.packed(docs, kinds).groupBy("container_kind").agg(F.count_distinct("container_id").alias("n")).collect()
    assert {r["container_kind"]: r["n"] for r in got} == {"few": 30, "cheap": 30, "plain": 2}
    assert {k: (p, c) for k, _, p, c in packing.limits(kinds)} == {"few": (2, 0.95 * 2048**2), "cheap": (128, 4000.0), "plain": (128, 0.95 * 2048**2)}


def test_packing(spark):
    docs = [(i, "word " * (i * 37 % 300 + 1)) for i in range(300)] + [(900, "token " * 3000), (901, None), (902, ""), (903, "x" * 4000)]
    x = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("capacity", F.lit(1))
    kinds = spark.createDataFrame([("short", 512), ("long", 2048), ("none", 0)], "container_kind string, capacity_tokens int")
    got = packing.packed(x, kinds).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.measured(x).collect()}
    assert {r["container_kind"] for r in got} == {"short", "long"}
    for kind, cap in (("short", 512), ("long", 2048)):
        own = [r for r in got if r["container_kind"] == kind]
        total: dict = {}
        for r in own:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            assert r["piece"] == 0 or sizes[r["doc_id"]] > cap
        assert total == sizes
        bins: dict = {}
        for r in own:
            if r["container_id"] is not None:
                bins.setdefault(r["container_id"], []).append(r)
        for rs in bins.values():
            rs.sort(key=lambda r: r["position"])
            at = 0
            for k, r in enumerate(rs):
                assert (r["position"], r["offset"]) == (k, at)
                at += r["n_tokens"]
            assert at <= cap
        assert len(bins) <= -(-sum(sizes.values()) // cap) + 2
    assert packing.packed(x.limit(0), kinds).count() == 0 and packing.packed(x, kinds.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 6), st.integers(100, 2500))
def test_best_fit_keeps_every_constraint(sizes, places, cost):
    cost = max(cost, max(sizes, default=1) ** 2)
    at = packing.best_fit(sizes, 50, places, cost)
    bins: dict[int, list[tuple[int, int]]] = {}
    for s, (c, o) in zip(sizes, at):
        bins.setdefault(c, []).append((o, s))
    for b in bins.values():
        assert len(b) <= places and sum(s for _, s in b) <= 50 and sum(s * s for _, s in b) <= cost
        b.sort()
        assert all(o + s == p for (o, s), (p, _) in zip(b, b[1:])) and b[0][0] == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.lists(st.integers(0, 6), min_size=1, max_size=4))
def test_fm_index(text, pattern):
    t, p = np.array(text), np.array([pattern])
    lo, hi = (index := leakage.FMIndex(t, 3)).count(p)
    want = [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(5)] + [(98, None), (99, "too short")]
    filler = lambda n: rng.choices(vocabulary, k=n)

    def passage(item, n, edits):
        ws = items[item][1].split()[5 : 5 + n]
        for e in range(edits):
            at = min(len(ws) - 1, 2 + e * (n // edits))
            ws[at : at + 1] = [[], ["zz"], [ws[at], "qq"]][e % 3]
        return ws

    cases = {1: (0, 15, 0, True), 2: (1, 14, 0, False), 3: (2, 18, 3, True), 4: (3, 30, 5, True), 5: (4, 24, 6, False), 6: (0, 35, 0, True)}
    docs = [(d, ", ".join(filler(80) + passage(i, n, e) + filler(60)).upper()) for d, (i, n, e, _) in cases.items()] + [(50, None), (51, ""), (52, " ".join(filler(30000))), (1, ", ".join(filler(5)))]
    x = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(7))
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find(x, e).collect()}
    assert got == {(d, i) for d, (i, _, _, leaks) in cases.items() if leaks}
    assert leakage.find(x.limit(0), e).count() == 0 and leakage.find(x, e.limit(0)).count() == 0
    # an item quoted three times, the second time slightly changed, leaves three spans
    parts = [filler(30), passage(0, 20, 0), filler(50), passage(0, 24, 3), filler(3), passage(0, 30, 0), filler(9)]
    twice = spark.createDataFrame([(1, " ".join(sum(parts, [])))], "doc_id bigint, text string")
    spans = sorted((r["first_word"], r["end_word"]) for r in leakage.find(twice, e).collect())
    ends = [sum(map(len, parts[:k])) for k in range(8)]
    assert len(spans) == 3 and all(abs(a - ends[k]) <= 3 and abs(b - ends[k + 1]) <= 3 for (a, b), k in zip(spans, (1, 3, 5)))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_leaked_equals_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randint(1, 9) for _ in range(18)]
    text = [rng.randint(1, 9) for _ in range(5)] + [x if rng.random() > 0.15 else rng.randint(1, 9) for x in item] + [rng.randint(1, 9) for _ in range(4)]
    want = any(item[i] == text[a] and item[i + n - 1] == text[b - 1] and edit_distance(item[i : i + n], text[a:b]) <= n // 6 for n in range(15, 19) for i in range(len(item) - n + 1) for a in range(len(text)) for b in range(a + 1, min(len(text), a + n + 4) + 1))
    assert (leakage.leaked(np.array(item), np.array(text)) is not None) == want


RESIDUE = ["The list {{gloss}} about 1115 differs.", "Please enable JavaScript to view this entry.", "Error 404 - Not Found", "Amet ipsum lorem mauris amet magna amet.", "xxx xxx xxx xxx xxx xxx xxx xxx", "Headword: [note to come]\nSense: $CITATION$", "A widening [object Object] likelier than a loan.", "503 Service Unavailable", "Your headword here. Your headword here.", "The vowel in ${title} is dated.", "About %d the word went."]
CONTENT = ["The template {{IPA|/ˈbɾalɔ/}} renders the sound, and [[form]] links to it.", "The phrase “please enable JavaScript” is a calque.", "The old site answered “Error 404” for every headword.", "The error in the 503rd line is the scribe's own.", "After 404 the older spelling had gone.", "In the notation used here {a, e, i} is a set and %s stands for nothing at all.", "The word undefined is used by the first editor.", "", None, "plain words " * 30000]


@pytest.fixture(scope="module")
def residue_docs(spark):
    rows = [(i, t, None if i % 2 else f"feed{i}") for i, t in enumerate(RESIDUE + CONTENT)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("shape", F.lit(1))


def test_residue(residue_docs):
    got = {r["doc_id"] for r in residue.residue(residue_docs).collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.residue(residue_docs.limit(0)).count() == 0


#: One of each kind that detectors name and a narrower prefilter lost.
NAMED = ["#headword#", "*gloss*", "Example definition.", "Definition pending.", "La página no encontrada.", "No existe la página que busca.", "panic: runtime", "Warning: cannot go on", "You must be logged in.", "The connection closed.", "Server is down.", "Database reset.", "The socket lost.", "Connection timed out.", "No such file.", "Out of memory.", "Stack overflow.", "Core dumped.", "Nullam lectus nullam lectus.", "Mauris magna nunc porta eros.", "Blah blah blah blah blah blah blah blah blah."]
WEAKLY = ["Old form.\nMoved by the editors.", "Old form.\nThe site owner knows.", "Old form.\nAsk at the server."]


def test_residue_prefilter_is_no_cut(spark):
    x = spark.createDataFrame([(i, t, f"feed{i}") for i, t in enumerate(NAMED + WEAKLY + WEAKLY)], "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in residue.residue(x).collect()}
    assert got == set(range(len(NAMED) + 2 * len(WEAKLY)))


def test_needles_are_in_every_match():
    assert residue.needles(r"(?i)\bOut of (?:memory|disk)\b") >= {"out of "} and residue.needles(r"x(?:abcd)?y") is None
    assert residue.needles(r"(?:Error|Fehler) \d") == {"error", "fehler"} and residue.needles(r"_{4,}") == {"____"} and residue.needles(r"(?:abcd|\d)") is None
    for p in (*residue.PLACEHOLDERS, *residue.RESPONSES, residue.WEAK):
        assert residue.needles(p) or p in residue.REST


def test_needles_multiplied_out():
    assert residue.needles(r"(?:Error|Fehler) \d", 64) == {"error ", "fehler "}
    assert residue.needles(r"\bwhile (?:reading|loading) (?:page|\w+)", 64) == {"while reading ", "while loading "}
    assert residue.needles(residue.FURNITURE, 64) or residue.FURNITURE in residue.REST
    may = residue.Prefilter()
    assert all(may(t) for t in RESIDUE + NAMED + WEAKLY) and may("Plain words of an old register.") == 0


def test_responses_that_a_text_takes_up(spark):
    own = "The gateway of Usk.\nBad gateway records were kept in the gateway records hall.\nKept records name the hall."
    answered = "The gateway of Usk.\nA hall of wood.\nService unavailable."
    rows = [(1, own, "a"), (2, answered, "a"), (3, "Old oak.\nSpeech of trees.", "b")]
    schema = "doc_id bigint, text string, source string"
    assert {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, schema)).collect()} == {2}
    # the same sentence over two hosts is an answer all the same
    assert {r["doc_id"] for r in residue.residue(spark.createDataFrame([*rows, (4, own, "c")], schema)).collect()} == {1, 2, 4}


def test_residue_hosts(spark):
    notes = ["Old form.\nMoved to the hill.", "Old word.\nIn a server hall.", "Old sign.\nRequest for grain.", "Old tale.\nExpired in May."]
    rows = [("one", "Old oak.\nDeleted in the margin.")] * 2 + [("one", f"plain words {k}") for k in range(9)]  # copies of one host
    rows += [("a", "Old elm.\nForbidden fruit."), (None, "Old elm.\nForbidden fruit."), (None, "plain words")]  # two hosts, one of them null
    rows += [("down", t) for t in notes] + [("down", "plain words"), ("few", notes[0] + " Twice."), ("few", notes[1] + " Once.")]  # a host that only answers
    rows += [("up", "Old ash.\nReload the cart."), *[("up", f"plain words {k}") for k in range(9)]]
    x = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = {rows[r["doc_id"]] for r in residue.residue(x).collect()}
    assert got == {("a", rows[11][1]), (None, rows[11][1]), *[("down", t) for t in notes]}
    assert "source" in residue.evidence(x).columns


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 60), st.sampled_from([200, 1000]))
def test_best_fit_takes_the_smallest_norm_of_all(seed, places, tokens):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([tokens, tokens // 4, 20])) for _ in range(400)]
    cost = float(tokens**2)
    at = packing.best_fit(sizes, tokens, places, cost)
    left: list[list[float]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        norms = {c: sum(w * x * x for w, x in zip(packing.WEIGHTS, ((t - s) / tokens, (p - 1) / places, (q - s * s) / cost))) for c, (t, p, q) in enumerate(left) if t >= s and p >= 1 and q >= s * s and t > 0}
        c = at[i][0]
        if c == len(left):
            assert not norms
            left.append([tokens, places, cost])
        else:
            assert norms[c] <= min(norms.values()) + 1e-12
        left[c] = [left[c][0] - s, left[c][1] - 1, left[c][2] - s * s]
