"""Matching entities across sources without keys (problem 5).

A deterministic cascade of rules over classes: entries and records are first reduced to distinct (language, form
skeleton, sense) classes, so that repeated deliveries and duplicates weigh nothing. Each rule is an exact join on
a weaker combination of attributes than the one before; entry classes resolved by a rule are anti-joined away
before the next. Pairs of rows come out by joining the class pairs back to both tables.

Confidence is the rule's precision on labelled pairs, smoothed: (right + a) / (labelled + a + b). Labels are the
class pairs whose pronunciations can be compared, an attribute that no rule uses: right if they agree.

The language is the one resolved from the freely typed name (problem 1), forms are repaired from wrong encodings
first (problem 7). Entries of no listed language, or without a form, match nothing. An entry matches by any of
its definitions; without a usable definition on either side only a form with a single sense matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import canonical, encoding
from lexspark.llm import lexemes as X
from lexspark.llm.survivors import SHORT_SHARE
from lexspark.session import written

#: Prior of the labelled precision: as if a of a + b labelled pairs had been right.
PRIOR_RIGHT, PRIOR_WRONG = 4.0, 1.0
#: Pronunciations agree from this similarity on.
SAME_SOUND = 0.8
#: Variant spellings differ by at most this share of the longer skeleton, and this many letters.
VARIANT_SHARE, VARIANT_EDITS = 0.25, 3
#: Partial senses match if all but one of the shorter one's words are in the other, and at least this many.
PARTIAL_WORDS = 2


def _sound(c: Column) -> Column:
    """A pronunciation without stress, length and what looks alike in it."""
    return F.translate(c, "ɡɾεөіа:ːˈ'ʰ \u00a0\u00ad\u200b\u200c\u200d\u2060\ufeff", "grɛθia")


def entry_senses(entries: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per entry and definition: entry_id, iso, sk, pos, sound, def. Without definitions one row with null."""
    entries = entries.select("entry_id", "form", "form_phonetic", "language", "language_code", "definitions", "part_of_speech")
    e = canonical.resolve(entries, languages).filter(F.col("iso_code") != canonical.UNMATCHED)
    e = e.withColumn("form", encoding.repaired(F.col("form")))
    defs = F.filter(F.transform("definitions", X.real_definition), lambda x: x.isNotNull())
    e = e.withColumn("defs", defs).withColumn("defs", F.when(F.size("defs") > 0, F.col("defs")).otherwise(F.array(F.lit(None).cast("string"))))
    e = e.select("entry_id", F.col("iso_code").alias("iso"), X.skeleton(F.col("form")).alias("sk"), F.concat_ws(",", F.array_sort("part_of_speech")).alias("pos"), _sound(X.real_phonetic(F.col("form_phonetic"))).alias("sound"), "defs")
    return e.select("entry_id", "iso", "sk", "pos", "sound", F.explode("defs").alias("def"))


def record_senses(meta: DataFrame) -> DataFrame:
    form = F.coalesce(F.when(F.trim("form_orthographic") != "", F.col("form_orthographic")), F.col("form_normalized"))
    m = meta.filter("language_code is not null")
    return m.select(F.col("id").alias("lsr_id"), F.col("language_code").alias("iso"), X.skeleton(form).alias("sk"), F.concat_ws(",", F.array_sort("part_of_speech")).alias("pos"), _sound(X.real_phonetic(F.col("form_phonetic"))).alias("sound"), X.real_definition(F.col("definition_primary")).alias("def"))


def _with_words(x: DataFrame) -> DataFrame:
    """Written out with the words of the definition in place of it; forms without a letter end here."""
    x = x.withColumn("w", X.stems(F.col("def"))).withColumn("cut", F.coalesce(X.seems_cut(F.col("def")), F.lit(False))).drop("def")
    return written(x).filter("sk <> ''")


def _senses(x: DataFrame, same: DataFrame, usual: int) -> DataFrame:
    """With the canonical words cw, `sense` of whole definitions (a hash; joins on it compare the words), and a class id."""
    x = X.rewritten(x, same).drop("w")
    whole = ~F.col("cut") & (F.size("cw") >= usual)
    x = x.withColumn("sense", F.when(whole, F.xxhash64("cw")))
    given = ["iso", "sk", "pos", "cw", F.col("cw").isNull(), whole]
    return x.withColumn("c_id", F.xxhash64(*given)).withColumn("c_no", F.xxhash64(F.lit("second"), *given)).drop("cut")


#: A class's key: two hashes of what it has in common, 128 bits together.
CLASS = ["c_id", "c_no"]
R_CLASS = ["r_c_id", "r_c_no"]


def _classes(x: DataFrame) -> DataFrame:
    same = [F.first(c).alias(c) for c in ("iso", "sk", "pos", "sense", "cw")]
    return x.groupBy(*CLASS).agg(*same, F.max("sound").alias("sound")).withColumn("loose", X.loose(F.col("sk")))


def _edits(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b)) <= F.least(F.lit(VARIANT_EDITS), F.ceil(F.greatest(F.length(a), F.length(b)) * VARIANT_SHARE))


#: The rules in order. The first three want a whole sense, the last two a form with one sense only.
RULES = ("form and sense", "loose form and sense", "sense and variant form", "form and partial sense", "loose form and partial sense", "form alone", "loose form alone")
BARE = "record of the only sense"


def _passes(r: DataFrame):
    """Joins of the open entry classes with the record classes, each labelling its pairs with a rule's number or null.

    A pass has one equi-key; rules that share it differ in what else agrees. r has prefixed columns.
    """
    whole = r.filter("r_sense is not null")

    def keyed(o: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        on = [o[k] == right[f"r_{k}"] for k in keys]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        if "sense" in keys:
            # the only sense that a record without one is given is known by its hash alone
            cond = cond & (F.col("r_bare") | (F.col("cw") == F.col("r_cw")))
        return o.join(right, cond)

    yield lambda o: keyed(o.filter("sense is not null"), whole, "iso", "sk", "sense").withColumn("rule", F.lit(0))
    yield lambda o: keyed(o.filter("sense is not null"), whole, "iso", "loose", "sense").withColumn("rule", F.lit(1))
    # distinct forms of one sense are few: repeated ones are one class here
    yield lambda o: keyed(o.filter("sense is not null"), whole, "iso", "sense").withColumn("rule", F.when(_edits("sk", "r_sk"), 2))

    def rest(o: DataFrame) -> DataFrame:
        x, sk = keyed(o, r.filter("not r_bare"), "iso", "loose"), F.col("sk") == F.col("r_sk")
        a, b = F.least(F.size("cw"), F.size("r_cw")), F.size(F.array_intersect("cw", "r_cw"))
        # two whole senses that differ in a word are one reworded; a part must be contained but for its broken end
        partial = F.coalesce((b >= PARTIAL_WORDS) & (b >= a - 1), F.lit(False))
        few = (F.coalesce(F.size("cw"), F.lit(0)) < PARTIAL_WORDS) | (F.coalesce(F.size("r_cw"), F.lit(0)) < PARTIAL_WORDS)
        same_pos = (F.col("pos") == F.col("r_pos")) | (F.col("pos") == "") | (F.col("r_pos") == "")
        alone = few & same_pos & F.when(sk, F.col("r_one_sk")).otherwise(F.col("r_one_loose"))
        return x.withColumn("rule", F.when(partial & sk, 3).when(partial, 4).when(alone & sk, 5).when(alone, 6))

    yield rest


def _record_side(rc: DataFrame) -> DataFrame:
    """Record classes with what their form's senses are, and a second row for senseless classes of a form with one sense."""
    # a skeleton has one loose form: the second window needs no other partitioning than the first
    by_loose, by_sk = Window.partitionBy("iso", "loose"), Window.partitionBy("iso", "loose", "sk")
    one = lambda w: F.coalesce(F.min("sense").over(w) == F.max("sense").over(w), F.lit(True))
    rc = rc.withColumn("one_loose", one(by_loose)).withColumn("one_sk", one(by_sk)).withColumn("only", F.min("sense").over(by_sk))
    bare = F.col("sense").isNull() & F.col("one_sk") & F.col("only").isNotNull()
    rc = rc.withColumn("bare", F.explode(F.when(bare, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rc = rc.withColumn("sense", F.when(F.col("bare"), F.col("only")).otherwise(F.col("sense"))).drop("only")
    return rc.select(*[F.col(c).alias(f"r_{c}") for c in rc.columns])


def match(entries: DataFrame, meta: DataFrame, languages: DataFrame) -> DataFrame:
    """(entry_id, lsr_id, rule, confidence): every pair, by its first rule. Empty tables give no pairs."""
    e, r = _with_words(entry_senses(entries, languages)), _with_words(record_senses(meta))  # repeated rows end in the last aggregate
    words = e.select("iso", "sk", "w", "cut").unionByName(r.select("iso", "sk", "w", "cut")).filter("w is not null and not cut")
    usual = max(words.select(F.percentile_approx(F.size("w"), SHORT_SHARE)).first()[0] or 0, 2)
    same = X.learned(words.select(F.concat_ws("|", "iso", "sk").alias("k"), "w"))
    e, r = _senses(e, same, usual), _senses(r, same, usual)
    open_, rc = written(_classes(e)), written(_record_side(_classes(r)))
    known = (F.col("sound") != "") & (F.col("r_sound") != "")
    right = known & (1 - F.levenshtein("sound", "r_sound") / F.greatest(F.length("sound"), F.length("r_sound")) >= SAME_SOUND)
    found = None
    for join in _passes(rc):
        if found is not None:
            # resolved classes end here; what is left is written out, as each pass after this one reads it
            open_ = written(open_.join(hit.select(*CLASS), CLASS, "left_anti"))
        x = join(open_).filter("rule is not null").select(*CLASS, *R_CLASS, "rule", F.col("r_bare").alias("bare"), known.alias("known"), right.alias("right"))
        x = x.groupBy(*CLASS, *R_CLASS).agg(F.min("rule").alias("rule"), F.min("bare").alias("bare"), F.max("known").alias("known"), F.max("right").alias("right"))
        # within a pass as well only the first rule of an entry class counts
        hit = written(x.withColumn("first", F.min("rule").over(Window.partitionBy(*CLASS))).filter("rule = first").drop("first"))
        found = hit if found is None else found.unionByName(hit)
    found = found.withColumn("name", F.when(F.col("bare"), BARE).otherwise(F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1)))
    trust = found.groupBy("name").agg(((F.count_if("right") + PRIOR_RIGHT) / (F.count_if("known") + PRIOR_RIGHT + PRIOR_WRONG)).alias("confidence"))
    found = found.join(F.broadcast(trust), "name")  # one row a rule
    pairs = found.select(*CLASS, *R_CLASS, "name", "confidence").join(e.select(*CLASS, "entry_id"), CLASS)
    pairs = pairs.join(r.select(*[F.col(c).alias(f"r_{c}") for c in CLASS], "lsr_id"), R_CLASS)
    return pairs.groupBy("entry_id", "lsr_id").agg(F.max(F.struct("confidence", "name")).alias("x")).select("entry_id", "lsr_id", F.col("x.name").alias("rule"), "x.confidence")
