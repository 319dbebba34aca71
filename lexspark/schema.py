"""Fixed vocabularies of the data model, stated once."""

from __future__ import annotations

# Words too common to date a text.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might must shall can need this that these those it its he she they we you i me him her us them my your "
    "his their our who what which when where how all each every both few more most other some such no not only same so than too very "
    "just also now here there then if as because"
).split()

# Words of a definition that place it in a domain, domains in order of precedence.
DOMAIN_WORDS = {
    "administration": "law government court official tax rule".split(),
    "military": "war army weapon soldier battle fight".split(),
    "religion": "god temple priest sacred ritual prayer".split(),
    "commerce": "trade merchant money market goods price".split(),
    "food": "food eat drink cook meal fruit vegetable".split(),
    "nature": "animal plant tree flower bird fish".split(),
    "technology": "tool machine build craft make work".split(),
    "culture": "art music dance literature story tradition".split(),
    "kinship": "family father mother brother sister child".split(),
    "body": "body head hand foot eye heart".split(),
}

# Parts of a domain's name that speak for a type of contact, types in order of precedence.
CONTACT_PARTS = {
    "trade": "commerce money goods merchant market price trade exchange cargo ship port".split(),
    "conquest": "military war weapon soldier army battle king ruler law court tax tribute".split(),
    "religious": "religion god temple priest sacred ritual prayer worship heaven soul sin".split(),
    "cultural": "art music literature education philosophy science fashion food architecture".split(),
    "technological": "technology tool machine invention science medicine agriculture craft manufacture".split(),
}

# Words that point to a type of semantic shift, types in order of precedence.
SHIFT_WORDS = {
    "generalization": ["general", "broad", "any", "various", "multiple", "diverse", "extended", "expanded", "wider", "universal"],
    "specialization": ["specific", "particular", "narrow", "limited", "restricted", "technical", "specialized", "precise", "exact"],
    "metaphor": ["figurative", "metaphor", "like", "as if", "symbolic", "represents", "stands for", "imagery"],
    "metonymy": ["associated", "related", "connected", "part of", "aspect", "attribute", "characteristic"],
    "amelioration": ["positive", "improved", "elevated", "noble", "prestigious", "respected", "favorable", "better"],
    "pejoration": ["negative", "degraded", "lowered", "vulgar", "derogatory", "offensive", "unfavorable", "worse"],
}

# Codes of language headings.
HEADING_CODES = {
    "English": "eng", "French": "fra", "German": "deu", "Spanish": "spa", "Italian": "ita", "Portuguese": "por", "Dutch": "nld", "Russian": "rus",
    "Polish": "pol", "Latin": "lat", "Ancient Greek": "grc", "Greek": "ell", "Old English": "ang", "Middle English": "enm", "Old French": "fro",
    "Old Norse": "non", "Proto-Germanic": "gem-pro", "Proto-Indo-European": "ine-pro", "Sanskrit": "san", "Arabic": "ara", "Hebrew": "heb",
    "Japanese": "jpn", "Chinese": "zho", "Korean": "kor",
}

# Headings that name a part of speech, in order.
PARTS_OF_SPEECH = ["Noun", "Verb", "Adjective", "Adverb", "Pronoun", "Preposition", "Conjunction", "Interjection", "Article", "Determiner", "Particle", "Numeral", "Proper noun"]

# Signs of injected code in free text.
UNSAFE = ["<script", "javascript:", r"on\w+=", "--", ";.*--", r"\$\{", r"\{\{"]

# The languages loaded first (code, name).
SEED_LANGUAGES = [("eng", "English"), ("deu", "German"), ("fra", "French"), ("spa", "Spanish"), ("ita", "Italian"), ("lat", "Latin"), ("grc", "Ancient Greek"), ("ang", "Old English"), ("fro", "Old French")]
