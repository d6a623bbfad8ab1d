"""Column expressions that tell script, language and kind of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, without_images

# Scripts, stop words, and the patterns of chunk kinds.
DEVANAGARI = r"[ऀ-ॿ]"
LATIN = r"[a-zA-Z]"
STOPWORDS_MR = ["आणि", "आहे", "हे", "की", "ते", "त्या", "च", "या", "व", "नाही", "तो", "ती", "हा", "ही", "मी", "तू", "आम्ही", "आपण", "त्यांना", "होते", "होता", "होती", "असे", "म्हणजे", "पण", "तर", "जर"]
STOPWORDS_HI = ["और", "है", "में", "से", "को", "के", "का", "की", "एक", "यह", "इस", "वह", "नहीं", "हैं", "पर", "भी", "तो", "कि", "जो", "इन", "वे", "था", "थी", "थे", "हो", "आप", "हम", "मैं", "तुम", "वो"]
MARKERS_SA = ["च", "वा", "तु", "एव", "हि", "इति", "अथ", "यदा", "तदा", "कृषि", "भूमि", "बीज", "वृक्ष", "फल", "पुष्प", "धान्य"]
STOPWORDS = {
    "en": ["the", "and", "of", "to", "that", "is", "for", "with", "are", "this"],
    "fr": ["le", "la", "de", "et", "les", "des", "que", "un", "une", "pour"],
    "de": ["der", "die", "das", "und", "den", "ein", "eine", "nicht", "auf", "sich"],
    "es": ["el", "los", "las", "por", "con", "una", "del", "se", "es", "y"],
}
PROCESS = r"(?i)\b(step|steps|method|procedure|process|how to|instruction|guideline)\b"
EVIDENCE = r"(?i)\b(according to|research|study|studies|evidence|found that|shows?|demonstrated?|percent|%|result[s]?|data)\b"
CONCEPT = r"(?i)\b(is defined as|refers? to|means?|concept of|definition|known as)\b"
PROCESS_INDIC = "(विधि|प्रक्रिया|पद्धत|पद्धती|कसे|चरण|टप्पे|तरीका|विधान|कार्यपद्धती|कृती|उपाय|पायरी)"
EVIDENCE_INDIC = "(संशोधन|अभ्यास|पुरावा|टक्के|परिणाम|आढळले|दाखवते|माहिती|शोध|अनुसार|प्रमाणे|सिद्ध|तपास)"
CONCEPT_INDIC = "(म्हणजे|परिभाषा|ओळखले जाते|याचा अर्थ|संकल्पना|व्याख्या|मतलब|परिभाषित|कहते हैं|जिसे|अर्थात)"
KINDS = {"process": PROCESS, "evidence": EVIDENCE, "concept": CONCEPT}
KINDS_INDIC = {"process": PROCESS_INDIC, "evidence": EVIDENCE_INDIC, "concept": CONCEPT_INDIC}
LANGUAGE_CODES = {
    "mr": "mr-IN", "hi": "hi-IN", "en": "en-IN", "ne": "ne-IN", "bn": "bn-IN", "gu": "gu-IN", "kn": "kn-IN", "ml": "ml-IN",
    "or": "od-IN", "pa": "pa-IN", "ta": "ta-IN", "te": "te-IN", "ur": "ur-IN", "sa": "sa-IN",
}
INJECTIONS = [
    r"ignore\s+(previous|all|prior)\s+instructions", r"forget\s+(everything|all|previous)", r"you\s+are\s+now\s+", r"act\s+as\s+(if|a|an)\s+",
    r"jailbreak", r"disregard\s+(your|the|all)", r"<\s*system\s*>", r"\[INST\]", r"###\s*(instruction|system|assistant)",
]
PREFIX_LABELS = {"en": ("Book:", "Section:", "Pages"), "mr": ("पुस्तक:", "विभाग:", "पाने"), "hi": ("पुस्तक:", "अनुभाग:", "पृष्ठ"), "sa": ("ग्रन्थ:", "अध्याय:", "पृष्ठ")}


def script_ratio(c: Column, script: str = DEVANAGARI) -> Column:
    """Letters of the script as a share of all letters; 0 without letters."""

    def share(letters: Column) -> Column:
        n = F.length(letters)
        return F.when(n > 0, (n - F.length(F.regexp_replace(letters, script + "+", ""))) / n).otherwise(0.0)

    return bound(F.regexp_replace(c, r"[^\p{L}]+", ""), share)


def script_of(c: Column, script: str = DEVANAGARI, name: str = "devanagari") -> Column:
    own, latin = F.regexp_count(c, F.lit(script)), F.regexp_count(c, F.lit(LATIN))
    share = own / F.nullif(own + latin, F.lit(0))
    return F.when(share.isNull(), "unknown").when(share > 0.7, name).when(share < 0.3, "latin").otherwise("mixed")


def distinct_hits(c: Column, words: list[str], low: bool = False) -> Column:
    split = F.split(F.lower(c) if low else c, r"(?U)\s+")
    return F.size(F.array_intersect(F.array_distinct(split), F.array(*map(F.lit, words))))


def chunk_language(c: Column) -> Column:
    """struct(language, confidence) by script share and stop words, as the chunk labels have it.

    The share is computed once, and words are cut and counted only where it is high enough for them to matter.
    """
    said = lambda code, conf: F.struct(F.lit(code).alias("language"), conf.cast("double").alias("confidence"))

    def by_words(hits: Column) -> Column:
        mr, hi, sa = (hits[n] for n in ("mr", "hi", "sa"))
        none = (mr == 0) & (hi == 0)
        share = lambda n: F.bround(0.5 + 0.5 * n / (mr + hi), 2)
        return (
            F.when(none & c.rlike("[।॥]"), said("sa", F.lit(0.82)))
            .when(none & (sa >= 2), said("sa", F.lit(0.75)))
            .when(none, said("mr", F.lit(0.70)))
            .when(mr >= hi, said("mr", share(mr)))
            .otherwise(said("hi", share(hi)))
        )

    def hits(words: Column) -> Column:
        count = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
        return F.struct(count(STOPWORDS_MR).alias("mr"), count(STOPWORDS_HI).alias("hi"), count(MARKERS_SA).alias("sa"))

    def by_share(ratio: Column) -> Column:
        return (
            F.when(ratio > 0.6, bound(bound(F.array_distinct(F.split(c, r"(?U)\s+")), hits), by_words))
            .when(ratio > 0.15, said("mixed", F.bround(ratio, 2)))
            .when(ratio < 0.05, said("en", F.bround(1 - ratio * 4, 2)))
            .otherwise(said("unknown", F.lit(0.5)))
        )

    return bound(script_ratio(c), by_share)


def majority_language(c: Column, lists: dict[str, list[str]] = STOPWORDS) -> Column:
    """struct(language, confidence): the list with most distinct words in c; earlier lists win ties."""
    hits = {code: distinct_hits(c, words, low=True) for code, words in lists.items()}
    total, best = sum(hits.values()), F.greatest(*hits.values())
    code = F.lit("unknown")
    for name, n in reversed(hits.items()):
        code = F.when(n == best, name).otherwise(code)
    return F.struct(
        F.when(total == 0, "unknown").otherwise(code).alias("language"), F.when(total == 0, 0.5).otherwise(F.round(0.5 + 0.5 * best / total, 2)).alias("confidence")
    )


def document_language(c: Column, lists: dict[str, list[str]] = STOPWORDS, most: int = 8000) -> Column:
    """Code of a whole document by its first `most` characters, embedded images left out; "unknown" without known words."""
    return majority_language(F.substring(without_images(c), 1, most), lists)["language"]


def chunk_kind(c: Column, kinds: dict[str, str] = KINDS, indic: dict[str, str] = KINDS_INDIC) -> Column:
    """The first kind whose pattern c holds; for text mostly in Devanagari its own patterns come first."""

    def kind(own: Column) -> Column:
        out = F.when(F.lit(False), "")
        for kind, pattern in indic.items():
            out = out.when(own & c.rlike(pattern), kind)
        for kind, pattern in kinds.items():
            out = out.when(c.rlike(pattern), kind)
        return out.otherwise("general")

    return bound(script_ratio(c) > 0.4, kind)


def mapped(c: Column, names: dict[str, str], default: str) -> Column:
    """names[c], or default; names is a small fixed map."""
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def injections(c: Column, most: int = 2000) -> Column:
    """The patterns of prompt injection that the first most characters of c hold."""
    head = F.left(c, F.lit(most))
    return F.filter(F.array(*[F.when(head.rlike("(?i)" + p), F.lit(p)) for p in INJECTIONS]), lambda p: p.isNotNull())


def context_prefix(title: Column, section: Column, first: Column, last: Column, language: Column) -> Column:
    """`label title | label section | pages a-b` and a blank line; empty without a title."""
    label = lambda i: mapped(language, {k: v[i] for k, v in PREFIX_LABELS.items()}, PREFIX_LABELS["en"][i])
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    parts = F.concat_ws(
        " | ", F.concat_ws(" ", label(0), title), F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" ", label(1), section)), F.concat_ws(" ", label(2), pages)
    )
    return F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(parts, F.lit("\n\n")))


def search_text(c: Column, most: int = 2000) -> Column:
    """A search text without a leading instruction and without control characters but tab and line feed, cut to most."""
    bare = F.regexp_replace(c, r"(?i)^\s*(ignore\s+(previous|all)\s+instructions?|system\s*:)", "")
    return F.left(F.regexp_replace(F.trim(bare), r"[\x00-\x08\x0B-\x1F]", ""), F.lit(most))
