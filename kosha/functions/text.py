"""Column expressions over text: cleaning, sentences, snippets, keys and identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark boilerplate, and keyword lists of the fact heuristics.
SKIP_PHRASES = ["table of contents", "copyright", "all rights reserved", "isbn", "www.", "http://", "https://", "chapter", "bibliography", "references", "index"]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_images(c: Column) -> Column:
    """Without images that are embedded as data."""
    return F.regexp_replace(c, r"(?s)!\[[^\]]*\]\(data:[^)]+\)", "")


def clean_page(c: Column) -> Column:
    """Without inline images, tags and heading markers; at most one blank line in a row."""
    c = F.regexp_replace(without_images(c), r"<[^>]+>", "")
    c = F.regexp_replace(c, r"(?m)^#{1,6}\s+", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_for_evaluation(c: Column) -> Column:
    c = F.regexp_replace(c, r"[A-Za-z0-9+/]{50,}={0,2}", "")
    c = F.regexp_replace(c, r"!\[Image\]\([^)]{10,}\)", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def repair_lines(c: Column) -> Column:
    c = F.regexp_replace(c, "­", "")
    return collapse(F.regexp_replace(c, r"(?U)(\w)-\s+(\w)", "$1$2"))


def sentences(c: Column) -> Column:
    """Array of sentences: cut after . ? ! ; : and white space, stripped, blanks dropped."""
    cut = F.split(c, r"(?<=[.?!;:])\s+")
    bare = F.transform(cut, lambda s: F.regexp_replace(s, r"^[ \-\t\r\n]+|[ \-\t\r\n]+$", ""))
    return F.filter(bare, lambda s: s != "")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it, also in a filter."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_sentence(c: Column) -> Column:
    words = F.size(F.split(F.trim(c), r"\s+"))
    skipped = bound(F.lower(c), lambda low: any_of(low, SKIP_PHRASES))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    return F.length(c).between(60, 330) & words.between(8, 65) & ~skipped & (letters >= F.length(c) * 0.45)


def sample_thirds(c: Column, cap: int) -> Column:
    """Whole text up to cap characters; else a third each from its start, middle and end."""
    third = cap // 3
    middle = F.floor(F.length(c) / 2).cast("int") - third // 2
    parts = F.concat_ws("\n\n", F.substring(c, 1, third), F.substring(c, middle + 1, F.lit(third)), F.substring(c, -third, third))
    return F.when(F.length(c) <= cap, c).otherwise(parts)


def snippet(c: Column, most: int = 600) -> Column:
    """Cut to most characters, the ellipsis within them."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 1))), F.lit("…"))).otherwise(c)


def preview(c: Column, most: int = 300) -> Column:
    """The first characters with an ellipsis after them."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def phrase(c: Column, most: int) -> Column:
    """White space collapsed, edges stripped of blanks and , ; : -, cut to most characters."""
    edge = r"^[ ,;:\-]+|[ ,;:\-]+$"
    bare = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), edge, "")
    return F.when(F.length(bare) > most, F.regexp_replace(F.left(bare, F.lit(most)), r"[ ,;:\-]+$", "")).otherwise(bare)


def any_of(c: Column, words: list[str]) -> Column:
    """Whether c contains one of the words as a substring."""
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def cascade(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The value of the first rule one of whose words c contains."""
    value, words = rules[0]
    out = F.when(any_of(c, words), value)
    for value, words in rules[1:]:
        out = out.when(any_of(c, words), value)
    return out.otherwise(default)


def canonical_key(c: Column, compat: bool = False) -> Column:
    """Lower case, everything but letters, digits, marks and _ to one space. compat: combining marks go as well.

    Composition to NFC is left to the caller for text that holds combining marks (see sources.normalised).
    """
    out = F.lower(c)
    if compat:
        out = F.regexp_replace(out, r"\p{M}", " ")
    return collapse(F.regexp_replace(out, r"(?U)[^\w\s]", " "))


_FOLD_FROM = "àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöøōřśšşťùúûüūůýÿžźż"
_FOLD_TO = "".join("o" if c == "ø" else unicodedata.normalize("NFKD", c)[0] for c in _FOLD_FROM)


def slug(c: Column) -> Column:
    """ASCII key: lower case, diacritics folded, only a-z, 0-9 and _ for white space."""
    folded = F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)
    kept = F.trim(F.regexp_replace(folded, r"[^a-z0-9\s]", ""))
    return F.regexp_replace(kept, r"\s+", "_")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of name in a namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
