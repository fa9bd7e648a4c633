"""Headword normalisation as native column expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded one to one, lower case only, grouped by the letter they fold to.
DIACRITICS = {
    "a": "àáâãäåāăą",
    "c": "çćĉċč",
    "d": "ďđ",
    "e": "èéêëēĕėęě",
    "f": "ƒ",
    "g": "ĝğġģ",
    "h": "ĥħ",
    "i": "ìíîïĩīĭįı",
    "j": "ĵ",
    "k": "ķ",
    "l": "ĺļľŀł",
    "n": "ñńņňŉ",
    "o": "òóôõöøōŏő",
    "r": "ŕŗř",
    "s": "śŝşš",
    "t": "ţťŧ",
    "u": "ùúûüũūŭůűų",
    "w": "ŵ",
    "y": "ýÿŷ",
    "z": "źżž",
}
# Letters folded to two.
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss"}
# Quotes and dashes of typed lookup keys.
QUOTES = "‘’‛′"
DASHES = "‐‑‒–—−"
# Irregular English forms and their lemma.
IRREGULAR = {
    "went": "go", "gone": "go",
    "did": "do", "done": "do",
    "was": "be", "were": "be", "is": "be", "are": "be", "am": "be",
    "better": "good", "best": "good",
    "worse": "bad", "worst": "bad",
    "children": "child", "mice": "mouse", "teeth": "tooth", "feet": "foot", "men": "man", "women": "woman",
}
MAX_CANDIDATES = 32

FOLD_FROM = "".join(DIACRITICS.values())
FOLD_TO = "".join(to * len(chars) for to, chars in DIACRITICS.items())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_diacritics(c: Column | str) -> Column:
    """Lower-case Latin letters without their marks; combining marks are left alone."""
    out = F.translate(col(c), FOLD_FROM, FOLD_TO)
    for letter, pair in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def fold_punctuation(c: Column | str) -> Column:
    """Keep letters, digits and the apostrophe; every run of other characters is one space; no space at the ends."""
    return F.trim(F.regexp_replace(col(c), r"[^\p{IsAlphabetic}\p{N}']+", " "))


def canonical_normalize(c: Column | str) -> Column:
    """The key stored as ``normalized``: lower case, folded letters, punctuation as single spaces. Null stays null."""
    return fold_punctuation(fold_diacritics(F.lower(col(c))))


def lookup_key(c: Column | str) -> Column:
    """Typed words: control characters dropped, spaces collapsed, quotes and dashes made plain, lower case per character."""
    out = F.regexp_replace(col(c), r"\p{Cc}", "")
    out = F.regexp_replace(out, r"(?U)[\s\x{00A0}\x{3000}]+", " ")
    out = F.translate(out, QUOTES + DASHES, "'" * len(QUOTES) + "-" * len(DASHES))
    # per-character lower case has no final sigma: the capital is lowered before lower() can see its context
    return F.trim(F.lower(F.translate(out, "Σ", "σ")))


def ascii_fold(c: Column | str) -> Column:
    """Case folding of the 26 ASCII letters only (the NOCASE rule)."""
    return F.translate(col(c), UPPER, LOWER)


def trim_unicode(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def prefix_upper(prefix: str) -> str | None:
    """Smallest string above every string that starts with ``prefix``; None where there is none."""
    if not prefix:
        return None
    code = ord(prefix[-1]) + 1
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return None
    return prefix[:-1] + chr(code)


def trim_doubled(c: Column | str) -> Column:
    """The stem without its doubled last letter (b to z); null where nothing is doubled."""
    out = F.regexp_replace(col(c), r"([b-z])\1$", "$1")
    return F.when(out != col(c), out)


def irregular_lemma(c: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return F.try_element_at(pairs, col(c))


def _strip(c: Column, n: int) -> Column:
    """Without the last ``n`` characters."""
    return F.substring(c, F.lit(1), F.length(c) - n)


def lemma_candidates(c: Column | str) -> Column:
    """Ordered English base forms of a word, array<string>; empty where the word is not plain ASCII without spaces."""
    s = F.trim(col(c))
    w = ascii_fold(s)
    ends = lambda x, longer: w.endswith(x) & (F.length(w) > longer)
    three = [("ing", 5), ("ed", 4)]
    parts = [
        w,
        irregular_lemma(w),
        F.when(w.endswith("'s"), _strip(w, 2)),
        F.when(w.endswith("s'"), _strip(w, 2)),
        F.when(ends("ies", 4), F.concat(_strip(w, 3), F.lit("y"))),
        F.when(ends("ves", 4), F.concat(_strip(w, 3), F.lit("f"))),
        F.when(ends("ves", 4), F.concat(_strip(w, 3), F.lit("fe"))),
        F.when(ends("es", 3), _strip(w, 2)),
        F.when(ends("s", 3), _strip(w, 1)),
    ]
    for suffix, longer in three:
        stem = _strip(w, len(suffix))
        parts += [
            F.when(ends(suffix, longer), stem),
            F.when(ends(suffix, longer), trim_doubled(stem)),
            F.when(ends(suffix, longer), F.concat(stem, F.lit("e"))),
        ]
    parts += [F.when(ends("er", 4), _strip(w, 2)), F.when(ends("est", 5), _strip(w, 3))]
    found = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    return F.when(s.rlike(r"^[A-Za-z0-9'\-]+\z"), found).otherwise(F.array().cast("array<string>"))


def query_candidates(c: Column | str) -> Column:
    """Ordered spellings a typed word is looked up by, at most 32, array<string>; empty for null and blank words."""
    raw = trim_unicode(F.coalesce(col(c), F.lit("")))
    stripped = raw
    for edge in (r"^/+", r"^\\+", r"/+$", r"\\+$"):
        stripped = F.regexp_replace(stripped, edge, "")
    key = lookup_key(stripped)
    folded = fold_diacritics(key)
    spaced = fold_punctuation(folded)
    compact = F.replace(spaced, F.lit(" "), F.lit(""))
    keep = lambda a: F.array_distinct(F.filter(a, lambda x: x != ""))
    seeds = keep(F.array(raw, stripped, key, folded, spaced, compact))
    lemmas = F.flatten(F.transform(seeds, lemma_candidates))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.slice(keep(F.concat(seeds, lemmas)), 1, MAX_CANDIDATES))
