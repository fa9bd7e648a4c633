"""Predicates, scores and string functions over headwords and bodies, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.normalize import col, fold_diacritics, trim_unicode

# Content types by extension.
CONTENT_TYPES = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "text/xml",
    "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg",
    "oga": "audio/ogg", "spx": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/m4a", "mp4": "video/mp4",
    "webm": "video/webm", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
    "eot": "application/vnd.ms-fontobject", "pdf": "application/pdf",
}
OCTET_STREAM = "application/octet-stream"
MAX_RESOURCE = 32 * 1024 * 1024
MEDIA_LIMIT, OTHER_LIMIT = 256 * 1024, 1024 * 1024
SPACE = r"(?U)\s"


def is_resource_key(word: Column | str) -> Column:
    return col(word).rlike(r"^[\\/]")


def is_suggest_candidate(word: Column | str) -> Column:
    """At most 40 bytes, no white space, none of / \\ < >, not beginning with - . or a digit."""
    w = col(word)
    return (F.octet_length(w) <= 40) & (w != "") & ~w.rlike(SPACE) & ~w.rlike(r"[/\\<>]") & ~w.rlike(r"^[-.0-9]")


def is_fts_admitted(word: Column | str) -> Column:
    """Headwords the full-text index takes: at most 50 bytes, no white space, none of @ < > / \\, not beginning with - . or a digit."""
    w = col(word)
    return (F.octet_length(w) <= 50) & (w != "") & ~w.rlike(SPACE) & ~w.rlike(r"[@<>/\\]") & ~w.rlike(r"^[-.0-9]")


def is_fuzzy_candidate(word: Column | str) -> Column:
    w = col(word)
    return (F.octet_length(w) <= 64) & (w != "") & ~w.rlike(SPACE) & ~w.rlike(r"[/\\<>]") & ~w.rlike(r"^[-.@0-9]")


def is_displayable(word: Column | str) -> Column:
    """Words a random pick may show: at most 80 bytes, not beginning with \\ / @ . and without < >."""
    w = col(word)
    return (F.octet_length(w) <= 80) & (w != "") & ~w.rlike(r"^[\\/@.]") & ~w.rlike("[<>]")


def is_valid_input(word: Column | str) -> Column:
    w = trim_unicode(word)
    return (w != "") & ~w.isin(".", "#", "?", "/")


def is_inflected(word: Column | str, matched: Column | str) -> Column:
    return F.lower(trim_unicode(word)) != F.lower(trim_unicode(matched))


def relevance(word: Column | str, prefix: Column | str, bm25: Column) -> Column:
    """Integer score of a suggestion for a prefix; bm25 is negative, more negative is better."""
    w, p = col(word), col(prefix)
    lw, lp = F.lower(w), F.lower(p)
    if_ = lambda c, n: F.when(c, n).otherwise(0)
    size = F.least(F.octet_length(w), F.lit(50))
    rank = F.round(F.greatest(F.least(-bm25 * 1000, F.lit(2147480000.0)), F.lit(-2147480000.0))).cast("long")
    total = (
        if_(lw == lp, 1000) + if_(lw.startswith(lp), 100) + if_(w.startswith(F.upper(F.substring(p, 1, 1))), 20) + (50 - size)
        + if_(~w.contains(" "), 30) - if_(w.rlike(r"\p{N}"), 20) - if_(w.rlike("[,;:]"), 10) + rank
    )
    return F.least(F.greatest(total, F.lit(-2147483648)), F.lit(2147483647)).cast("int")


def strip_tags(html: Column | str) -> Column:
    """Tags as spaces, white space collapsed."""
    out = F.regexp_replace(col(html), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


# What is taken out of entry HTML, event handlers and links that run scripts.
UNSAFE = r"""(?i)\s+on\w+\s*=\s*["'][^"']*["']|(src|href)\s*=\s*["']\s*javascript:[^"']*["']"""


def sanitize(html: Column | str) -> Column:
    """Without event handlers and javascript: links."""
    return F.regexp_replace(col(html), UNSAFE, "")


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for sign, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(coded))
    return out


def escape_js(c: Column | str) -> Column:
    """Text for a JavaScript string in double quotes."""
    out = col(c)
    for sign, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(coded))
    return out


def enabled_filter(chosen: Column | str, known: Column | str) -> Column:
    """What a client sends for the dictionaries chosen of those known (arrays): nothing for all, ``__none__`` for none, else their list."""
    c, k = F.array_intersect(col(chosen), col(known)), col(known)
    return F.when(F.size(c) == 0, "__none__").when(F.size(c) < F.size(F.array_distinct(k)), F.array_join(c, ","))


def content_type(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit(OCTET_STREAM))


def is_cacheable(kind: Column | str, size: Column | str) -> Column:
    """Media up to 256 KiB, everything else up to 1 MiB."""
    return F.when(col(kind).rlike("^(audio|video|image)/"), col(size) <= MEDIA_LIMIT).otherwise(col(size) <= OTHER_LIMIT)


def dict_filter(dicts: Column | str) -> Column:
    """Comma list to array, trimmed, without empties; an empty array means all."""
    parts = F.transform(F.split(F.coalesce(col(dicts), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def cache_key(word: Column | str, fmt: Column | str, dicts: Column | str) -> Column:
    """Key of an aggregate lookup: lower-case word, format, sorted dictionaries."""
    ids = F.array_join(F.array_sort(dict_filter(dicts)), ",")
    key = F.concat(F.lit("entry:aggregate:"), F.lower(trim_unicode(word)), F.when(F.coalesce(col(fmt), F.lit("")) == "json", ":json").otherwise(""))
    return F.when(ids == "", key).otherwise(F.concat(key, F.lit(":"), ids))


def resource_candidates(path: Column | str) -> Column:
    """Spellings a resource is looked up by: as given, rooted, with backslashes, rooted with a backslash."""
    p = F.regexp_replace(col(path), r"^[\\/]+", "")
    slash, back = F.replace(p, F.lit("\\"), F.lit("/")), F.replace(p, F.lit("/"), F.lit("\\"))
    return F.array_distinct(F.array(slash, F.concat(F.lit("/"), slash), back, F.concat(F.lit("\\"), back)))


def fts_tokens(text: Column | str) -> Column:
    """Runs of letters and digits, case and diacritics folded."""
    return F.regexp_extract_all(fold_diacritics(F.lower(col(text))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def trigrams(text: Column | str) -> Column:
    t = F.lower(col(text))
    n = F.char_length(t)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
