"""Redirect records and the links of entry bodies, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.normalize import col, trim_unicode

REDIRECT_PREFIX = "@@@LINK="
# Attributes that carry a link.
LINK_ATTRIBUTES = r"""(?i)\b(src|href|xlink:href|data-src|data-href|poster)\s*=\s*["']([^"']+)["']"""
# Prefixes of links that leave the dictionary.
EXTERNAL = r"(?i)^(https?://|data:|javascript:|mailto:|tel:|about:|//|#)"
# Extensions of resource files.
RESOURCE_EXTENSIONS = (
    "jpg jpeg png gif bmp webp svg ico css js wav mp3 ogg oga flac aac m4a mp4 webm ttf otf woff woff2 eot pdf"
).split()
# Named character entities undone in attribute values (numeric ones are undone by rule).
NAMED_ENTITIES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def redirect_target(body: Column | str) -> Column:
    """Headword a redirect record points to: optional BOM, the prefix, first line without control characters. Null: no redirect."""
    line = F.regexp_extract(col(body), r"^\x{FEFF}?@@@LINK=([^\n]*)", 1)
    word = trim_unicode(F.regexp_replace(trim_unicode(line), r"\p{Cc}", ""))
    return F.when(word != "", word)


def is_external(value: Column | str) -> Column:
    return col(value).rlike(EXTERNAL)


def split_suffix(value: Column | str) -> tuple[Column, Column]:
    """(base, suffix): the suffix begins at the first ``?`` or ``#``."""
    v = col(value)
    return F.regexp_extract(v, r"(?s)^([^?#]*)", 1), F.regexp_extract(v, r"(?s)^[^?#]*(.*)$", 1)


def resource_path(value: Column | str) -> Column:
    """Forward slashes, without empty, ``.`` and ``..`` segments."""
    parts = F.split(F.replace(trim_unicode(value), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda s: ~s.isin("", ".", "..")), "/")


def has_resource_extension(path: Column | str) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).isin(RESOURCE_EXTENSIONS)


def looks_like_resource(path: Column | str) -> Column:
    p = col(path)
    inner = F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"^\\+", "")
    plain = (inner != "") & ~inner.rlike(r"[/\\]") & ~has_resource_extension(inner)
    rooted = p.rlike(r"^(\./|\.\./|\\|/)") | p.contains("\\")
    return F.when(rooted, ~plain).otherwise(p.contains("/") | has_resource_extension(p))


def entry_word(base: Column | str) -> Column:
    out = F.regexp_replace(trim_unicode(base), "^/+|/+$", "")
    return F.regexp_replace(out, r"^\\+|\\+$", "")


def link_kind(attr: Column | str, value: Column | str) -> Column:
    """``external``, ``audio``, ``entry``, ``resource``, ``fragment`` or ``none`` of a link attribute."""
    a, v = F.lower(col(attr)), trim_unicode(value)
    base, suffix = split_suffix(v)
    entry_base = split_suffix(F.substring(v, len("entry://") + 1, 1 << 30))[0]
    empty = F.when(suffix != "", "fragment").otherwise("none")
    return (
        F.when(v == "", "none")
        .when(is_external(v), "external")
        .when(v.startswith("sound://"), "audio")
        .when(v.startswith("entry://"), F.when(entry_word(entry_base) != "", "entry").otherwise("fragment"))
        .when(base == "", empty)
        .when(a.isin("src", "data-src", "poster", "xlink:href") | looks_like_resource(base), F.when(resource_path(base) != "", "resource").otherwise("none"))
        .when(entry_word(base) != "", "entry")
        .otherwise(empty)
    )


def percent_encode(c: Column | str) -> Column:
    """Everything but ASCII letters and digits as %XX of its UTF-8 bytes."""
    out = F.url_encode(col(c))
    for plain, coded in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def percent_decode(c: Column | str) -> Column:
    """%XX undone; a value with malformed escapes is kept as it is."""
    safe = F.replace(col(c), F.lit("+"), F.lit("%2B"))
    return F.when(col(c).contains("%"), F.coalesce(F.try_url_decode(safe), col(c))).otherwise(col(c))


def unescape_entities(c: Column | str) -> Column:
    """Numeric character references and the common named ones undone, each once."""
    v = col(c)
    parts = F.split(v, r"(?=&)|(?<=;)")
    numeric = lambda p, rx, base: F.conv(F.regexp_extract(p, rx, 1), base, 10).cast("int")
    code = lambda p: F.when(p.rlike(r"^&#[0-9]{1,7};$"), numeric(p, "^&#([0-9]+);$", 10)).when(
        p.rlike(r"^&#[xX][0-9a-fA-F]{1,6};$"), numeric(p, "^&#[xX]([0-9a-fA-F]+);$", 16)
    )
    named = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
    # a code point as text: its UTF-32 bytes, decoded
    text = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    one = lambda p: F.coalesce(F.when(code(p).between(1, 0x10FFFF), text(code(p))), F.try_element_at(named, p), p)
    return F.when(v.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(v)


def with_entry_target(df: DataFrame, attr: str, value: str, out: str) -> DataFrame:
    """Add the word an ``href`` or ``data-href`` means: escapes undone, query and fragment removed. Null: no entry link.

    The steps are separate projections, so that none of the regular expressions is evaluated twice.
    """
    df = df.withColumn("_v", trim_unicode(unescape_entities(value)))
    df = df.withColumn("_kind", link_kind(attr, "_v"))
    bare = F.when(F.col("_v").startswith("entry://"), F.substring("_v", len("entry://") + 1, 1 << 30)).otherwise(F.col("_v"))
    df = df.withColumn("_base", split_suffix(bare)[0]).withColumn("_word", entry_word(percent_decode("_base")))
    ok = F.lower(col(attr)).isin("href", "data-href") & (F.col("_kind") == "entry") & (F.col("_word") != "")
    return df.withColumn(out, F.when(ok, F.col("_word"))).drop("_v", "_kind", "_base", "_word")
