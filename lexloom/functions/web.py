"""Pure parts of the serving layer as columns: byte ranges, entity tags, cache invalidation, clicked links, highlighting."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions.normalize import col

# Budgets of block caches, in bytes.
READER_TOTAL, READER_FLOOR, READER_MOST = 256 << 20, 8 << 20, 64 << 20


def byte_range(header: Column | str, total: Column | str) -> Column:
    """struct(first, last) of a ``bytes=a-b`` header over ``total`` bytes; null where it cannot be met or names several."""
    h, n = col(header), col(total).cast("long")
    a = F.try_to_number(F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    b = F.try_to_number(F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")), F.lit("999999999999999999")).cast("long")
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(n - b, F.lit(0)))
    last = F.when(a.isNull(), n - 1).otherwise(F.least(F.coalesce(b, n - 1), n - 1))
    ok = h.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (n > 0) & (first < n) & (first <= last) & (a.isNotNull() | (b > 0))
    return F.when(ok, F.struct(first.alias("first"), last.alias("last")))


@F.pandas_udf(StringType())
def etag(body: pd.Series) -> pd.Series:
    """Weak tag of a BINARY body: its length and Adler-32."""
    return body.map(lambda b: None if b is None else f'W/"{len(b):x}-{zlib.adler32(bytes(b)):x}"')


def cache_key_involves(key: Column | str, ids: list[str]) -> Column:
    """Whether a cache entry goes when these dictionaries change; aggregates always do."""
    k = F.regexp_replace(col(key), "^negative:", "")
    of = F.regexp_extract(k, r"^(?:entry|resource):dict:([^:]+):", 1)
    return k.startswith("entry:aggregate:") | of.isin(ids)


def navigation(href: Column | str, origin: str) -> Column:
    """What a clicked link means: audio, anchor, entry, resource, external."""
    h = col(href)
    local = F.when(h.startswith(origin), F.substring(h, len(origin) + 1, 1 << 30)).otherwise(h)
    return (
        F.when(h.startswith("sound://") | local.rlike("^/dict/[^/]+/audio/"), "audio").when(h.startswith("#"), "anchor")
        .when(h.startswith("entry://") | local.rlike("^/dict/[^/]+/entry/"), "entry").when(local.rlike("^/(dict/[^/]+/res|resource)/"), "resource")
        .when(local.rlike(r"^(https?:)?//"), "external").when(local.rlike("^/[^/]+$"), "entry").otherwise("external")
    )


def reader_budget(readers: Column | str) -> Column:
    """Bytes each of n readers may cache."""
    return F.least(F.greatest(F.floor(F.lit(READER_TOTAL) / F.greatest(col(readers), F.lit(1))), F.lit(READER_FLOOR)), F.lit(READER_MOST)).cast("long")


_text = re.compile(r"(<(script|style)\b.*?</\2>|<[^>]*>)", re.I | re.S)


def highlight_one(html: str | None, term: str | None) -> str | None:
    """Every occurrence of a term in the text between tags, whatever its case, in <mark>."""
    if not html or not term or not term.strip():
        return html
    rx = re.compile(re.escape(term.strip()), re.I)
    out, last = [], 0
    for m in _text.finditer(html):
        out += [rx.sub(lambda x: f"<mark>{x[0]}</mark>", html[last : m.start()]), m[0]]
        last = m.end()
    return "".join([*out, rx.sub(lambda x: f"<mark>{x[0]}</mark>", html[last:])])


@F.pandas_udf(StringType())
def highlight(html: pd.Series, term: pd.Series) -> pd.Series:
    return pd.Series([highlight_one(h, t) for h, t in zip(html, term)], dtype=object)


class ByteLru:
    """Blocks by least recent use within a budget of bytes; one that exceeds it alone is never kept."""

    def __init__(self, budget: int) -> None:
        self.budget, self.used, self.blocks = budget, 0, {}

    def get(self, key):
        if key in self.blocks:
            self.blocks[key] = self.blocks.pop(key)
        return self.blocks.get(key)

    def put(self, key, data: bytes) -> None:
        if len(data) > self.budget:
            return
        self.used -= len(self.blocks.pop(key, b""))
        self.blocks[key] = data
        self.used += len(data)
        while self.used > self.budget:
            self.used -= len(self.blocks.pop(next(iter(self.blocks))))
