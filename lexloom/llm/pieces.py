"""Splitting oversized texts at natural boundaries.

A text of more than ``limit`` tokens is taken apart by a hierarchy of separators: sections, paragraphs, sentences, words, then
characters; a finer level is used only inside a part that is still too large. The parts are packed greedily, in order, into
pieces of at most ``limit`` tokens. Every piece but the first begins with the end of the one before: at most ``overlap`` tokens,
from the first sentence that starts within them, else the first word, else exactly that many tokens. Pieces are substrings:
start and end are character offsets, and the pieces without their overlap are the text.

Texts within the limit are one piece; null and empty texts give none. Repeated ids are split once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.tokens import PATTERN, TOKENIZER, encoder, tree

LIMIT, OVERLAP = 1024, 64
#: Characters of a leaf of the tree by which long texts are encoded here.
LEAF = 1 << 14
#: Cut positions are the ends of these matches, from coarse to fine.
SECTION = regex.compile(r"\n\s*(?=#{1,6} |={2,} ?\S|\\(?:sub)*section\{|[^\n]+\n(?:={3,}|-{3,})[ \t]*(?:\n|$))")
PARAGRAPH = regex.compile(r"\n[ \t]*\n\s*|\r\n[ \t]*\r\n\s*")
# a single letter with a full stop ("e.g. ", "J. ") ends no sentence
SENTENCE = regex.compile(r"(?:(?:[!?…]|(?<!(?:^|[\s.(])\p{L})\.)+[\"'”’»)\]]*\s+|[。！？]+[」』）]*\s*|\n+)")
FENCE = regex.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?^[ \t]*\1[ \t]*$")
WORD = regex.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, SENTENCE, WORD)


_word = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def token_bytes(path: str = TOKENIZER) -> np.ndarray:
    """Length in bytes of every token."""
    e = encoder(path)
    out = np.zeros(e.n_vocab + 1, np.int64)
    for b, i in e._mergeable_ranks.items():
        out[i] = len(b)
    return out


def borders(text: str, ids: list[int], path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin (character offsets, and the end), and the number of ids before each of them."""
    at = np.concatenate([np.zeros(1, np.int64), np.fromiter((m.end() for m in _word.finditer(text)), np.int64)])
    cum = np.concatenate([np.zeros(1, np.int64), np.cumsum(token_bytes(path)[np.array(ids, np.int64)])])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = at if len(data) == len(text) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[at]
    return at, np.searchsorted(cum, starts)


class Cutter:
    """Boundaries and token counts of one text."""

    def __init__(self, text: str, ids: list[int], limit: int, overlap: int, path: str) -> None:
        self.text, self.limit, self.overlap, self.path = text, limit, overlap, path
        self.borders, self.before = borders(text, ids, path)
        self.cuts = [np.fromiter((m.end() for m in rx.finditer(text)), np.int64) for rx in LEVELS]
        # code between fences is one part as long as it fits
        for m in FENCE.finditer(text) if "```" in text or "~~~" in text else ():
            self.cuts[:2] = [c[(c <= m.start()) | (c >= m.end())] for c in self.cuts[:2]]

    def tokens_at(self, pos: int) -> float:
        """Tokens before a character, in proportion inside a pre-token."""
        return float(np.interp(pos, self.borders, self.before))

    def size(self, s: int, e: int) -> float:
        return self.tokens_at(e) - self.tokens_at(s)

    def count(self, s: int, e: int) -> int:
        return len(encoder(self.path).encode_ordinary(self.text[s:e]))

    def units(self, s: int, e: int, level: int, most: int) -> Iterator[tuple[int, int]]:
        size = self.size(s, e)
        # a small part is far from the limit, however its ends are tokenized; pieces are counted again when they are packed
        if size <= most - 4 and (4 * size <= most or self.count(s, e) <= most):
            yield s, e
        elif level < len(LEVELS):
            at = self.cuts[level]
            inner = at[np.searchsorted(at, s, side="right"): np.searchsorted(at, e, side="left")]
            if level == len(LEVELS) - 1 and len(inner):  # words: steps of a packed run, not one unit per word
                inner = self._runs(s, e, inner, most)
            edges = [s, *inner.tolist(), e]
            for a, b in zip(edges, edges[1:]):
                yield from self.units(a, b, level + 1, most)
        else:
            yield from self._characters(s, e, most)

    def _runs(self, s: int, e: int, inner: np.ndarray, most: int) -> np.ndarray:
        """Of the word boundaries inside, those that part runs of about a thirty-second of the size."""
        n = np.interp(inner, self.borders, self.before)
        step = max(1, most // 32)
        slot = ((n - self.tokens_at(s)) // step).astype(np.int64)
        last = np.append(slot[1:] != slot[:-1], True)
        return inner[last]

    def _characters(self, s: int, e: int, most: int) -> Iterator[tuple[int, int]]:
        while s < e:
            step = max(1, int((e - s) * min(1.0, (most - 4) / max(self.size(s, e), 1))))
            b = min(e, s + step)
            while b > s + 1 and self.count(s, b) > most:
                b = s + max(1, (b - s) * 7 // 8)
            if b == s + 1 < e and 0xD800 <= ord(self.text[s]) <= 0xDBFF:
                b += 1
            yield s, b
            s = b

    def back(self, s: int, e: int) -> int:
        """Where the piece after text[s:e] begins."""
        if not self.overlap or e >= len(self.text):
            return e
        low = self.tokens_at(e) - self.overlap
        first = max(int(np.searchsorted(self.before, low, side="left")), 0)
        floor = max(int(self.borders[min(first, len(self.borders) - 1)]), s + 1)
        if floor >= e:  # one long pre-token: by characters
            floor = max(s + 1, e - max(1, int((e - s) * self.overlap / max(self.size(s, e), 1))))
        for at in (self.cuts[2], self.cuts[3]):
            i = int(np.searchsorted(at, floor, side="left"))
            while i < len(at) and at[i] < e:
                if self.count(int(at[i]), e) <= self.overlap:
                    return int(at[i])
                i += 1
        while floor < e and self.count(floor, e) > self.overlap:
            floor += 1
        return floor

    def pieces(self) -> list[tuple[int, int, int, int]]:
        """(start, end, tokens, characters shared with the piece before)."""
        units = list(self.units(0, len(self.text), 0, self.limit - self.overlap))
        out: list[tuple[int, int, int, int]] = []
        s, i, shared = 0, 0, 0
        while i < len(units):
            e, n = units[i][1], None
            j = i + 1
            while j < len(units) and self.size(s, units[j][1]) <= self.limit - 4:
                e, j = units[j][1], j + 1
            n = self.count(s, e)
            while n > self.limit and j > i + 1:
                j -= 1
                e = units[j - 1][1]
                n = self.count(s, e)
            while n > self.limit:  # the overlap does not fit: less of it
                s = min(units[i][0], s + max(1, (units[i][0] - s) // 2))
                shared = units[i][0] - s
                n = self.count(s, e)
            out.append((s, e, n, shared))
            i = j
            if i < len(units):
                s = self.back(s, e)
                shared = e - s
        return out


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> list[tuple[int, int, int, int]]:
    """Pieces of one text, see Cutter.pieces."""
    if not text:
        return []
    ids = tree(text, path, LEAF).ids
    if len(ids) <= limit:
        return [(0, len(text), len(ids), 0)]
    return Cutter(text, ids, limit, overlap, path).pieces()


def split_column(
    df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER, with_text: bool = True
) -> DataFrame:
    """(id, piece_no, start, end, n_tokens, shared, n_pieces[, text]) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = split_text(text, limit, overlap, path)
                rows += [(key, k, s, e, n, x, len(got), *([text[s:e]] if with_text else [])) for k, (s, e, n, x) in enumerate(got)]
            cols = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    whole = pa.int64()
    fields = [("id", whole), ("piece_no", pa.int32()), ("start", whole), ("end", whole), ("n_tokens", pa.int32()), ("shared", whole), ("n_pieces", pa.int32())]
    schema = "id long, piece_no int, start long, end long, n_tokens int, shared long, n_pieces int"
    if with_text:
        fields.append(("text", pa.string()))
        schema += ", text string"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
