"""Evaluation texts leaking into training text.

1. Items and corpus texts are taken apart into windows of ``PROBE`` words: every window of the items, and of the corpus every one
   that starts at a multiple of ``least - PROBE + 1`` words, so that whatever ``least`` words a text has in common with an item hold one.
2. Every window gets a 64-bit SimHash of its words. Fingerprints within ``RADIUS`` bits of each other agree on at least one of
   RADIUS + 1 blocks (pigeonhole), so looking up each block finds all of them.
3. A pair of windows is verified by the weighted similarity of its shingles (a word weighs its rarity among the items, a pair of
   neighbours as much as both), ``SIMILARITY`` or more. A word no item has weighs the most, and where a window holds one, its
   similarity cannot exceed 1 - 3/13; such windows are passed over before they are hashed.
4. Verified pairs are extended: ``words`` is the longest run of equal words, on either side and in it, that touches the pair.
   A document is reported with an item if it is ``least`` or more.

Words are runs of letters and digits after markup, case, width, accents, look-alike letters, invisible characters and hyphens at
line ends have been undone (``plain_words``). Null, blank and short texts hold no window. The items are a stated test set: they are
taken in blocks of bounded size (``MAX_ITEMS``, ``MAX_CHARS``), each sent to the executors, which build its tables once per
worker; the corpus is scanned once a block, whole texts, without a shuffle.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.charform import fold

LEAST, PROBE, RADIUS, SIMILARITY = 8, 5, 2, 0.8
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Most items and characters of a block of items.
MAX_ITEMS, MAX_CHARS = 100_000, 1 << 25
#: Words of texts that are looked up together.
TOGETHER = 1 << 17

_comment = regex.compile(r"(?s)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", regex.I)
_break = regex.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|section|header|pre|blockquote)\b[^<>]*>", regex.I)
_tag = regex.compile(r"</?[A-Za-z][^<>]*>")
_link = regex.compile(r"\]\([^()\s]*\)")
_wiki = regex.compile(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]")
_command = regex.compile(r"\\[A-Za-z]+\*?(?=[{\s\[])")
_hyphen = regex.compile(r"(?<=\w)[-\u2010\u2011\u00ad][ \t]*\r?\n[ \t>*#|]*(?=\w)")
_words = regex.compile(r"[^\W_]+")
_invisible = regex.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")


def plain_words(text: str) -> list[str]:
    """Words of a text, with everything undone that may differ between two copies of a passage."""
    if "<" in text or "&" in text:
        for _ in range(2):
            if "&" in text:
                text = html.unescape(text)
        if "<" in text:
            text = _tag.sub("", _break.sub(" ", _comment.sub(" ", text)))
    if not text.isascii():
        text = _invisible.sub("", text)
    if "-" in text or not text.isascii():
        text = _hyphen.sub("", text)
    if "](" in text:
        text = _link.sub("]", text)
    if "[[" in text:
        text = _wiki.sub(r"\1", text)
    if "\\" in text:
        text = _command.sub("", text)
    return _words.findall(fold(text).casefold())


class Items:
    """Windows of the evaluation items, with one sorted table per block of the fingerprint."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST) -> None:
        self.least, self.probe = least, min(PROBE, least)
        words = [plain_words(t or "") for t in texts]
        self.known = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.words, self.first, self.end = self.laid_out(words)
        self.item = np.repeat(np.arange(len(ids)), self.end - self.first)
        self.ids = np.array(ids, np.int64)
        prints = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
        self.bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.bincount(self.words, minlength=len(self.known))
        self.rarity = np.log1p(len(self.words) / np.maximum(counts, 1))
        self.at = self.starts(self.first, self.end, 1)
        self.prints = self.simhash(self.words, self.at)
        self.blocks = []
        for shift, width in BLOCKS:
            key = (self.prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(key, kind="stable")
            present = np.zeros(1 << width, bool)
            present[key] = True
            self.blocks.append((shift, width, present, key[order], order))

    def laid_out(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of all texts one after the other (-1: no word of an item), and where each text begins and ends."""
        n = np.array([len(w) for w in texts], np.int64)
        end = np.cumsum(n)
        get = self.known.get
        numbers = np.empty(int(n.sum()), np.int64)
        for w, s, e in zip(texts, (end - n).tolist(), end.tolist()):
            numbers[s:e] = np.fromiter(map(get, w, repeat(-1)), np.int64, e - s)
        return numbers, end - n, end

    def starts(self, first: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
        """Starts of the windows within the texts, every ``step`` words."""
        n = np.maximum((end - first - self.probe) // step + 1, 0)
        return np.repeat(first, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    def simhash(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """SimHash of the windows at ``at``: a bit is set where more than half of the words have it."""
        if not len(at):
            return np.zeros(0, np.uint64)
        total = self.bits[words[at]].copy()
        for k in range(1, self.probe):
            total += self.bits[words[at + k]]
        return np.packbits(total > self.probe // 2, axis=1).view(np.uint64).ravel()

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the text, window of the items) of all pairs within the radius, each once."""
        left, right = [], []
        for shift, width, present, keys, order in self.blocks:
            key = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            hit = np.flatnonzero(present[key])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            n = hi - lo
            a = np.repeat(hit, n)
            b = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            near = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
            left.append(a[near])
            right.append(b[near])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(left).astype(np.int64) << 32 | np.concatenate(right))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted similarity of windows (rows of word numbers): common over all of their words and word pairs, in place."""
        wa, wb = self.rarity[a], self.rarity[b]
        same = a == b
        pair = same[:, 1:] & same[:, :-1]
        pa_, pb = wa[:, 1:] + wa[:, :-1], wb[:, 1:] + wb[:, :-1]
        both = (np.minimum(wa, wb) * same).sum(1) + (np.minimum(pa_, pb) * pair).sum(1)
        return both / np.maximum((np.maximum(wa, wb)).sum(1) + np.maximum(pa_, pb).sum(1), 1e-9)

    def run(self, words: np.ndarray, s: int, e: int, a: int, b: int) -> int:
        """Longest run of equal words touching the pair of windows at a (text words[s:e]) and b (of the items)."""
        k = self.item[b]
        lo = min(a - s, b - int(self.first[k]))
        n = min(e - a, int(self.end[k]) - b)
        same = words[a - lo : a + n] == self.words[b - lo : b + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        begins, ends = edges[::2], edges[1::2]
        touching = (ends > lo) & (begins < lo + self.probe)
        return int((ends - begins)[touching].max(initial=0))

    def leaks(self, texts: list[list[str]]) -> list[dict[int, int]]:
        """For each text (its words) the items, by id, of which ``least`` consecutive words stand in it, with the longest run."""
        out: list[dict[int, int]] = [{} for _ in texts]
        words, first, end = self.laid_out(texts)
        at = self.starts(first, end, self.least - self.probe + 1)
        known = words >= 0
        open_ = known[at] if len(at) else np.zeros(0, bool)
        for k in range(1, self.probe):
            open_ = open_ & known[at + k]
        at = at[open_]
        if not len(at) or not len(self.at):
            return out
        a, b = self.candidates(self.simhash(words, at))
        a, b = at[a], self.at[b]
        step = np.arange(self.probe)
        ok = self.similarity(words[a[:, None] + step], self.words[b[:, None] + step]) >= SIMILARITY
        text = np.searchsorted(end, a, side="right")
        for x, y, t in zip(a[ok].tolist(), b[ok].tolist(), text[ok].tolist()):
            n = self.run(words, int(first[t]), int(end[t]), x, y)
            if n >= self.least:
                i = int(self.ids[self.item[y]])
                out[t][i] = max(n, out[t].get(i, 0))
        return out


def find_leaks(
    corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, least: int = LEAST, max_items: int = MAX_ITEMS
) -> DataFrame:
    """(doc id, item_id, words) of every corpus text that holds at least ``least`` consecutive words of an item; each pair once per row.

    Repeated rows of the corpus give repeated rows; an item id that stands with several texts may be given once for each block its
    texts lie in. No items, or none long enough: no rows. ``least`` is at least 1.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size["n"] // max_items), -(-size["c"] // MAX_CHARS))
    source = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = None
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "t").toPandas()
        got = _scan(source, source.sparkSession.sparkContext.broadcast((part["i"].tolist(), part["t"].tolist())), least)
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("id", id_col)


_built: dict[str, Items] = {}


def _items(sent: Broadcast, key: str, least: int) -> Items:
    """Tables of a block of items, built once per worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(*sent.value, least)
    return _built[key]


def _scan(source: DataFrame, sent: Broadcast, least: int) -> DataFrame:
    key = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(sent, key, least)
        for b in batches:
            rows: list[tuple[int | None, int, int]] = []
            ids: list[int | None] = []
            texts: list[list[str]] = []
            n = 0

            def look_up() -> None:
                for doc, found in zip(ids, items.leaks(texts)):
                    rows.extend((doc, i, w) for i, w in sorted(found.items()))
                ids.clear()
                texts.clear()

            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = plain_words(text.as_py())
                if len(words) >= least:
                    ids.append(doc)
                    texts.append(words)
                    n += len(words)
                if n > TOGETHER:
                    look_up()
                    n = 0
            look_up()
            docs, found, run_ = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(run_, pa.int32())], names=["id", "item_id", "words"])

    return source.mapInArrow(run, "id long, item_id long, words int")
