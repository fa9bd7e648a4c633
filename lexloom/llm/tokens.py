"""Encoding with a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is halved until its parts fit a leaf; leaves are encoded on their own. Two neighbours are joined by encoding a window around
their border again. On either side it grows until it begins and ends at a border of pre-tokens that nothing beyond can move; the
tokens outside the window stand. The join gives the ids of the whole text, hence it is associative, and any tree gives the same.

Why a border is certain. No pre-token holds a letter or digit with white space after it, a letter with a digit or punctuation after
it, or anything across such a place: white space only begins a pre-token or is one by itself, contractions end with their letters.
Whatever precedes, a pre-token ends there, and the next one is matched from there on, without regard to what was before.

Null and empty texts have no tokens: an empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf, and of the first window to the left of a border.
LEAF, WINDOW = 256, 32
CERTAIN = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \t\r\n])|(?<=\p{L})(?=[\p{N}\p{P}])")


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER, pattern: str = PATTERN) -> tiktoken.Encoding:
    """One encoder per Python worker and vocabulary file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Part:
    """A stretch of text and its ids."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]) -> None:
        self.text, self.ids = text, ids


def leaf(text: str, path: str = TOKENIZER) -> Part:
    return Part(text, encoder(path).encode_ordinary(text))


def last_border(text: str) -> int:
    """The last certain border, 0 if there is none; looked for in windows that grow from the end."""
    size = WINDOW
    while True:
        begin = max(1, len(text) - size)
        found = [m.start() for m in CERTAIN.finditer(text, begin)]
        if found or begin == 1:
            return found[-1] if found else 0
        size *= 2


def join(a: Part, b: Part, path: str = TOKENIZER) -> Part:
    """The monoid's product: the part over both stretches."""
    if not a.text or not b.text:
        return b if not a.text else a
    encode = encoder(path).encode_ordinary
    s = last_border(a.text)
    m = CERTAIN.search(b.text, 1)
    e = m.start() if m else len(b.text)
    tail, head = a.text[s:], b.text[:e]
    stays = len(a.ids) - len(encode(tail)) if s else 0
    return Part(a.text + b.text, a.ids[:stays] + encode(tail + head) + b.ids[len(encode(head)) if m else len(b.ids) :])


def tree(text: str, path: str = TOKENIZER, size: int = LEAF) -> Part:
    """Encode by halves."""
    if len(text) <= size:
        return leaf(text, path)
    half = len(text) // 2
    return join(tree(text[:half], path, size), tree(text[half:], path, size), path)


def encode_texts(texts: list[str | None], path: str = TOKENIZER, size: int = LEAF) -> list[list[int]]:
    """Ids of each text; a tree of a single leaf needs no borders."""
    e = encoder(path)
    return [[] if not t else e.encode_ordinary(t) if len(t) <= size else tree(t, path, size).ids for t in texts]


def decode(ids, path: str = TOKENIZER) -> str:
    """The text of ids: concatenation of the tokens' bytes."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", "replace")


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER, size: int = LEAF) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row of df; repeated ids give repeated rows, null and empty texts an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = encode_texts(b.column(1).to_pylist(), path, size)
            counts = np.fromiter((len(x) for x in got), np.int64, len(got))
            flat = np.concatenate([np.asarray(x, np.int32) for x in got]) if len(got) else np.zeros(0, np.int32)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)
