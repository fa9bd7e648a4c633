"""Mapping free-entered values to a canonical list.

1. A multi-pattern automaton over the names (folded to one character form, lower case, with and without their spaces and hyphens as
   aliases) finds the names mentioned in a value, whatever stands around them; the longest of overlapping mentions wins, and of
   several that do not overlap the longest, then the first. A mention begins and ends with a word (an inflected ending may follow).
2. What is left goes to token-set similarity: the share of a value's letters that need no edit (transpositions included) to give a
   name's words, in any order or run together; ``1 - max_share`` or more, at most ``max_distance`` edits, and always one edit in
   words of three letters or more. Candidates are the names with enough character pairs in common that none within the bound is missed.
   ``fillers`` (articles before, parts of speech after) and numbers around other words are left out of the comparison.
3. Values without a match are tried again with escapes and wrong encodings undone, and are else reported as standing for none (0).
   Paths of files are no values of the list.

Nulls and blanks are no values, and neither are values that are a name byte for byte. Of equally close names the lowest id wins. The
list is taken in blocks of at most about ``BLOCK`` names, each broadcast and its tables built once per worker; the values are mapped
where they lie, without a shuffle, and a worker remembers the values it has seen, so that a value with a third of all rows costs one
look-up a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.charform import fold
from lexloom.llm.mojibake import candidates

BLOCK = 200_000
REMEMBER = 1 << 18

# Articles and infinitive markers that stand before a headword, and parts of speech after it.
BEFORE = frozenset("a an the to der die das ein eine le la les l un une el los las una".split())
AFTER = frozenset("n v adj adv noun verb adjective adverb phrase pl sg m f".split())
Fillers = tuple[frozenset[str], frozenset[str]]
FILLERS: Fillers = (BEFORE, AFTER)
_ending = re.compile(r"(?:e?s|e?n|.)?")
_path = re.compile(r"^[\\/].*\.[a-z0-9]{2,5}$", re.I)
_letters = re.compile(r"[^\W_]+")


def key_of(value: str) -> str:
    """Value in lower case Latin look-alike letters, without marks."""
    return fold(value).lower().replace("ł", "l").replace("đ", "d").replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; more than ``most`` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what is equal at both ends takes no edits
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    a, b, n = a[k:], b[k:], n - k
    k = 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def pairs_of(s: str) -> list[str]:
    s = f"^{s}$"
    return [s[i : i + 2] for i in range(len(s) - 1)]


class Resolver:
    """One block of the canonical list, ready to resolve values."""

    def __init__(self, ids: list[int], names: list[str], max_distance: int = 3, max_share: float = 0.25, fillers: Fillers = FILLERS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.names = [ids[i] for i in order], [names[i] for i in order]
        self.exact = set(self.names)
        self.max_distance, self.max_share, self.fillers = max_distance, max_share, fillers
        self.tokens = [_letters.findall(key_of(n)) for n in self.names]
        self.compact: dict[str, int] = {}
        self.sets: dict[tuple[str, ...], int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, n in enumerate(self.names):
            key = key_of(n).strip()
            squeezed = "".join(self.tokens[i])
            for alias in (key, squeezed):
                if alias and alias not in self.automaton:
                    self.automaton.add_word(alias, (len(alias), i))
            if squeezed:
                self.compact.setdefault(squeezed, i)
                self.sets.setdefault(tuple(sorted(self.tokens[i])), i)
        self.automaton.make_automaton()
        post: dict[str, list[int]] = {}
        self.sizes = np.zeros(len(self.names))
        for i, t in enumerate(self.tokens):
            grams = set(pairs_of("".join(t)))
            self.sizes[i] = len(grams)
            for g in grams:
                post.setdefault(g, []).append(i)
        self.post = {g: np.array(v) for g, v in post.items()}
        self.seen: dict[str, int] = {}

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, name) of the longest non-overlapping mentions."""
        found = sorted(((end - n + 1, end + 1, i) for end, (n, i) in self.automaton.iter(text)), key=lambda m: (m[0] - m[1], m[0], m[2])) if len(self.automaton) else []
        out: list[tuple[int, int, int]] = []
        for s, e, i in found:
            if all(e <= a or s >= b for a, b, _ in out):
                out.append((s, e, i))
        return sorted(out)

    def _by_mention(self, key: str) -> int | None:
        for s, e, i in sorted(self.mentions(key), key=lambda m: m[0] - m[1]):
            head = re.search(r"[^\W_]*$", key[:s])[0]
            tail = re.match(r"[^\W_]*", key[e:])[0]
            if len(head) <= 1 and _ending.fullmatch(tail):
                return i
        return None

    def _allowed(self, letters: int) -> int:
        """Edits that keep the similarity."""
        return max(min(self.max_distance, int(self.max_share * letters), 2 if letters < 15 else 3), int(letters >= 3))

    def _near(self, tokens: list[str]) -> tuple[int, int] | None:
        """(edits, name) of the most similar name, by token sets."""
        whole = "".join(tokens)
        pairs = set(pairs_of(whole))
        hits = [self.post[g] for g in pairs if g in self.post] if whole else []
        if not hits:
            return None
        common = np.bincount(np.concatenate(hits), minlength=len(self.names))
        n, allowed = len(pairs), self._allowed(len(whole))
        # an edit touches three pairs at most, and words in another order one more at each seam
        seams = 3 * (len(tokens) - 1)
        near = np.flatnonzero(common >= max(n - 3 * allowed - seams, 1))
        dice = 2 * common[near] / (self.sizes[near] + n)
        best: tuple[int, int] | None = None
        for i in near[np.argsort(-dice, kind="stable")].tolist():
            most = allowed if best is None else best[0]
            if common[i] < n - 3 * most - seams:
                continue
            d = self._distance(tokens, whole, i, most)
            if d <= most and (best is None or (d, i) < best):
                best = (d, i)
        return best

    def _distance(self, tokens: list[str], whole: str, i: int, most: int) -> int:
        """Edits between the letters run together, or between the words each with the nearest of the other side, whatever is less."""
        name = self.tokens[i]
        d = edits(whole, "".join(name), most)
        if d and len(tokens) == len(name) > 1:
            left, total = list(name), 0
            for t in sorted(tokens, key=len, reverse=True):
                x, k = min((edits(t, u, most), k) for k, u in enumerate(left))
                total += x
                left.pop(k)
                if total >= d:
                    break
            d = min(d, total)
        return d

    def _plain(self, value: str) -> tuple[int, int] | None:
        key = key_of(value)
        if _path.match(key.strip()):
            return None
        tokens = _letters.findall(key)
        # a name's own words need no mention
        i = self.sets.get(tuple(sorted(tokens)))
        i = self._by_mention(key) if i is None else i
        if i is not None:
            return 0, i
        before, after = self.fillers
        while len(tokens) > 1 and (tokens[0] in before or tokens[0].isdigit()):
            tokens = tokens[1:]
        while len(tokens) > 1 and (tokens[-1] in after or tokens[-1].isdigit()):
            tokens = tokens[:-1]
        i = self._by_mention("".join(tokens))
        return (0, i) if i is not None else self._near(tokens)

    def resolve(self, value: str) -> tuple[int, int] | None:
        """(distance, index of the name) or None."""
        got = self._plain(value)
        if got is None and "%" in value:
            got = self._plain(unquote(value))
        if got is None and not value.isascii():
            tried = [r for _, w in candidates(value.strip()) if (r := self._plain(w)) is not None]
            got = min(tried, default=None)
        return got

    def __call__(self, value: str) -> tuple[int, int]:
        """(distance, id); id 0 for none. Remembered."""
        got = self.seen.get(value)
        if got is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            r = self.resolve(value)
            got = self.seen[value] = (99, 0) if r is None else (r[0], self.ids[r[1]])
        return got


def map_values(
    values: DataFrame, names: DataFrame, id_col: str, name_col: str, max_distance: int = 3, block: int = BLOCK, fillers: Fillers = FILLERS, with_value: bool = False
) -> DataFrame:
    """values(src, row_id, value) with ref_id and distance (and value), without nulls, blanks and values that are names already.

    Repeated rows give repeated rows as long as the list fits a block; blocks are merged per src, row_id and value.
    """
    listed = names.select(F.col(id_col).cast("long").alias("i"), F.col(name_col).cast("string").alias("n")).where("i is not null and n is not null")
    source = values.select("src", F.col("row_id").cast("long"), F.col("value").cast("string")).where("value is not null")
    blocks = max(1, -(-listed.count() // block))
    schema = "src string, row_id long, ref_id long, distance int" + ", value string" * (with_value or blocks > 1)
    outs = []
    for k in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == k).orderBy("i", "n").toPandas()
        sent, key = source.sparkSession.sparkContext.broadcast((part["i"].tolist(), part["n"].tolist())), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            resolver = _resolver(sent, key, max_distance, fillers)
            for b in batches:
                keep, ids, far = [], [], []
                for at, v in enumerate(b.column(2).to_pylist()):
                    if not v.strip():
                        continue
                    if v in resolver.exact:
                        if blocks == 1:
                            continue
                        d, i = NAME, 0  # a name: no block may map it
                    else:
                        d, i = resolver(v)
                    keep.append(at)
                    ids.append(i)
                    far.append(d)
                at = pa.array(keep, pa.int64())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(ids, pa.int64()), pa.array(far, pa.int32())]
                names_ = ["src", "row_id", "ref_id", "distance"]
                if with_value or blocks > 1:
                    cols.append(b.column(2).take(at))
                    names_.append("value")
                yield pa.RecordBatch.from_arrays(cols, names=names_)

        outs.append(source.mapInArrow(run, schema))
    if blocks == 1:
        return outs[0]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    best = out.groupBy("src", "row_id", "value").agg(F.min(F.struct("distance", "ref_id")).alias("b")).where(F.col("b.distance") != NAME)
    return best.select("src", "row_id", "b.ref_id", "b.distance", *["value"] * with_value)


#: Distance that marks a value as a name.
NAME = -1
_resolvers: dict[str, Resolver] = {}


def _resolver(sent: Broadcast, key: str, max_distance: int, fillers: Fillers) -> Resolver:
    """One resolver per worker and block, the last few kept over their tasks."""
    if key not in _resolvers:
        while len(_resolvers) >= 4:
            _resolvers.pop(next(iter(_resolvers)))
        _resolvers[key] = Resolver(*sent.value, max_distance, fillers=fillers)
    return _resolvers[key]
