"""Text garbled by a wrong character encoding: find it, and restore what was written.

Latent variable of a record: the encoding chain it went through (none, or written in one encoding and read in another, once or
twice), plus ``lossy`` for records with replacement characters that no chain brings back. A record is a text of one source
(dictionary) and field; its evidence is its words with a non-ASCII character.

* Emission: a character-bigram model per language scores each word as it stands and as each chain would have it written. A
  record may be damaged as a whole or in one place: each word is a half-half mixture of damaged and intact.
* Prior: the share of each chain per (source, field), estimated by expectation-maximization over all records of it, so that many
  words that are odd only slightly (an ``ê`` for an ``ę``) decide together.
* The language models are estimated from words in the script of their language, every source and field weighing the same; with
  ``refine`` once more, without the records whose posterior says damaged.

Counts cover all records. What goes to the driver is bounded by alphabets, sources and chains: bigram counts of letters (all Han
characters are one symbol) per language, and one row of chain shares per source and field.

Null and ASCII texts are intact. Repeated rows get the same verdict. Very long texts are scored word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: Chains of (written, read) steps; the last step is undone first.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "cp1252"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "cp1253"),),
    (("utf-8", "gbk"),),
    (("utf-8", "shift_jis"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("cp1251", "cp1252"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
    (("cp1250", "cp1252"),),
    (("iso8859-2", "cp1252"),),
    (("cp1253", "cp1252"),),
    (("iso8859-7", "cp1252"),),
    (("gbk", "cp1252"),),
    (("shift_jis", "cp1252"),),
    (("euc_jp", "cp1252"),),
    (("utf-16-le", "utf-16-be"),),
)
NAMES = tuple(" then ".join(f"{w} read as {r}" for w, r in c) for c in CHAINS) + ("lossy",)
K = len(NAMES)
#: Chance of damage in a source before anything is known of it, rounds of EM, least share of a chain.
DAMAGED, ROUNDS, LEAST = 0.03, 6, 3e-4
SURE = 25.0

_split = re.compile(r'[ \t\r\n<>"|{}=]+')
#: Signs that open a sentence; as letters of Central Europe they would not stand before a capital.
_opening = re.compile(r"^[¿¡„“«»]+(?=[A-ZÀ-Þ])")
_utf8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_han = re.compile(r"[㐀-鿿豈-﫿]")
_control = re.compile(r"[\x80-\x9f]")


def _encoder(name: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined are the control characters of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":  # also read as Latin-1
        out |= {chr(b): b for b in range(128, 160)}
    return out


SINGLE = {name: _encoder(name) for name in ("cp1252", "cp1251", "cp1250", "mac_roman", "koi8-r", "cp1253")}


def _utf8_signs(table: dict[str, int]) -> re.Pattern:
    """A lead byte followed by a continuation byte, as the characters they were read as."""
    pick = lambda lo, hi: "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi)
    return re.compile(f"[{pick(0xC2, 0xF4)}][{pick(0x80, 0xBF)}]")


SIGNS = {name: _utf8_signs(table) for name, table in SINGLE.items()}
_ascii_letter = re.compile("[A-Za-z]")
#: Written encodings whose letters are no Latin ones: a word with an ASCII letter was not written in them.
NOT_LATIN = frozenset(("cp1251", "koi8-r", "cp1253", "iso8859-7", "euc_jp", "gbk"))


def undo_step(word: str, written: str, read: str) -> str | None:
    """The word as written, had it been written and read so; None where that is impossible or changes nothing."""
    table = SINGLE.get(read)
    if table is not None and written == "utf-8":
        if not SIGNS[read].search(word):
            return None
        # letters outside the code page stay; the rest may still be damaged
        data = bytes([table.get(c, 0x20) for c in word])
        parts, last = [], 0
        for m in _utf8.finditer(data):
            parts += [word[last : m.start()], m.group().decode()]
            last = m.end()
        return "".join([*parts, word[last:]]) if parts else None
    if written in NOT_LATIN and (len(word) < 2 or _ascii_letter.search(word)):
        return None
    if read == "utf-16-be" and min(word) < "\u0100":
        return None  # swapped letters of one byte lie above
    try:
        data = bytes([table[c] for c in word]) if table is not None else word.encode(read)
        out = data.decode(written)
    except (KeyError, UnicodeError):
        return None
    return out if out != word and "\x00" not in out else None


def undo(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in reversed(chain):
        got = undo_step(word, written, read)
        if got is None:
            return None
        word = got
    return word


def candidates(word: str) -> list[tuple[int, str]]:
    """(chain, word as written) of every chain the word can have gone through."""
    out = []
    western = all(c in SINGLE["cp1252"] for c in word)
    # phonetic script has letters of its own
    spoken = word[0] == "/" or word[-1] == "/" or (word[0] == "[" and word[:2] != "[[") or (word[-1] == "]" and word[-2:] != "]]")
    for z, chain in enumerate(CHAINS):
        written, read = chain[-1]
        if written != "utf-8" and (spoken or (read == "cp1252" and not western)):
            continue
        skip = m.end() if written in ("cp1250", "iso8859-2") and (m := _opening.match(word)) else 0
        got = undo(word[skip:], chain)
        if got is not None and (written != "utf-16-le" or len(_ascii_letter.findall(got)) * 2 > len(got)):
            out.append((z, word[:skip] + got))
    return out


def words_of(text: str) -> list[str]:
    """Words with a character outside ASCII, white space that damage can make left inside."""
    return [w for w in _split.split(text) if not w.isascii()]


def symbols(word: str) -> str:
    return _han.sub("漢", word.lower())


def han_cost(c: str) -> float:
    """The model knows one Han symbol; which character it is costs as much as the size of its list (common, rare, neither)."""
    try:
        lead = c.encode("gb2312")[0]
    except UnicodeEncodeError:
        return -12.0
    return -8.0 if lead < 0xD8 else -10.5


class Language:
    """Character-bigram model of one language, with a few case patterns."""

    def __init__(self, counts: dict[tuple[str, str], float]) -> None:
        uni: dict[str, float] = defaultdict(float)
        left: dict[str, float] = defaultdict(float)
        for (a, b), n in counts.items():
            uni[b] += n
            left[a] += n
        total = sum(uni.values()) + 1.0
        self.floor = math.log(0.02 / total / 40)
        self.uni = {b: math.log((n + 0.02) / total) for b, n in uni.items()}
        self.bi = {a + b: math.log(0.9 * n / left[a] + 0.1 * math.exp(self.uni[b])) for (a, b), n in counts.items() if n > 0}
        self.back = math.log(0.1)
        self.known: dict[str, float] = {}

    def __call__(self, word: str) -> float:
        got = self.known.get(word)
        if got is not None:
            return got
        if len(self.known) > 1 << 18:
            self.known.clear()
        a, total = "^", 0.0
        for b in symbols(word):
            p = self.bi.get(a + b)
            total += p if p is not None else self.back + self.uni.get(b, self.floor)
            a = b
        total += sum(map(han_cost, _han.findall(word)))
        total += -0.2 if word.islower() or not any(c.isalpha() and c.lower() != c.upper() for c in word) else -2.0 if word[1:].islower() or len(word) < 2 else -3.5 if word.isupper() else -7.0
        self.known[word] = total
        return total


def evidence(text: str, lm: Language) -> list[float] | None:
    """Log likelihood ratio of each chain to no damage; None for a text without a word to judge."""
    words = words_of(text)
    if not words:
        return None
    out = [-30.0] * K
    for w in dict.fromkeys(words):
        if "�" in w:
            out[K - 1] = SURE
            continue
        fits, options = False, candidates(w)
        base = lm(w) if options else 0.0
        for z, got in options:
            # half damaged, half intact
            d = lm(got) - base
            fits |= d > 3
            r = d - 0.7 if d > 30 else math.log(0.5 + 0.5 * math.exp(d))
            out[z] = (0.0 if out[z] == -30.0 else out[z]) + r
        if not fits and _control.search(w):
            out[K - 1] = SURE  # control characters in a word: bytes read wrongly, by no known chain
    return out


def repair(text: str, z: int, lm: Language) -> str:
    """The text with every word put right that the chain explains better; if it is none, the one that comes nearest, as one is damaged."""
    if z >= len(CHAINS):
        return text
    words = [(lm(got) - lm(w), w, got) for w in sorted(set(words_of(text)), key=lambda w: (-len(w), w)) if (got := dict(candidates(w)).get(z)) is not None]
    for _, w, got in [x for x in words if x[0] > 0] or sorted(words)[-1:]:
        text = text.replace(w, got)
    return text


# ---------------------------------------------------------------- language models

_PLAIN = r"\p{M}\p{N}\p{Zs}\p{Cf}\x20-\x40"
_SCRIPT = {
    code: regex.compile(rf"[{script}{_PLAIN}]*")
    for code, script in (("ru", r"\p{Cyrillic}"), ("el", r"\p{Greek}"), ("zh", r"\p{Han}"), ("ja", r"\p{Han}\p{Hiragana}\p{Katakana}ー"))
}
_LATIN = regex.compile(rf"(?V1)[[\p{{Latin}}{_PLAIN}]--[²³¹¼½¾]]*")
_inner_capital = re.compile(r"[a-zß-ÿ][À-Þ]")
#: Phonetic script, whatever the language.
_SPOKEN = regex.compile(rf"[/\[][\p{{Latin}}\p{{Lm}}θβχ{_PLAIN}]*[/\]]")


def trusted(word: str, lang: str) -> bool:
    """No trust, at first, in words out of the script of their language, with signs inside, or like misread UTF-8."""
    if word.isascii():
        return lang not in _SCRIPT or not _ascii_letter.search(word)
    if SIGNS["cp1252"].search(word) or SIGNS["mac_roman"].search(word):
        return False
    if _SPOKEN.fullmatch(word):
        return True
    script = _SCRIPT.get(lang)
    if script is not None:
        return script.fullmatch(word) is not None
    return _LATIN.fullmatch(word) is not None and not _inner_capital.search(word)


def _groups(a: pa.Array, b: pa.Array) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Distinct pairs of two columns (null as empty) and each row's place among them, without touching the strings row by row."""
    x, y = a.fill_null("").dictionary_encode(), b.fill_null("").dictionary_encode()
    n = max(len(y.dictionary), 1)
    both = x.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + y.indices.to_numpy(zero_copy_only=False)
    found, at = np.unique(both, return_inverse=True)
    return [(x.dictionary[k // n].as_py(), y.dictionary[k % n].as_py()) for k in found.tolist()], at


def bigram_counts(texts: DataFrame, trust: bool = False) -> list:
    """(lang, a, b, share) of all words of texts(src, source, lang, text): every source and field weighs the same within its language.

    Words count by their first trust, or all of them with ``trust``.
    """
    t = texts.select(F.concat_ws("\n", "src", "source").alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, place = _groups(b.column(0), b.column(1))
            per = [Counter() for _ in keys]
            for g, text in zip(place.tolist(), b.column(2).to_pylist()):
                per[g].update(_split.split(text))
            group = np.repeat(np.arange(len(keys)), [len(c) for c in per])
            words = [w for c in per for w in c]
            many = np.fromiter((n for c in per for n in c.values()), np.float64, len(words))
            sure = many if trust else many * np.fromiter((trusted(w, keys[g][1]) for w, g in zip(words, group.tolist())), bool, len(words))
            lines = [w.lower() for w in words]
            code = np.frombuffer("".join(["^" + x for x in lines]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            code[((code >= 0x3400) & (code <= 0x9FFF)) | ((code >= 0xF900) & (code <= 0xFAFF))] = ord("漢")
            size = np.fromiter((len(x) for x in lines), np.int64, len(lines))
            row = np.repeat(np.arange(len(lines)), size + 1)
            inside = np.flatnonzero(row[1:] == row[:-1])
            pair = (group[row[inside]].astype(np.int64) << 42) | (code[inside] << 21) | code[inside + 1]
            found, at = np.unique(pair, return_inverse=True)
            n = np.bincount(at, sure[row[inside]], len(found))
            names = [keys[g] for g in (found >> 42).tolist()]
            cols = [
                pa.array([x for x, _ in names]), pa.array([y for _, y in names]),
                pa.array([chr(c) for c in ((found >> 21) & 0x1FFFFF).tolist()]), pa.array([chr(c) for c in (found & 0x1FFFFF).tolist()]),
                pa.array(n), pa.array(np.bincount(at, many[row[inside]], len(found)).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["source", "lang", "a", "b", "n", "all"])

    pairs = t.mapInArrow(run, "source string, lang string, a string, b string, n double, all long")
    # used twice below: written once
    counts = cut(pairs.groupBy("source", "lang", "a", "b").agg(F.sum("n").alias("n"), F.sum("all").alias("all")))
    # an average of the sources' shares, in thousands, is as much as the model needs of their sizes
    total = counts.groupBy("source").agg(F.sum("all").alias("total"))
    share = counts.join(F.broadcast(total), "source").select("lang", "a", "b", (F.col("n") / F.col("total")).alias("s"))
    return share.groupBy("lang", "a", "b").agg(F.sum("s").alias("s")).where("s > 0").collect()


def models(rows: list) -> dict[str, dict[tuple[str, str], float]]:
    """Counts by language, and under "" for unknown ones; each language on the scale of 50,000 characters."""
    by: dict[str, dict[tuple[str, str], float]] = defaultdict(dict)
    for r in rows:
        by[r["lang"] or ""][r["a"], r["b"]] = by[r["lang"] or ""].get((r["a"], r["b"]), 0.0) + r["s"]
    for lang, counts in by.items():
        total = sum(counts.values()) or 1.0
        by[lang] = {k: v * 50_000 / total for k, v in counts.items()}
    everything: dict[tuple[str, str], float] = defaultdict(float)
    for counts in list(by.values()):
        for k, v in counts.items():
            everything[k] += v / len(by)
    for lang in by:  # words of other languages occur everywhere
        for k, v in everything.items():
            by[lang][k] = by[lang].get(k, 0.0) + 0.002 * v
    by[""] = dict(everything)
    return dict(by)


# ---------------------------------------------------------------- EM


def score(records: DataFrame, counts: dict) -> DataFrame:
    """llr ARRAY<FLOAT> of records(src, row_id, source, lang, text) that have a word to judge."""
    sent = records.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lms = {lang: Language(c) for lang, c in sent.value.items()}
        for b in batches:
            src, row, source, lang, text = (b.column(i).to_pylist() for i in range(5))
            got = [evidence(t, lms.get(x or "") or lms[""]) for t, x in zip(text, lang)]
            keep = [i for i, g in enumerate(got) if g is not None]
            flat = pa.array(np.array([got[i] for i in keep], np.float32).ravel() if keep else np.zeros(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * K + 1, K, dtype=np.int32)), flat)
            cols = [pa.array([c[i] for i in keep], t) for c, t in ((src, pa.string()), (row, pa.int64()), (source, pa.string()), (lang, pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, lists], names=["src", "row_id", "source", "lang", "llr"])

    source = records.select("src", F.col("row_id").cast("long"), "source", "lang", "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return source.mapInArrow(run, "src string, row_id long, source string, lang string, llr array<float>")


def _weigh(b: pa.RecordBatch, shares: dict[tuple[str, str], list[float]]) -> np.ndarray:
    """Posterior of each chain (columns) for the records of a batch."""
    llr = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, K).astype(np.float64)
    start = [DAMAGED / K] * K
    keys, at = _groups(b.column(0), b.column(2))
    share = np.array([shares.get(k, start) for k in keys]).reshape(-1, K)[at]
    top = np.maximum(llr.max(1, initial=0.0), 0.0)[:, None]
    odds = share * np.exp(llr - top)
    clean = (1.0 - share.sum(1, keepdims=True)) * np.exp(-top)
    return odds / (odds.sum(1, keepdims=True) + clean)


def chain_shares(scored: DataFrame, rounds: int = ROUNDS) -> dict[tuple[str, str], list[float]]:
    """Share of each chain by (src, source), by EM over all scored records; prior: DAMAGED over all chains, worth four records."""
    start = DAMAGED / K
    shares: dict[tuple[str, str], list[float]] = {}
    names = [f"z{z}" for z in range(K)]
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], shares=shares) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                post = _weigh(b, shares)
                keys, at = _groups(b.column(0), b.column(2))
                sums = np.stack([np.bincount(at, post[:, z], len(keys)) for z in range(K)])
                cols = [pa.array([k[i] for k in keys]) for i in (0, 1)]
                cols += [pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)), *[pa.array(x) for x in sums]]
                yield pa.RecordBatch.from_arrays(cols, names=["src", "source", "n", *names])

        schema = "src string, source string, n long, " + ", ".join(f"{n} double" for n in names)
        got = scored.mapInArrow(expect, schema).groupBy("src", "source").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
        rows = got.collect()  # one row per source and field
        shares = {(r["src"], r["source"]): [max((r[n] + 4 * start) / (r["n"] + 4), LEAST) for n in names] for r in rows}
    return shares


def verdicts(scored: DataFrame, shares: dict[tuple[str, str], list[float]]) -> DataFrame:
    """src, row_id, p, z, chain of the records that are more likely damaged than not, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            post = _weigh(b, shares)
            p = post.sum(1)
            at = np.flatnonzero(p > 0.5)
            z = post[at].argmax(1) if len(at) else np.zeros(0, np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(p[at]), pa.array(z.astype(np.int32)), pa.array([NAMES[k] for k in z.tolist()], pa.string())],
                names=["src", "row_id", "p", "z", "chain"],
            )

    found = scored.mapInArrow(run, "src string, row_id long, p double, z int, chain string")
    return found.dropDuplicates(["src", "row_id"])


def find_damaged(records: DataFrame, train: DataFrame | None = None, refine: bool = False) -> tuple[DataFrame, dict]:
    """Verdicts on records(src, row_id, source, lang, text), and the language counts.

    src names table and field; train: the records the language models learn from (default: all). With ``refine`` the models are
    estimated once more without the records found damaged.
    """
    train = records if train is None else train
    t = train.select("src", "row_id", "source", "lang", "text").where("text is not null")
    counts = models(bigram_counts(t))
    if refine:
        first = cut(score(t, counts))
        bad = verdicts(first, chain_shares(first)).select("src", "row_id")
        counts = models(bigram_counts(t.join(bad, ["src", "row_id"], "left_anti"), trust=True))
    scored = cut(score(records, counts))
    return verdicts(scored, chain_shares(scored)), counts


def repaired(bad: DataFrame, counts: dict) -> DataFrame:
    """bad(src, row_id, source, lang, text, p, z, chain) with the restored text."""
    sent = bad.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lms = {lang: Language(c) for lang, c in sent.value.items()}
        for b in batches:
            d = b.to_pydict()
            text = [repair(t, z, lms.get(x or "") or lms[""]) for t, z, x in zip(d["text"], d["z"], d["lang"])]
            cols = [b.column("src"), b.column("row_id"), b.column("chain"), b.column("p"), b.column("text"), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["src", "row_id", "chain", "p", "text", "restored"])

    source = bad.select("src", "row_id", "lang", "text", "p", "z", "chain")
    return source.mapInArrow(run, "src string, row_id long, chain string, p double, text string, restored string")
