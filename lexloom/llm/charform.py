"""One consistent form for text that looks the same but differs in its characters.

The consistent form: precomposed letters of ordinary width, all of the script most letters of the text are in, ordinary spaces and
hyphens, nothing invisible, no unusual space at either end. Plain spaces, tabs and line breaks stay as they are. Null stays
null, empty stays empty.

``consistent_forms`` explodes each distinct text that can differ from its form to positioned code points, joins them with the
(fixed-size, broadcast) decomposition, class and look-alike tables, orders combining marks by their class, recomposes starters with
the marks that follow by the table of composed letters (Hangul by its rule), and rebuilds the string. Texts without a character of
``SUSPECT`` and in one script are their own form and take no part in that. All tables come from the Unicode data of the Python
runtime but the look-alikes, which are listed. ``fold`` is the same form for use inside Arrow functions, always in Latin script.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import shuffle_width

# Letters of three scripts that look alike, None where a script has no such letter.
LOOK_ALIKES = [
    # Latin, Cyrillic, Greek
    ("a", "а", "α"), ("c", "с", "ϲ"), ("e", "е", None), ("i", "і", "ι"), ("j", "ј", "ϳ"), ("o", "о", "ο"), ("p", "р", "ρ"),
    ("s", "ѕ", None), ("x", "х", "χ"), ("y", "у", "γ"), ("h", "һ", None), ("v", "ѵ", "ν"), ("u", None, "υ"), ("k", "к", "κ"),
    ("d", "ԁ", None), ("q", "ԛ", None), ("w", "ԝ", "ω"), ("l", "ӏ", None), ("ë", "ё", None), ("ï", "ї", "ϊ"),
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", "Ϳ"),
    ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", None, "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", None), ("T", "Т", "Τ"),
    ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", None, "Ζ"),
]
SCRIPTS = ("L", "C", "G")
HYPHENS = "‐‑‒–−﹘﹣－"
# white space that is not plain: everything of category Zs but the space
SPACES = "".join(chr(c) for c in range(0x10000) if U.category(chr(c)) == "Zs" and c != 32)
INVISIBLE = r"\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"


def _invisible(c: str) -> bool:
    return U.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0x180B <= ord(c) <= 0x180E or 0xFE00 <= ord(c) <= 0xFE0F


def _mapped(c: str) -> str:
    """A character's canonical decomposition, after its width has been made ordinary."""
    if U.category(c) == "Zs":
        return c
    kind = U.decomposition(c)
    if kind.startswith(("<wide>", "<narrow>")):
        c = "".join(chr(int(x, 16)) for x in kind.split()[1:])
    return U.normalize("NFD", c)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple[str, str]], str]:
    """(character, decomposition) of all that have one but Hangul syllables; a regex class of those that are not their own form."""
    pairs, odd = [], []
    for n in range(0x80, 0x30000):
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3:
            continue
        c = chr(n)
        d = _mapped(c)
        if d != c:
            pairs.append((c, d))
            if U.normalize("NFC", d) != c:
                odd.append(n)
    ranges, start = [], None
    for n, after in zip(odd, [*odd[1:], None]):
        start = n if start is None else start
        if after != n + 1:
            ranges.append(rf"\x{{{start:X}}}-\x{{{n:X}}}" if start != n else rf"\x{{{n:X}}}")
            start = None
    return pairs, "".join(ranges)


def _suspect() -> str:
    hyphens = "".join(rf"\x{{{ord(c):X}}}" for c in HYPHENS)
    spaces = "".join(rf"\x{{{ord(c):X}}}" for c in SPACES)
    return rf"[\p{{M}}{INVISIBLE}{spaces}{hyphens}\x{{1100}}-\x{{11FF}}{_tables()[1]}]"


LATIN, CYRILLIC, GREEK = r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}"


def is_suspect(text: Column) -> Column:
    """Whether a text can differ from its consistent form."""
    has = lambda p: text.rlike(p)
    mixed = (has(LATIN) & has(f"[{CYRILLIC}{GREEK}]")) | (has(CYRILLIC) & has(GREEK))
    # plain Latin and digits are settled by the first test
    return ~text.rlike(r"^[\x00-\x7F]*$") & (has(_suspect()) | mixed)


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """Two characters and the one they compose to; Hangul goes by rule."""
    out = {}
    for n in range(0x80, 0x30000):
        kind = U.decomposition(chr(n)) if not 0xAC00 <= n <= 0xD7A3 and not 0xD800 <= n <= 0xDFFF else ""
        parts = kind.split()
        if len(parts) == 2 and kind[0] != "<" and U.normalize("NFC", chr(n)) == chr(n):
            out["".join(chr(int(x, 16)) for x in parts)] = chr(n)
    return out


def _char(code: Column) -> Column:
    """A code point as text: its UTF-32 bytes, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _pair(first: Column, second: Column) -> Column:
    """What two characters compose to, null if nothing."""
    table = _composed()
    known = F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))
    a, b = F.ascii(first), F.ascii(second)
    syllable = F.when(a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175), _char(0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28)).when(
        a.between(0xAC00, 0xD7A3) & (F.pmod(a - 0xAC00, F.lit(28)) == 0) & b.between(0x11A8, 0x11C2), _char(a + b - 0x11A7)
    )
    return F.when(b.between(0x1161, 0x11C2), syllable).when(second.rlike(r"^\p{M}$"), F.try_element_at(known, F.concat(first, second)))


def _recomposed(points: Column) -> Column:
    """The string of points(e, ccc) in canonical order: each starter takes in what follows and is not kept from it by a mark between."""
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        whole = F.when((acc["starter"] != "") & (acc["last"] < x["ccc"]), _pair(acc["starter"], x["e"]))
        taken = F.struct(acc["done"].alias("done"), whole.alias("starter"), acc["marks"].alias("marks"), acc["last"].alias("last"))
        next_ = F.struct(F.concat(acc["done"], acc["starter"], acc["marks"]).alias("done"), x["e"].alias("starter"), F.lit("").alias("marks"), F.lit(-1).alias("last"))
        mark = F.struct(acc["done"].alias("done"), acc["starter"].alias("starter"), F.concat(acc["marks"], x["e"]).alias("marks"), x["ccc"].alias("last"))
        return F.when(whole.isNotNull(), taken).when(x["ccc"] == 0, next_).otherwise(mark)

    return F.aggregate(points, zero, step, lambda acc: F.concat(acc["done"], acc["starter"], acc["marks"]))


def _mapping(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decompositions, classes of marks, look-alikes)"""
    spark = df.sparkSession
    chars = pd.DataFrame(_tables()[0], columns=["c", "d"])
    marks = pd.DataFrame([(chr(n), U.combining(chr(n))) for n in range(0x300, 0x20000) if not 0xD800 <= n <= 0xDFFF and U.combining(chr(n))], columns=["e", "class"])
    twins = pd.DataFrame([(frm, SCRIPTS[i], to) for row in LOOK_ALIKES for i, to in enumerate(row) if to for j, frm in enumerate(row) if frm and j != i], columns=["e", "main", "twin"])
    # a letter may stand twice (capitals without a partner): the first pairing holds
    twins = twins.drop_duplicates(["e", "main"])
    return spark.createDataFrame(chars), spark.createDataFrame(marks, "e string, class int"), spark.createDataFrame(twins)


def consistent_forms(texts: DataFrame) -> DataFrame:
    """text, form: for every distinct non-null ``text`` that is not its own consistent form already by its characters."""
    odd = texts.select("text").where(is_suspect(F.col("text"))).distinct()
    chars, marks, twins = _mapping(odd)
    # one exchange: everything below stays within the text's partition
    # (a fixed number of partitions: a few bytes of text become many rows, which their size in the exchange does not tell)
    odd = odd.repartition(shuffle_width(odd.sparkSession), "text")
    points = odd.select("text", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), 0)).alias("pos", "c"))
    points = points.where(~F.col("c").rlike(f"^[{INVISIBLE}]$"))
    points = points.join(F.broadcast(chars), "c", "left").withColumn("d", F.coalesce("d", "c"))
    points = points.select("text", "pos", F.posexplode(F.regexp_extract_all("d", F.lit("(?s)."), 0)).alias("sub", "e"))
    script = F.when(F.col("e").rlike(LATIN), "L").when(F.col("e").rlike(CYRILLIC), "C").when(F.col("e").rlike(GREEK), "G").when(F.col("e").rlike(r"\p{L}"), "O")
    points = points.withColumn("script", script)
    word = Window.partitionBy("text")
    n = lambda s: F.sum(F.when(F.col("script") == s, 1).otherwise(0)).over(word)
    points = points.withColumn("nL", n("L")).withColumn("nC", n("C")).withColumn("nG", n("G")).withColumn("nO", n("O"))
    top = F.greatest("nL", "nC", "nG", "nO")
    main = F.when(F.col("nL") == top, "L").when(F.col("nC") == top, "C").when(F.col("nG") == top, "G").otherwise("O")
    points = points.withColumn("main", main).join(F.broadcast(twins), ["e", "main"], "left")
    points = points.withColumn("e", F.when((F.col("script") != F.col("main")) & F.col("twin").isNotNull(), F.col("twin")).otherwise(F.col("e")))
    # combining marks after their base, by class; a base opens a new sequence
    points = points.join(F.broadcast(marks), "e", "left").withColumn("ccc", F.coalesce("class", F.lit(0)))
    order = word.orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("seq", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order))
    unusual = F.col("e").isin(list(SPACES))
    plain = F.when(unusual, " ").when(F.col("e").isin(list(HYPHENS)), "-").otherwise(F.col("e"))
    points = points.select("text", "seq", "ccc", "pos", "sub", plain.alias("e"), unusual.alias("unusual"))
    built = points.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("seq", "ccc", "pos", "sub", "e", "unusual"))).alias("all"))
    # unusual space at an end goes, also behind plain space there; inside it is a plain space
    content = F.transform("all", lambda x: ~x["e"].isin(" ", "\t", "\r", "\n"))
    built = built.withColumn("first", F.array_position(content, True) - 1).withColumn("last", F.size("all") - F.array_position(F.reverse(content), True))
    at_end = lambda i: (i < F.col("first")) | (i > F.col("last"))
    kept = F.filter("all", lambda x, i: ~(x["unusual"] & at_end(i)))
    got = built.select("text", _recomposed(kept).alias("form"))
    # a text of invisible characters only has no code points left
    return odd.join(got, "text", "left").select("text", F.coalesce("form", F.lit("")).alias("form"))


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    # marks go last: a decomposition may hold some
    bare = lambda d: "".join(c for c in d if not U.combining(c))
    table = {ord(c): bare(d) for c, d in _tables()[0]}
    for row in LOOK_ALIKES:
        for other in row[1:]:
            if other and row[0]:
                table[ord(other)] = bare(U.normalize("NFD", row[0]))
    table |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
    table |= {n: "" for n in range(0x20000) if (_invisible(chr(n)) or U.combining(chr(n))) and not 0xD800 <= n <= 0xDFFF}
    return table


_other = re.compile(r"[^\x00-\x7f]+")
_folded: dict[str, str] = {}


def _fold_run(m: re.Match) -> str:
    run = m[0]
    got = _folded.get(run)
    if got is None:
        got = run.translate(_fold_table())
        if len(run) < 32:  # each character folds on its own, hence short runs, which come again, are remembered
            if len(_folded) >= 1 << 17:
                _folded.clear()
            _folded[run] = got
    return got


def fold(text: str) -> str:
    """Latin look-alike form without marks, for comparing inside Arrow functions: ordinary width, nothing invisible, no accents."""
    return text if text.isascii() else _other.sub(_fold_run, text)
