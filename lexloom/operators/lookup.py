"""Batched lookups over a headword index: dict_id, id, text, normalized (+ locator columns).

Every operator takes a DataFrame of words and answers all of them in one plan. "First" is always the lowest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.normalize import ascii_fold, canonical_normalize, query_candidates
from lexloom.session import cut


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: a min over a struct, with map-side combine instead of a window's sort."""
    rest = [c for c in df.columns if c not in keys]
    named = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*named, *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def lookup_exact(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """word, dict_id, id: text equal to the word."""
    hit = words.select(word).distinct().join(index.select("dict_id", "id", "text"), F.col(word) == F.col("text"))
    return hit.groupBy(word, "dict_id").agg(F.min("id").alias("id"))


def lookup_nocase(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """As lookup_exact without the case of ASCII letters."""
    left = words.select(word).distinct().withColumn("_k", ascii_fold(word))
    right = index.select("dict_id", "id", ascii_fold("text").alias("_k"))
    return left.join(right, "_k").groupBy(word, "dict_id").agg(F.min("id").alias("id"))


def lookup_normalized(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """Normalized column equal to the word's normalisation; null never matches."""
    left = words.select(word).distinct().withColumn("_k", canonical_normalize(word))
    right = index.select("dict_id", "id", F.col("normalized").alias("_k"))
    return left.join(right, "_k").where("_k <> ''").groupBy(word, "dict_id").agg(F.min("id").alias("id"))


def _keyed(index: DataFrame) -> DataFrame:
    """Each row under its three keys: kind 0 text, 1 ASCII-folded text, 2 normalized."""
    keys = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("key")),
        F.struct(F.lit(1).alias("kind"), ascii_fold("text").alias("key")),
        F.struct(F.lit(2).alias("kind"), F.col("normalized").alias("key")),
    )
    return index.select("dict_id", "id", F.explode(keys).alias("k")).select("dict_id", "id", "k.kind", "k.key").where("key is not null")


def _asked(df: DataFrame, word: Column) -> Column:
    """The keys a spelling is looked up by; the normalized column is asked for the spelling as it is."""
    return F.array(
        F.struct(F.lit(0).alias("kind"), word.alias("key")),
        F.struct(F.lit(1).alias("kind"), ascii_fold(word).alias("key")),
        F.struct(F.lit(2).alias("kind"), word.alias("key")),
    )


def lookup_cascade(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """word, dict_id, kind, id: exact, else without case, else normalized, lowest id."""
    left = words.select(word).distinct()
    left = left.select(word, F.explode(_asked(left, F.col(word))).alias("k")).select(word, "k.kind", "k.key")
    hit = left.join(_keyed(index), ["kind", "key"])
    return _first(hit.select(word, "dict_id", "kind", "id"), [word, "dict_id"], [F.col("kind"), F.col("id")])


def entry_candidates(words: DataFrame, word: str = "word") -> DataFrame:
    """word, pos, candidate of each distinct word, in the order they are tried."""
    return words.select(word).distinct().select(word, F.posexplode(query_candidates(word)).alias("pos", "candidate"))


def entry_lookup(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """word, dict_id, step, pos, kind, id: the normalisation first (step 0), then every candidate spelling through the cascade."""
    first = words.select(word).distinct().withColumn("key", canonical_normalize(word)).where("key <> ''")
    first = first.select(word, F.lit(0).alias("step"), F.lit(0).alias("pos"), F.lit(2).alias("kind"), "key")
    cands = entry_candidates(words, word)
    later = cands.select(word, F.lit(1).alias("step"), "pos", F.explode(_asked(cands, F.col("candidate"))).alias("k"))
    asked = first.unionByName(later.select(word, "step", "pos", "k.kind", "k.key")).distinct()
    hit = asked.join(_keyed(index), ["kind", "key"]).select(word, "dict_id", "step", "pos", "kind", "id")
    return _first(hit, [word, "dict_id"], [F.col(c) for c in ("step", "pos", "kind", "id")])


def first_hit(entries: DataFrame, catalog: DataFrame, word: str = "word") -> DataFrame:
    """Of a word's entries the one in the first dictionary of the catalog (dict_id, ord)."""
    ranked = entries.join(F.broadcast(catalog.select("dict_id", "ord")), "dict_id")
    return _first(ranked, [word], [F.col("ord")])


def _hops(starts: DataFrame, links: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows that have ended, rows still on their way) of node, chain, at after at most ``limit`` hops; only the latter are joined."""
    link = links.select(F.col("child").alias("at"), F.col("parent").alias("_p"))
    here = starts.select("node").distinct().select("node", F.array("node").alias("chain"), F.col("node").alias("at")).where("at is not null")
    ended = None
    for _ in range(limit):
        after = cut(here.join(link, "at", "left"))
        stop = after.where("_p is null").select("node", "chain")
        ended = stop if ended is None else ended.unionByName(stop)
        here = after.where("_p is not null").select("node", F.concat("chain", F.array("_p")).alias("chain"), F.col("_p").alias("at"))
    return ended, here.select("node", "chain")


def follow_redirects(starts: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """starts(node) along links(child, parent): node, last, hops, status (``ok`` or ``too_many_redirects``).

    One join per hop up to the limit, over the rows still on their way.
    """
    ended, moving = _hops(starts, links, limit + 1)
    got = ended.unionByName(moving).select("node", F.element_at("chain", -1).alias("last"), (F.size("chain") - 1).alias("hops"))
    return got.withColumn("status", F.when(F.col("hops") > limit, "too_many_redirects").otherwise("ok"))


def trace(starts: DataFrame, links: DataFrame, limit: int = 10) -> DataFrame:
    """node, chain (ids passed), depth: at most ``limit`` hops, cycles stop there."""
    ended, moving = _hops(starts, links, limit)
    return ended.unionByName(moving).select("node", "chain", (F.size("chain") - 1).alias("depth"))


def random_headwords(index: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """n displayable headwords, the same for the same seed."""
    from lexloom.functions.text import is_displayable

    return index.where(is_displayable("text")).select("dict_id", "id", "text").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(n)


# Words a random pick falls back to.
COMMON_WORDS = "hello world book water light house music friend garden summer winter river mountain story dream heart voice".split()


def random_seek(index: DataFrame, seed: int, tries: int = 5) -> DataFrame:
    """text: a displayable headword by seeking from random ids of a random dictionary, the same for the same seed.

    Each try takes the first row at or after its id; if none is displayable, a common word. No table is sorted or scanned whole but for
    the dictionaries' greatest ids.
    """
    from random import Random

    from lexloom.functions.text import is_displayable

    rnd = Random(seed)
    spans = sorted((r["dict_id"], r["n"]) for r in index.where("dict_id is not null").groupBy("dict_id").agg(F.max("id").alias("n")).collect())
    if spans:
        name, most = rnd.choice(spans)
        for _ in range(tries):
            at = rnd.randint(1, max(most or 1, 1))
            row = index.where((F.col("dict_id") == name) & (F.col("id") >= at)).select("id", "text", is_displayable("text").alias("ok")).orderBy("id").limit(1).collect()
            if row and row[0]["ok"]:
                return index.sparkSession.createDataFrame([(row[0]["text"],)], "text string")
    return index.sparkSession.createDataFrame([(rnd.choice(COMMON_WORDS),)], "text string")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
