"""Prefix suggestions, full-text search over headwords, and did-you-mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.normalize import ascii_fold, canonical_normalize
from lexloom.functions.text import fts_tokens, is_fts_admitted, is_fuzzy_candidate, is_suggest_candidate, relevance, trigrams
from lexloom.operators.lookup import top_per


def _lengths(wanted: DataFrame, n: str) -> Column:
    """The distinct lengths in use, as a constant array: at most as many as a word is long."""
    found = sorted(r[0] for r in wanted.select(n).distinct().collect())
    return F.array(*[F.lit(x) for x in found]).cast("array<int>")


def prefix_matches(prefixes: DataFrame, index: DataFrame) -> DataFrame:
    """prefix, dict_id, id, text of rows whose normalized begins with the prefix, texts under 50 characters.

    An equi-join on the prefix's own length (the lengths in use are few and bounded by the prefixes), not a range join: rows are
    exploded to their beginnings of just those lengths.
    """
    wanted = prefixes.select("prefix", canonical_normalize("prefix").alias("lo")).where("lo <> ''").distinct()
    wanted = wanted.withColumn("n", F.char_length("lo"))
    rows = index.where("normalized is not null").where(F.char_length("text") < 50).select("dict_id", "id", "text", "normalized")
    rows = rows.select("dict_id", "id", "text", "normalized", F.explode(_lengths(wanted, "n")).alias("n")).where(F.char_length("normalized") >= F.col("n"))
    rows = rows.select("dict_id", "id", "text", F.substring(F.col("normalized"), F.lit(1), F.col("n")).alias("lo"))
    return rows.join(wanted.select("prefix", "lo"), "lo").select("prefix", "dict_id", "id", "text")


def suggest_prefix(prefixes: DataFrame, index: DataFrame, n: int = 10) -> DataFrame:
    """prefix, dict_id, rank, text: shortest texts first, then by text; repeated texts count once."""
    hits = prefix_matches(prefixes, index).select("prefix", "dict_id", "text").distinct()
    return top_per(hits, ["prefix", "dict_id"], [F.char_length("text"), F.col("text")], n).select("prefix", "dict_id", "rank", "text")


def _by_rank(prefixes: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """prefix, dict_id, word, score of the prefix ranks of every dictionary; the rank stands in for the text search's score."""
    hits = prefix_matches(prefixes.where(F.octet_length(F.trim("prefix")) >= 2), index)
    ranked = top_per(hits, ["prefix", "dict_id"], [F.char_length("text"), F.col("text"), F.col("id")], n * 20)
    # the rank counts rows that are no candidates
    ranked = ranked.withColumn("score", relevance("text", "prefix", (F.col("rank") - 1).cast("double"))).where(is_suggest_candidate("text"))
    return ranked.select("prefix", "dict_id", F.col("text").alias("word"), "score")


def _merged(scored: DataFrame, n: int) -> DataFrame:
    """prefix, word, score, place of scored(prefix, word, score): the best score of each word, in the total order."""
    merged = scored.groupBy("prefix", "word").agg(F.max("score").alias("score"))
    same = F.lower("word") == F.lower("prefix")
    canon = canonical_normalize("word") == canonical_normalize("prefix")
    order = [
        F.when(same, 0).otherwise(1), F.when(same, 0).when(canon, 0).otherwise(1), F.when(same, 0).otherwise(-F.col("score")),
        F.octet_length("word"), F.lower("word"), F.col("word"),
    ]
    return top_per(merged, ["prefix"], order, n, "place").select("prefix", "word", "score", "place")


def suggest_merged(prefixes: DataFrame, index: DataFrame, n: int = 10) -> DataFrame:
    """prefix, word, score, place: the prefix ranks of every dictionary scored, merged by the best, in the total order."""
    return _merged(_by_rank(prefixes, index, n), n)


def suggest(prefixes: DataFrame, index: DataFrame, n: int = 10, with_fts: DataFrame | None = None) -> DataFrame:
    """prefix, word, score, place: full-text search first, and prefix ranks in the dictionaries where it gives no candidate.

    Prefixes are trimmed; those under two bytes, or without a letter or digit, have no suggestions. ``with_fts`` (dict_id) are the
    dictionaries that have a text index, all if it is None.
    """
    asked = prefixes.select(F.trim("prefix").alias("prefix")).where(F.octet_length("prefix") >= 2).where(F.size(match_terms("prefix")) > 0).distinct()
    searched = index if with_fts is None else index.join(F.broadcast(with_fts.select("dict_id").distinct()), "dict_id", "left_semi")
    found = fts_match(asked, searched)
    top = top_per(found, ["prefix", "dict_id"], [F.col("score"), F.col("id")], n * 20).where(is_suggest_candidate("text"))
    kept = top.select("prefix", "dict_id", F.col("text").alias("word"), relevance("text", "prefix", F.col("score")).alias("score"))
    answered = kept.select("prefix", "dict_id").distinct()
    rest = _by_rank(asked, index, n).join(answered, ["prefix", "dict_id"], "left_anti")
    return _merged(kept.unionByName(rest), n)


def match_terms(text: Column | str) -> Column:
    """The terms of a typed text, each of which a headword must have a token beginning with; array<string>, empty for null.

    Words that are operators of the query language give no query at all, as they would be a syntax error.
    """
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", " "), " "), lambda w: w != "")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.arrays_overlap(words, F.array(*map(F.lit, ("AND", "OR", "NOT")))), none).otherwise(fts_tokens(t)), none)


def fts_postings(index: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """dict_id, id, token, tf, dl of the headwords the text index takes, and other columns of theirs."""
    docs = index.where(is_fts_admitted("text")).select("dict_id", "id", *keep, fts_tokens("text").alias("ts"))
    return docs.select("dict_id", "id", *keep, F.size("ts").alias("dl"), F.explode("ts").alias("token")).groupBy("dict_id", "id", *keep, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def fts_bm25(terms: DataFrame, index: DataFrame, k1: float = 1.2, b: float = 0.75, keep: tuple[str, ...] = ()) -> DataFrame:
    """term, dict_id, id, score: bm25 of one prefix term over the headwords; negative, lower is better."""
    posts = fts_postings(index, keep)
    stats = posts.select("dict_id", "id", "dl").distinct().groupBy("dict_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term", F.lower("term").alias("lo")).distinct().withColumn("len", F.char_length("lo"))
    starts = posts.select("*", F.explode(_lengths(wanted, "len")).alias("len")).where(F.char_length("token") >= F.col("len"))
    starts = starts.withColumn("lo", F.substring(F.col("token"), F.lit(1), F.col("len")))
    hits = starts.join(wanted.select("term", "lo"), "lo").groupBy("term", "dict_id", "id", *keep, "dl").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term", "dict_id").agg(F.count(F.lit(1)).alias("df"))
    got = hits.join(df, ["term", "dict_id"]).join(F.broadcast(stats), "dict_id")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = -idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return got.select("term", "dict_id", "id", *keep, score.alias("score"))


def fts_match(prefixes: DataFrame, index: DataFrame) -> DataFrame:
    """prefix, dict_id, id, text, score of the headwords that have a token for each of a prefix's terms; bm25 summed over the terms."""
    wanted = prefixes.select("prefix").distinct().select("prefix", match_terms("prefix").alias("ts"))
    wanted = wanted.select("prefix", F.size("ts").alias("terms"), F.explode("ts").alias("term"))
    scores = fts_bm25(wanted.select("term").distinct(), index, keep=("text",))
    hit = wanted.join(scores, "term").groupBy("prefix", "dict_id", "id", "text", "terms").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("k"))
    return hit.where("k = terms").select("prefix", "dict_id", "id", "text", "score")


def fts_trigram_match(terms: DataFrame, index: DataFrame) -> DataFrame:
    """term, dict_id, id of the headwords a term of three characters or more stands in, whatever its case.

    Candidates meet on the rarest of the term's trigrams.
    """
    asked = terms.select("term", F.explode(F.array_distinct(trigrams("term"))).alias("gram")).distinct()
    docs = index.where(is_fts_admitted("text")).select("dict_id", "id", "text", F.explode(F.array_distinct(trigrams("text"))).alias("gram"))
    df = docs.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("b")).select("term", F.col("b.gram").alias("gram"))
    return rarest.join(docs, "gram").where(F.lower("text").contains(F.lower("term"))).select("term", "dict_id", "id")


def _segment(length: Column, i: int, d: int) -> tuple[Column, Column]:
    """Start and length of the i-th of d + 1 even parts of a word; the last ones are longer."""
    k = d + 1
    base, extra = F.floor(length / k).cast("int"), F.pmod(length, F.lit(k)).cast("int")
    return base * i + F.greatest(F.lit(i - k) + extra, F.lit(0)), base + F.when(F.lit(i) >= F.lit(k) - extra, 1).otherwise(0)


def _part_at(i: int, n: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(i).alias("i"), F.substring(F.col("q"), x + 1, n).alias("part"))


def _candidates(asked: DataFrame, rows: DataFrame, d: int) -> DataFrame:
    """Pairs that can be within d edits: of d + 1 parts of a headword one stands in the word, moved by no more than d places.

    asked: query, q, first, n; rows: dict_id, id, text, normalized, first, len. They meet on (first letter, length, part).
    A part's place is bound from the left (at most one edit in each part before) and from the right (likewise).
    """
    parts = [F.struct(F.lit(i).alias("i"), F.substring(F.col("normalized"), s + 1, n).alias("part")) for i in range(d + 1) for s, n in [_segment(F.col("len"), i, d)]]
    rows = rows.select("*", F.explode(F.array(*parts)).alias("_p")).select("*", "_p.i", "_p.part").drop("_p")
    asked = asked.select("*", F.explode(F.sequence(F.greatest(F.col("n") - d, F.lit(1)), F.col("n") + d)).alias("len"))
    places = []
    for i in range(d + 1):
        s, n = _segment(F.col("len"), i, d)
        delta = F.col("n") - F.col("len")
        lo = F.greatest(s - i, s + delta - (d - i), F.lit(0))
        hi = F.least(s + i, s + delta + (d - i), F.col("n") - n)
        at = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        places.append(F.transform(at, _part_at(i, n)))
    asked = asked.select("*", F.explode(F.array_distinct(F.concat(*places))).alias("_p")).select("query", "q", "first", "len", "_p.i", "_p.part")
    return asked.join(rows, ["first", "len", "i", "part"]).drop("i", "part")


def fuzzy_suggest(words: DataFrame, index: DataFrame, max_distance: int = 2, limit: int = 30, cap: int | None = None) -> DataFrame:
    """query, dict_id, word, distance, place: headwords of the same first letter within max_distance edits of the normalisation.

    ``cap`` keeps the first so many headwords of the same first letter and a near length, a word and dictionary, in index order before
    they are compared, as a latency bound; None compares all that can be near (``_candidates``).
    """
    asked = words.select(F.col("word").alias("query"), canonical_normalize("word").alias("q")).where("q <> ''").distinct()
    asked = asked.select("query", "q", F.substring("q", 1, 1).alias("first"), F.char_length("q").alias("n"))
    rows = index.where("normalized <> ''").select("dict_id", "id", "text", "normalized", F.substring("normalized", 1, 1).alias("first"), F.char_length("normalized").alias("len"))
    if cap is not None:
        near = asked.select("query", "q", "first", F.explode(F.sequence(F.greatest(F.col("n") - max_distance, F.lit(1)), F.col("n") + max_distance)).alias("len"))
        pairs = top_per(near.join(rows, ["first", "len"]), ["query", "dict_id"], [F.col("normalized"), F.col("id")], cap).drop("rank").where(is_fuzzy_candidate("text"))
    else:
        pairs = _candidates(asked, rows.where(is_fuzzy_candidate("text")), max_distance)
    pairs = pairs.withColumn("distance", F.levenshtein("normalized", "q", max_distance)).where("distance >= 0")
    order = [F.col("distance"), F.octet_length("text"), F.lower("text"), F.col("text"), F.col("id")]
    # one row of the words that differ in the case of ASCII letters only, also of those that met on several parts
    first = F.min(F.struct("distance", F.octet_length("text").alias("bytes"), F.lower("text").alias("low"), "text", "id")).alias("b")
    kept = pairs.groupBy("query", "dict_id", ascii_fold("text").alias("_k")).agg(first).select("query", "dict_id", "b.distance", "b.text", "b.id")
    return top_per(kept, ["query", "dict_id"], order, limit, "place").select("query", "dict_id", F.col("text").alias("word"), "distance", "place")


def fuzzy_merged(words: DataFrame, index: DataFrame, max_distance: int = 2, limit: int = 10, cap: int | None = None) -> DataFrame:
    """query, word, distance, place over all dictionaries: the least distance of a word, nearest first."""
    per = fuzzy_suggest(words.where(F.char_length(F.trim("word")) >= 2), index, max_distance, limit * 3, cap)
    best = per.groupBy("query", "word").agg(F.min("distance").alias("distance"))
    return top_per(best, ["query"], [F.col("distance"), F.octet_length("word"), F.lower("word"), F.col("word")], limit, "place").select("query", "word", "distance", "place")


def suggest_else_fuzzy(words: DataFrame, index: DataFrame, n: int = 10) -> DataFrame:
    """query, word, kind: suggestions by prefix, and did-you-mean where there is none."""
    by_prefix = suggest_merged(words.select(F.col("word").alias("prefix")), index, n).select(F.col("prefix").alias("query"), "word", F.lit("suggest").alias("kind"))
    missed = words.join(by_prefix.select(F.col("query").alias("word")).distinct(), "word", "left_anti")
    return by_prefix.unionByName(fuzzy_merged(missed, index, limit=n).select("query", "word", F.lit("fuzzy").alias("kind")))
