"""Queries from a typed word to what is shown: look-up, redirects, bodies, pages. Batches of words in one plan, missing ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.html import rewrite_html
from lexloom.functions.links import redirect_target
from lexloom.functions.text import MAX_RESOURCE, content_type, is_resource_key, resource_candidates
from lexloom.operators.lookup import entry_lookup
from lexloom.operators.render import render_aggregate
from lexloom.session import cut

#: Most redirects that are followed.
MAX_HOPS = 5


def text_of(body: str) -> F.Column:
    """A BINARY or STRING body as text: what is no valid UTF-8 comes out as replacement characters."""
    return F.make_valid_utf8(F.col(body).cast("string"))


def _bodies(hit: DataFrame, bodies: DataFrame) -> DataFrame:
    one = bodies.select(F.col("dict_id"), F.col("id"), text_of("body").alias("body")).dropDuplicates(["dict_id", "id"])
    return hit.join(one, ["dict_id", "id"]).where("body is not null")


def _walk(asked: DataFrame, step, keys: list[str]) -> DataFrame:
    """keys, matched, hops, dict_id, id, body, status after following redirects; only words still on their way are looked up again."""
    ended, here = None, cut(asked.withColumn("hops", F.lit(0)))
    for hop in range(MAX_HOPS + 1):
        got = cut(step(here).withColumn("to", redirect_target("body")))
        done = got.where("to is null").drop("to").withColumn("status", F.lit("ok"))
        ended = done if ended is None else ended.unionByName(done)
        moved = got.where("to is not null")
        if hop == MAX_HOPS:
            return ended.unionByName(moved.drop("to").withColumn("status", F.lit("too_many_redirects")))
        here = moved.select(*keys, F.col("to").alias("matched"), (F.col("hops") + 1).alias("hops"))
    return ended


def entry_query(words: DataFrame, index: DataFrame, bodies: DataFrame) -> DataFrame:
    """word, dict_id, matched, hops, id, body, status: each word's entry in every dictionary, redirects followed within it.

    bodies: dict_id, id, body. matched is the word that was found in the end. Words without a body have no row.
    """

    def step(here: DataFrame) -> DataFrame:
        hit = entry_lookup(here.select(F.col("matched").alias("at")), index, "at").select("at", F.col("dict_id").alias("_d"), "id")
        within = (F.col("matched") == F.col("at")) & (F.col("dict_id").isNull() | (F.col("dict_id") == F.col("_d")))
        hit = here.join(hit, within).select("word", "matched", "hops", F.col("_d").alias("dict_id"), "id")
        return _bodies(hit, bodies)

    first = words.where("word is not null").select("word", F.col("word").alias("matched"), F.lit(None).cast("string").alias("dict_id")).distinct()
    return _walk(first, step, ["word", "dict_id"])


def first_query(words: DataFrame, index: DataFrame, bodies: DataFrame, catalog: DataFrame) -> DataFrame:
    """word, matched, hops, dict_id, id, body, status: the first dictionary's entry; a redirect starts again over all dictionaries.

    catalog: dict_id, ord.
    """

    def step(here: DataFrame) -> DataFrame:
        hit = entry_lookup(here.select(F.col("matched").alias("at")), index, "at").join(F.broadcast(catalog.select("dict_id", "ord")), "dict_id")
        found = _bodies(hit.select("at", "dict_id", "ord", "id"), bodies)
        first = found.groupBy("at").agg(F.min(F.struct("ord", "dict_id", "id", "body")).alias("b")).select("at", "b.dict_id", "b.id", "b.body")
        return here.join(first, here["matched"] == first["at"]).select("word", "matched", "hops", "dict_id", "id", "body")

    return _walk(words.where("word is not null").select("word", F.col("word").alias("matched")).distinct(), step, ["word"])


def aggregate_query(words: DataFrame, index: DataFrame, bodies: DataFrame, catalog: DataFrame, only: list[str] | None = None) -> DataFrame:
    """render_id, word, hit_count, html: a page of the entries of all dictionaries, or of those in ``only``, in catalog order.

    catalog: dict_id, ord, title. Resource keys are no words; entries with too many redirects are left out, words without any have no page.
    """
    if only:
        index = index.where(F.col("dict_id").isin(only))
    found = entry_query(words.where(~is_resource_key("word")), index, bodies).where("status = 'ok'")
    sections = found.join(F.broadcast(catalog.select("dict_id", "ord", "title")), "dict_id")
    return render_aggregate(sections.select(F.col("word").alias("render_id"), "word", "ord", "dict_id", "title", rewrite_html("body", "dict_id").alias("body")))


def resource_query(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """path, source, key, content_type of each asked path: the first source that has one of its spellings.

    sources: source, rank (containers of resources before texts, then the dictionary's folder, its root, static files), key, size.
    Resources over 32 MiB are not served, and paths that lead upwards are refused.
    """
    asked = paths.where(F.col("path").isNotNull() & ~F.col("path").rlike(r"(^|[\\/])\.\.([\\/]|$)")).select("path").distinct()
    cands = asked.select("path", F.posexplode(resource_candidates("path")).alias("pos", "key"))
    hit = cands.join(sources.where(F.coalesce("size", F.lit(0)) <= MAX_RESOURCE).select("key", "source", "rank"), "key")
    best = hit.groupBy("path").agg(F.min(F.struct("rank", "pos", "source", "key")).alias("b"))
    return best.select("path", "b.source", "b.key", content_type("path").alias("content_type"))


def path_query(paths: DataFrame, sources: DataFrame, index: DataFrame, bodies: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, source, key of any path of the root: a resource, else the entry of that word (source ``entry``, key its dictionary)."""
    found = resource_query(paths, sources).select("path", "source", "key")
    rest = paths.select("path").distinct().join(found, "path", "left_anti")
    words = rest.select("path", F.regexp_replace("path", "^/+", "").alias("word")).where("word <> ''")
    entries = first_query(words, index, bodies, catalog).where("status = 'ok'").select("word", "dict_id")
    return found.unionByName(words.join(entries, "word").select("path", F.lit("entry").alias("source"), F.col("dict_id").alias("key")))
