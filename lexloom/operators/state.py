"""Small state tables: catalog, index metadata, favorites, history; and change sets between two snapshots."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions.normalize import trim_unicode
from lexloom.operators.lookup import top_per
from lexloom.session import cut

SCHEMA_VERSION = 4


def logical_key(path: Column | str) -> Column:
    """Lower-case parent folder and stem of a container file; files that share it are one dictionary."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_replace(p, r"\.[^./\\]*$", ""))


@F.pandas_udf(StringType())
def _ripemd160(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else hashlib.new("ripemd160", x.encode()).hexdigest())


def dictionary_ids(files: DataFrame) -> DataFrame:
    """files(path) with dict_key and dict_id, the RIPEMD-160 of the key; equal ids of different keys get a -N suffix in key order."""
    keyed = files.withColumn("dict_key", logical_key("path"))
    ids = keyed.select("dict_key").distinct().withColumn("id", _ripemd160("dict_key"))
    ids = top_per(ids, ["id"], [F.col("dict_key")], 1 << 30)
    ids = ids.select("dict_key", F.when(F.col("rank") == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), F.col("rank").cast("string"))).alias("dict_id"))
    return keyed.join(ids, "dict_key")


def catalog(files: DataFrame) -> DataFrame:
    """dict_id, name, primary_path, texts, resources: one row per dictionary, named by its first text file's stem or title."""
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^./\\]*$", 1)
    return files.groupBy("dict_id").agg(
        F.min_by(F.coalesce("title", stem), F.struct(F.col("kind") != "mdx", F.col("path"))).alias("name"),
        F.min(F.when(F.col("kind") == "mdx", F.col("path"))).alias("primary_path"),
        F.sum(F.when(F.col("kind") == "mdx", 1).otherwise(0)).alias("texts"),
        F.sum(F.when(F.col("kind") == "mdd", 1).otherwise(0)).alias("resources"),
    )


def logical_catalog(files: DataFrame, settings: DataFrame) -> DataFrame:
    """dict_id, dict_key, name, primary_path, texts, resources, container_class, extra_css, extra_js of files(path), by their logical key.

    settings: path, name, container_class, css, js of the files that have any (as configs() reads them). The name is that of the
    settings of the first text file, else its stem.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    f = dictionary_ids(files).join(settings.select("path", F.col("name").alias("_n"), "container_class", "css", "js"), "path", "left").withColumn("_text", kind != "mdd")
    first = F.struct(~F.col("_text"), F.col("path"))
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^./\\]*$", 1)
    return f.groupBy("dict_id", "dict_key").agg(
        F.min_by(F.coalesce("_n", stem), first).alias("name"), F.min(F.when(F.col("_text"), F.col("path"))).alias("primary_path"),
        F.sum(F.col("_text").cast("int")).alias("texts"), F.sum((~F.col("_text")).cast("int")).alias("resources"),
        F.min_by("container_class", first).alias("container_class"), F.min_by("css", first).alias("extra_css"), F.min_by("js", first).alias("extra_js"),
    )


def custom_parts(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """dict_id, css, js, found of asked(dict_id): the style and script of a dictionary's settings; empty where it has none."""
    c = catalog.select("dict_id", F.coalesce("extra_css", F.lit("")).alias("css"), F.coalesce("extra_js", F.lit("")).alias("js"), F.lit(True).alias("found"))
    return asked.select("dict_id").distinct().join(c, "dict_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def staleness(scan: DataFrame, meta: DataFrame) -> DataFrame:
    """path, exists, up_to_date of scanned files (path, size, mtime) against index metadata (path, schema_version, size, mtime)."""
    m = meta.select("path", "schema_version", F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.lit(True).alias("known"))
    same = (F.col("schema_version") == SCHEMA_VERSION) & (F.col("m_size") == F.col("size")) & (F.col("m_mtime") == F.col("mtime"))
    return scan.join(m, "path", "left").select("path", F.coalesce("known", F.lit(False)).alias("exists"), F.coalesce(same, F.lit(False)).alias("up_to_date"))


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (``removed``, ``added``, ``changed``) between two snapshots (path, size, mtime); unchanged files are left out."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.lit(True).alias("o"))
    n = new.select("path", "size", "mtime", F.lit(True).alias("n"))
    change = (
        F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added")
        .when(~(F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_mtime"))), "changed")
    )
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change is not null")


def favorites_upsert(favorites: DataFrame, added: DataFrame) -> DataFrame:
    """word, added_at after adding words: trimmed, the latest time of each, blanks dropped."""
    both = favorites.select("word", "added_at").unionByName(added.select("word", "added_at")).withColumn("word", trim_unicode("word"))
    return both.where("word <> ''").groupBy("word").agg(F.max("added_at").alias("added_at"))


def favorites_delete(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return favorites.join(gone.select(trim_unicode("word").alias("word")).distinct(), "word", "left_anti")


def favorites_clear(favorites: DataFrame) -> DataFrame:
    return favorites.limit(0)


def favorites_by_word(favorites: DataFrame) -> DataFrame:
    """Favorites with their place in the order of words as people read them (case and accents last)."""
    order = F.collate(F.col("word"), "UNICODE")
    return top_per(favorites.withColumn("_one", F.lit(1)), ["_one"], [order, F.col("word")], 1 << 30, "place").drop("_one")


def history(searches: DataFrame, user: str, word: str, ts: str, n: int = 20) -> DataFrame:
    """user, place, word, ts: latest searches of each user, each word once regardless of case, words of two characters or more."""
    valid = searches.where(F.char_length(trim_unicode(word)) >= 2).select(F.col(user).alias("user"), trim_unicode(word).alias("word"), F.col(ts).alias("ts"))
    last = valid.groupBy("user", F.lower("word").alias("_w")).agg(F.max(F.struct("ts", "word")).alias("b"))
    last = last.select("user", "b.ts", "b.word")
    return top_per(last, ["user"], [F.col("ts").desc(), F.col("word")], n, "place").select("user", "place", "word", "ts")


def debounce(events: DataFrame, ts: str, gap: str, keys: list[str] | None = None) -> DataFrame:
    """Bursts of events closer than the gap: keys, start, end, n. Works on static and on streaming frames."""
    keys = keys or []
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def block_offsets(blocks: DataFrame, part: str, order: str, size: str) -> DataFrame:
    """blocks with ``offset``: sum of the sizes before, within each part.

    Blocks are sorted into ranges, none of them a whole part if that is large; a range is summed by itself, and gets what the ranges
    before it hold of its first part, a table with one row a range.
    """
    placed = blocks.repartitionByRange(part, order).sortWithinPartitions(part, order)
    placed = cut(placed.withColumn("_r", F.spark_partition_id()))
    # of each range only its last part goes on into the next one
    edges = placed.groupBy("_r").agg(F.min(part).alias("first"), F.max(part).alias("last"))
    tails = placed.join(F.broadcast(edges.select("_r", "last")), "_r").where(F.col(part).eqNullSafe(F.col("last"))).groupBy("_r").agg(F.sum(size).alias("tail"))
    carried: dict[int, int] = {}
    before, of = 0, None
    for r in sorted(edges.join(tails, "_r", "left").collect(), key=lambda r: r["_r"]):
        carried[r["_r"]] = before if of == r["first"] else 0
        before = (r["tail"] or 0) + (before if of == r["last"] == r["first"] else 0)
        of = r["last"]
    spark = blocks.sparkSession
    carry = spark.createDataFrame(list(carried.items()) or [(-1, 0)], "_r int, _c long")
    running = Window.partitionBy("_r", part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = placed.join(F.broadcast(edges.select("_r", "first")), "_r").join(F.broadcast(carry), "_r")
    offset = F.coalesce(F.sum(size).over(running), F.lit(0)) + F.when(F.col(part).eqNullSafe(F.col("first")), F.col("_c")).otherwise(0)
    return got.withColumn("offset", offset.cast("long")).drop("_r", "first", "_c")


def record_locations(entries: DataFrame, block_size: int) -> DataFrame:
    """entries(id, off, len) in fixed blocks: id, block_no, start, stop inside the block, clamped to its end."""
    no = F.expr(f"off div {block_size}")
    return entries.select(
        "id", no.alias("block_no"), (F.col("off") - no * block_size).alias("start"), F.least(F.col("off") - no * block_size + F.col("len"), F.lit(block_size)).cast("long").alias("stop")
    )
