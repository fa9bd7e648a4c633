"""Queries of the engine's own operators over the test tables, and their SQL.

The index is mdx_index; query words are the distinct words of query_form (prefixes are of ref_headword, as in their SQL); bodies are those of aggregate_section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import html as H
from lexloom.functions import links as L
from lexloom.functions import normalize as N
from lexloom.functions import text as T
from lexloom.operators import entries as E
from lexloom.operators import lookup as K
from lexloom.operators import render as R
from lexloom.operators import state as S
from lexloom.operators import suggest as G
from lexloom.plans.data import table
from lexloom.plans.references import redirect_links
from lexloom.session import cut


def index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mdx_index").select("dict_id", "id", "text", "normalized")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_form").where("word is not null").select("word").distinct()


def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """First four letters of every canonical headword."""
    return table(spark, sf, "ref_headword").select(F.substring("canonical", 1, 4).alias("prefix")).distinct()


# ---- functions


def normalize_headwords(spark, sf):
    return index(spark, sf).select("id", N.canonical_normalize("text").alias("norm"))


def fold_diacritics(spark, sf):
    return index(spark, sf).select("id", N.fold_diacritics("text").alias("folded"))


def lookup_keys(spark, sf):
    return words(spark, sf).select("word", N.lookup_key("word").alias("key"))


def word_predicates(spark, sf):
    return index(spark, sf).select(
        "id", T.is_resource_key("text").alias("resource"), T.is_suggest_candidate("text").alias("suggest"), T.is_fts_admitted("text").alias("fts"),
        T.is_fuzzy_candidate("text").alias("fuzzy"), T.is_displayable("text").alias("display"),
    )


def lemma_candidates(spark, sf):
    return words(spark, sf).select("word", F.array_join(N.lemma_candidates("word"), "|").alias("lemmas"))


def query_candidates(spark, sf):
    return K.entry_candidates(words(spark, sf))


def strip_tags(spark, sf):
    return table(spark, sf, "aggregate_section").select("section_id", T.strip_tags("body").alias("plain"))


def sanitize(spark, sf):
    return table(spark, sf, "aggregate_section").select("section_id", T.sanitize("body").alias("safe"))


def escape_html(spark, sf):
    return table(spark, sf, "aggregate_section").select("section_id", T.escape_html("body").alias("escaped"))


def percent_encode(spark, sf):
    return index(spark, sf).select("id", L.percent_encode("text").alias("encoded"))


def link_target(spark, sf):
    s = table(spark, sf, "aggregate_section").select("section_id", L.redirect_target("body").alias("target"))
    return s.where("target is not null")


def body_links(spark, sf):
    s = table(spark, sf, "aggregate_section").select("section_id", F.explode(F.regexp_extract_all("body", F.lit(L.LINK_ATTRIBUTES), 0)).alias("m"))
    return s.select("section_id", F.regexp_extract("m", r"^([^\s=]+)", 1).alias("attr"), F.regexp_extract("m", r"""(?s)["'](.*)["']$""", 1).alias("value"))


def link_classify(spark, sf):
    got = body_links(spark, sf).select("section_id", "attr", "value", L.link_kind("attr", "value").alias("kind"))
    return got.groupBy("section_id", "attr", "value", "kind").agg(F.count(F.lit(1)).alias("n"))


def resource_paths(spark, sf):
    rows = index(spark, sf).where(T.is_resource_key("text"))
    return rows.select("id", L.resource_path("text").alias("path"), T.content_type("text").alias("mime"))


def rewrite_html(spark, sf):
    return table(spark, sf, "aggregate_section").select("section_id", H.rewrite_html("body", "dict_id").alias("html"))


def scope_css(spark, sf):
    s = table(spark, sf, "aggregate_section").where("extra_css is not null")
    return s.select("section_id", H.scope_css("extra_css", "dict_id").alias("css"))


def section_meta(spark, sf):
    s = table(spark, sf, "aggregate_section").select("section_id", H.section_meta("body", "dict_id").alias("m"))
    return s.select("section_id", "m.headword", F.to_json("m.phonetics").alias("phonetics"), "m.audio", F.to_json("m.entries").alias("entries"), "m.sense_count")


# ---- lookups


def lookup_exact(spark, sf):
    return K.lookup_exact(words(spark, sf), index(spark, sf))


def lookup_nocase(spark, sf):
    return K.lookup_nocase(words(spark, sf), index(spark, sf))


def lookup_normalized(spark, sf):
    return K.lookup_normalized(words(spark, sf), index(spark, sf))


def lookup_cascade(spark, sf):
    return K.lookup_cascade(words(spark, sf), index(spark, sf))


def entry_lookup(spark, sf):
    return K.entry_lookup(words(spark, sf), index(spark, sf))


def catalog_order(spark, sf) -> DataFrame:
    return table(spark, sf, "dict_header").select("dict_id", F.row_number().over(Window.orderBy("path")).alias("ord"))


def cross_dict_first_hit(spark, sf):
    return K.first_hit(K.lookup_cascade(words(spark, sf), index(spark, sf)), catalog_order(spark, sf)).select("word", "dict_id", "ord", "kind", "id")


def filtered_lookup(spark, sf):
    """Each query in the dictionaries it names."""
    q = table(spark, sf, "query_form").where("word is not null").select("query_id", "word", T.dict_filter("dicts").alias("only")).distinct()
    hit = q.select("query_id", "word", "only").join(K.lookup_exact(words(spark, sf), index(spark, sf)), "word")
    return hit.where((F.size("only") == 0) | F.array_contains("only", F.col("dict_id"))).select("query_id", "dict_id", "id")


def resource_lookup(spark, sf):
    """Every resource asked for by its path without the root, found under any spelling."""
    asked = index(spark, sf).where(T.is_resource_key("text")).select(F.regexp_replace("text", r"^[\\/]+", "").alias("word")).distinct()
    cands = asked.select("word", F.posexplode(T.resource_candidates("word")).alias("pos", "candidate"))
    hit = cands.join(index(spark, sf), F.col("candidate") == F.col("text")).select("word", "dict_id", "pos", "id")
    return hit.groupBy("word", "dict_id").agg(F.min(F.struct("pos", "id")).alias("b")).select("word", "dict_id", "b.pos", "b.id")


def redirect_chase(spark, sf):
    links = cut(redirect_links(spark, sf))
    return K.follow_redirects(links.select(F.col("child").alias("node")), links, 5)


def redirect_trace(spark, sf):
    links = cut(redirect_links(spark, sf))
    got = K.trace(links.select(F.col("child").alias("node")), links)
    return got.select("node", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"), "depth")


def random_headword(spark, sf):
    return K.random_headwords(index(spark, sf), 42, 10)


# ---- suggestions


def suggest_prefix(spark, sf):
    return G.suggest_prefix(prefixes(spark, sf), index(spark, sf))


def suggest_merged(spark, sf):
    return G.suggest_merged(prefixes(spark, sf), index(spark, sf))


def fts_postings(spark, sf):
    return G.fts_postings(index(spark, sf))


def fts_bm25(spark, sf):
    got = G.fts_bm25(prefixes(spark, sf).select(N.canonical_normalize("prefix").alias("term")).distinct(), index(spark, sf))
    return got.select("term", "dict_id", "id", F.round("score", 6).alias("score"))


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical headwords, several words included, and their first four letters."""
    return table(spark, sf, "ref_headword").select(F.col("canonical").alias("prefix")).unionByName(prefixes(spark, sf)).distinct()


def fts_match(spark, sf):
    return G.fts_match(searched(spark, sf), index(spark, sf)).withColumn("score", F.round("score", 6))


def suggest_fts(spark, sf):
    return G.suggest(searched(spark, sf), index(spark, sf))


def fts_trigram_match(spark, sf):
    """Headwords that hold four inner letters of a canonical headword."""
    terms = table(spark, sf, "ref_headword").select(F.substring("canonical", 3, 4).alias("term")).distinct()
    return G.fts_trigram_match(terms, index(spark, sf))


def fts_trigrams(spark, sf):
    rows = index(spark, sf).where(T.is_fts_admitted("text")).select("dict_id", F.explode(T.trigrams("text")).alias("gram"))
    return rows.groupBy("dict_id", "gram").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_suggest(spark, sf):
    return G.fuzzy_suggest(words(spark, sf), index(spark, sf))


def fuzzy_cross_dict(spark, sf):
    return G.fuzzy_merged(words(spark, sf), index(spark, sf))


def suggest_else_fuzzy(spark, sf):
    return G.suggest_else_fuzzy(words(spark, sf), index(spark, sf))


# ---- answers


def answer_sections(spark, sf) -> DataFrame:
    """Sections per headword: one render per matched text, in section order."""
    # rows delivered twice are identical, hence any of them will do
    s = table(spark, sf, "aggregate_section").dropDuplicates(["section_id"])
    return s.select(F.col("matched").alias("render_id"), F.col("matched").alias("word"), "matched", F.col("section_id").alias("ord"), "dict_id", "title", "body").where("matched is not null")


def dedup_styles(spark, sf):
    return R.dedup_styles(answer_sections(spark, sf)).select(F.col("ord").alias("section_id"), "dict_id", "body", "head")


def render_aggregate(spark, sf):
    return R.render_aggregate(answer_sections(spark, sf))


def query_json(spark, sf):
    return R.json_payload(answer_sections(spark, sf)).select("word", "matched", "hit_count", "payload")


def entry_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One body of every index row that has any: the first section's."""
    s = table(spark, sf, "aggregate_section").where("body is not null and index_id is not null")
    return s.groupBy("dict_id", F.col("index_id").alias("id")).agg(F.min_by("body", "section_id").alias("body"))


def titled_catalog(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "dict_header").select("dict_id", "title")
    return catalog_order(spark, sf).join(titles, "dict_id")


def entry_query(spark, sf):
    return E.entry_query(words(spark, sf), index(spark, sf), entry_bodies(spark, sf)).select("word", "dict_id", "matched", "hops", "id", "status", F.octet_length("body").alias("bytes"))


def first_query(spark, sf):
    got = E.first_query(words(spark, sf), index(spark, sf), entry_bodies(spark, sf), catalog_order(spark, sf))
    return got.select("word", "dict_id", "matched", "hops", "id", "status", F.octet_length("body").alias("bytes"))


def query_aggregate(spark, sf):
    return E.aggregate_query(words(spark, sf), index(spark, sf), entry_bodies(spark, sf), titled_catalog(spark, sf))


def frame_pages(spark, sf):
    s = table(spark, sf, "aggregate_section").dropDuplicates(["section_id"]).where("matched is not null")
    return R.frame_pages(s.select(F.col("matched").alias("render_id"), F.col("section_id").alias("ord"), "dict_id", "body", "extra_css", "extra_js"))


def first_audio(spark, sf):
    return R.first_audio(answer_sections(spark, sf))


def hit_counts(spark, sf):
    return answer_sections(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("hit_count"), F.countDistinct("dict_id").alias("dictionaries"))


# ---- state


def dict_list(spark, sf):
    files = table(spark, sf, "dict_header").select("dict_id", "path", "kind", "title")
    return S.catalog(files)


def dict_ids(spark, sf):
    return S.dictionary_ids(table(spark, sf, "dict_header").select("path"))


def index_stats(spark, sf):
    return index(spark, sf).groupBy("dict_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("normalized").alias("normalized"), F.max("id").alias("max_id"), F.sum(F.when(T.is_fts_admitted("text"), 1).otherwise(0)).alias("fts")
    )


def index_status(spark, sf):
    """Headers as a scan, against metadata written a version ago for half of the languages and with another time for some."""
    h = table(spark, sf, "dict_header")
    scan = h.select("path", F.col("header_id").alias("size"), F.col("source_mtime").alias("mtime"))
    meta = h.where("kind = 'mdx'").select("path", F.when(F.col("lang") == "en", 3).otherwise(4).alias("schema_version"), F.col("header_id").alias("size"), (F.col("source_mtime") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("mtime"))
    return S.staleness(scan, meta)


def change_set(spark, sf):
    h = table(spark, sf, "dict_header").select("path", F.col("header_id").alias("size"), F.col("source_mtime").alias("mtime"), "lang")
    old = h.where("lang <> 'de'").drop("lang")
    new = h.where("lang <> 'ru'").withColumn("mtime", F.col("mtime") + F.when(F.col("lang") == "pl", 5).otherwise(0)).drop("lang")
    return S.change_set(old, new)


def favorites_upsert(spark, sf):
    q = table(spark, sf, "query_form").where("word is not null").select("word", F.unix_micros("ts").alias("added_at"))
    return S.favorites_upsert(q.where("format is null"), q.where("format is not null"))


def favorites_list(spark, sf):
    fav = favorites_upsert(spark, sf)
    return K.top_per(fav.withColumn("one", F.lit(1)), ["one"], [F.col("added_at").desc(), F.col("word")], 100).select("rank", "word", "added_at")


def history_top20(spark, sf):
    q = table(spark, sf, "query_form").where("word is not null and session_id is not null")
    return S.history(q, "session_id", "word", "ts").select("user", "place", "word", F.unix_micros("ts").alias("ts"))


def debounce_sessions(spark, sf):
    got = S.debounce(table(spark, sf, "events").where("event_type <> 'error'").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "5 minutes", ["user_id"])
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")


def cache_keys(spark, sf):
    q = table(spark, sf, "query_form").where("word is not null").select(T.cache_key("word", "format", "dicts").alias("key"))
    return q.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def cache_admission(spark, sf):
    rows = table(spark, sf, "mdx_index").where(T.is_resource_key("text")).select("id", T.content_type("text").alias("mime"), (F.col("record_length") * 512).alias("size"))
    return rows.select("id", "mime", "size", T.is_cacheable("mime", "size").alias("cache"))


def block_prefix_sum(spark, sf):
    b = table(spark, sf, "mdx_index").groupBy("dict_id", "block_offset").agg(F.max("block_dsize").alias("dsize"))
    return S.block_offsets(b, "dict_id", "block_offset", "dsize").select("dict_id", "block_offset", "dsize", "offset")


def record_locations(spark, sf):
    e = table(spark, sf, "mdx_index").select("id", F.col("record_offset").alias("off"), F.col("record_length").alias("len"))
    return S.record_locations(e, 16384)


def inflected_matches(spark, sf):
    p = table(spark, sf, "query_json_payload").where("word is not null and matched is not null")
    return p.select("payload_id", T.is_inflected("word", "matched").alias("inflected"))


QUERIES = [
    normalize_headwords, fold_diacritics, lookup_keys, word_predicates, lemma_candidates, query_candidates, strip_tags, sanitize, escape_html, percent_encode,
    link_target, link_classify, resource_paths, rewrite_html, scope_css, section_meta, lookup_exact, lookup_nocase, lookup_normalized, lookup_cascade,
    entry_lookup, cross_dict_first_hit, filtered_lookup, resource_lookup, redirect_chase, redirect_trace, random_headword, suggest_prefix, suggest_merged,
    fts_postings, fts_bm25, fts_match, suggest_fts, fts_trigram_match, fts_trigrams, fuzzy_suggest, fuzzy_cross_dict, suggest_else_fuzzy, dedup_styles, render_aggregate, query_json, hit_counts, entry_query, first_query, query_aggregate, frame_pages, first_audio,
    dict_list, dict_ids, index_stats, index_status, change_set, favorites_upsert, favorites_list, history_top20, debounce_sessions, cache_keys,
    cache_admission, block_prefix_sum, record_locations, inflected_matches,
]


def container_scan(spark, sf):
    """The canonical headwords written to container files of both versions, and read back with their bodies."""
    from uuid import uuid4

    from lexloom.session import ensure_checkpoint_dir
    from lexloom.sources.container import ContainerSource, index_rows, read_records, write_container

    folder = f"{ensure_checkpoint_dir(spark)}/containers-{uuid4().hex}"
    rows = table(spark, sf, "ref_headword").orderBy("ref_id").select("canonical").toPandas()["canonical"].tolist()
    for version, encrypted, encoding in ((1, 0, "UTF-8"), (2, 2, "UTF-16")):
        write_container(f"{folder}/v{version}.mdx", [(w, f"<b>{w}</b>".encode()) for w in rows], version, encoding, encrypted, block=1000)
    spark.dataSource.register(ContainerSource)
    index = index_rows(spark.read.format("lexicon_container").load(folder))
    got = index.join(read_records(index), ["path", "id"])
    return got.select(F.regexp_extract("path", r"(v\d)\.mdx$", 1).alias("file"), "id", "text", "normalized", "record_length", F.octet_length("body").alias("bytes"))


QUERIES.append(container_scan)
