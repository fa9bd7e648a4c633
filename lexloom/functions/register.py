"""The engine's functions under SQL names. Native ones are SQL functions over their expressions; Arrow ones are registered UDFs.

Functions that hand lambdas to arrays (candidates, lists of tokens) have no name here, as their expressions have no SQL text; the
DataFrame functions of the same names do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import html as H
from lexloom.functions import links as L
from lexloom.functions import normalize as N
from lexloom.functions import text as T
from lexloom.functions import web as W

ARROW = {"lex_rewrite_html": H.rewrite_html, "lex_rewrite_css": H.rewrite_css_urls, "lex_scope_css": H.scope_css, "lex_section_meta": H.section_meta, "lex_etag": W.etag, "lex_highlight": W.highlight}

#: Name with parameters, type of the result, expression.
NATIVE: dict[str, tuple[str, Callable[[], Column]]] = {
    "lex_normalize(s STRING)": ("STRING", lambda: N.canonical_normalize("s")),
    "lex_fold_diacritics(s STRING)": ("STRING", lambda: N.fold_diacritics("s")),
    "lex_fold_punctuation(s STRING)": ("STRING", lambda: N.fold_punctuation("s")),
    "lex_lookup_key(s STRING)": ("STRING", lambda: N.lookup_key("s")),
    "lex_nocase(s STRING)": ("STRING", lambda: N.ascii_fold("s")),
    "lex_trim(s STRING)": ("STRING", lambda: N.trim_unicode("s")),
    "lex_irregular_lemma(s STRING)": ("STRING", lambda: N.irregular_lemma("s")),
    "lex_trim_doubled(s STRING)": ("STRING", lambda: N.trim_doubled("s")),
    "lex_redirect(s STRING)": ("STRING", lambda: L.redirect_target("s")),
    "lex_is_external(s STRING)": ("BOOLEAN", lambda: L.is_external("s")),
    "lex_has_resource_extension(s STRING)": ("BOOLEAN", lambda: L.has_resource_extension("s")),
    "lex_looks_like_resource(s STRING)": ("BOOLEAN", lambda: L.looks_like_resource("s")),
    "lex_entry_word(s STRING)": ("STRING", lambda: L.entry_word("s")),
    "lex_percent_encode(s STRING)": ("STRING", lambda: L.percent_encode("s")),
    "lex_percent_decode(s STRING)": ("STRING", lambda: L.percent_decode("s")),
    "lex_is_resource_key(s STRING)": ("BOOLEAN", lambda: T.is_resource_key("s")),
    "lex_is_suggest_candidate(s STRING)": ("BOOLEAN", lambda: T.is_suggest_candidate("s")),
    "lex_is_fts_admitted(s STRING)": ("BOOLEAN", lambda: T.is_fts_admitted("s")),
    "lex_is_fuzzy_candidate(s STRING)": ("BOOLEAN", lambda: T.is_fuzzy_candidate("s")),
    "lex_is_displayable(s STRING)": ("BOOLEAN", lambda: T.is_displayable("s")),
    "lex_is_valid_input(s STRING)": ("BOOLEAN", lambda: T.is_valid_input("s")),
    "lex_is_inflected(word STRING, matched STRING)": ("BOOLEAN", lambda: T.is_inflected("word", "matched")),
    "lex_relevance(word STRING, prefix STRING, score DOUBLE)": ("INT", lambda: T.relevance("word", "prefix", F.col("score"))),
    "lex_strip_tags(s STRING)": ("STRING", lambda: T.strip_tags("s")),
    "lex_sanitize(s STRING)": ("STRING", lambda: T.sanitize("s")),
    "lex_escape_html(s STRING)": ("STRING", lambda: T.escape_html("s")),
    "lex_escape_js(s STRING)": ("STRING", lambda: T.escape_js("s")),
    "lex_content_type(s STRING)": ("STRING", lambda: T.content_type("s")),
    "lex_is_cacheable(kind STRING, size BIGINT)": ("BOOLEAN", lambda: T.is_cacheable("kind", "size")),
    "lex_byte_range(header STRING, total BIGINT)": ("STRUCT<first: BIGINT, last: BIGINT>", lambda: W.byte_range("header", "total")),
    "lex_reader_budget(readers BIGINT)": ("BIGINT", lambda: W.reader_budget("readers")),
    "lex_levenshtein(a STRING, b STRING, most INT)": ("INT", lambda: F.expr("levenshtein(a, b, most)")),
}


def sql_of(spark: SparkSession, parameters: str, c: Column) -> str:
    """The SQL text of an expression without lambdas over parameters (``name TYPE, ...``), as it is once resolved."""
    project = spark.createDataFrame([], parameters).select(c.alias("r"))._jdf.queryExecution().analyzed()
    return project.expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    """Make the functions usable in spark.sql()."""
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    for name, (kind, f) in NATIVE.items():
        parameters = name[name.index("(") + 1 : -1]
        spark.sql(f"create or replace temporary function {name} returns {kind} return {sql_of(spark, parameters, f())}")
