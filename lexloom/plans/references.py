"""Redirects and entry links of record bodies: hierarchies (problem 5) and orphan references (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.links import LINK_ATTRIBUTES, redirect_target, with_entry_target
from lexloom.functions.normalize import canonical_normalize
from lexloom.operators.hierarchy import descendants, hierarchy, paths
from lexloom.operators.orphans import report_orphans, resolve_text_references
from lexloom.operators.skew import join_unique
from lexloom.plans.data import table
from lexloom.session import cut


def body_references(sections: DataFrame) -> DataFrame:
    """section_id, dict, index_id, fetched_at, target, redirect: distinct references of aggregate sections.

    A null body refers to nothing; sections delivered again with the same section_id and target count once (earliest fetch).
    """
    s = sections.select("section_id", "index_id", F.col("dict_id").alias("dict"), "fetched_at", "body").where("body is not null")
    s = s.withColumn("jump", redirect_target("body"))
    # one pass over the bodies: a redirect is its own single reference, other bodies give one row per link attribute
    marks = F.when(F.col("jump").isNotNull(), F.array("jump")).otherwise(F.regexp_extract_all("body", F.lit(LINK_ATTRIBUTES), 0))
    rows = s.select("section_id", "index_id", "dict", "fetched_at", F.col("jump").isNotNull().alias("redirect"), F.explode(marks).alias("m"))
    link = F.when(~F.col("redirect"), F.col("m"))
    rows = rows.withColumn("a", F.regexp_extract(link, r"^([^\s=]+)", 1)).withColumn("v", F.regexp_extract(link, r"""(?s)["'](.*)["']$""", 1))
    rows = with_entry_target(rows, "a", "v", "word")
    target = F.when(F.col("redirect"), F.col("m")).otherwise(F.col("word"))
    # an explode and no filter: a filter would be pushed below, with all the expressions above written into it again
    rows = rows.select("section_id", "dict", "index_id", "fetched_at", "redirect", F.explode(F.array_compact(F.array(target))).alias("target"))
    return rows.groupBy("section_id", "dict", "target").agg(F.min("index_id").alias("index_id"), F.min("fetched_at").alias("fetched_at"), F.max("redirect").alias("redirect"))


def index_keys(index: DataFrame) -> DataFrame:
    return index.select(F.col("dict_id").alias("dict"), "text", "normalized", F.struct("id", "indexed_at", "deleted_at").alias("row"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body_references with the row each means (target_id) and its state: missing, deleted, late, or null where it is there."""
    refs = cut(body_references(table(spark, sf_dir, "aggregate_section")).withColumn("norm", canonical_normalize("target")))
    words = cut(refs.groupBy("dict", "target", "norm").agg(F.count(F.lit(1)).alias("n")))
    meant = cut(resolve_text_references(words, index_keys(table(spark, sf_dir, "mdx_index"))))
    state = (
        F.when(F.col("row").isNull(), "missing")
        .when(F.col("row.deleted_at") <= F.col("fetched_at"), "deleted")
        .when(F.col("row.indexed_at") > F.col("fetched_at"), "late")
    )
    # a word may be the target of any share of the references
    return join_unique(refs, meant, ["dict", "target"], words.select("dict", "target", "n")).select(
        "section_id", "dict", "index_id", "fetched_at", "target", "redirect", F.col("row.id").alias("target_id"), state.alias("state")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_references(spark, sf_dir).where("state is not null").select("section_id", "target", "state")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per dictionary and month of fetched_at."""
    got = resolved_references(spark, sf_dir)
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s)
    month = F.date_format("fetched_at", "yyyy-MM").alias("month")
    return got.groupBy(F.col("dict").alias("dict_id"), month).agg(F.count(F.lit(1)).alias("references"), n("missing"), n("deleted"), n("late"))


def p6_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer references without a record, per table and month: sections of index rows, payloads and suggestions of queries."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    index, asked = table(spark, sf_dir, "mdx_index"), table(spark, sf_dir, "query_form")
    out = report_orphans(table(spark, sf_dir, "aggregate_section"), "index_id", month("fetched_at"), index, "id", "aggregate_section")
    out = out.unionByName(report_orphans(table(spark, sf_dir, "query_json_payload"), "query_id", month("created_at"), asked, "query_id", "query_json_payload"))
    return out.unionByName(report_orphans(table(spark, sf_dir, "fuzzy_suggestion"), "query_id", F.lit(None).cast("string"), asked, "query_id", "fuzzy_suggestion"))


def redirect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: redirects that lead to a live row of the same dictionary."""
    got = resolved_references(spark, sf_dir).where("redirect and state is null and index_id is not null")
    return got.groupBy(F.col("index_id").alias("child")).agg(F.min_by("target_id", "section_id").alias("parent"))


def redirect_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(redirect_links(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect_trees(spark, sf_dir).select("node_id", "root_id", "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the index with its path, final headword, depth and number of rows redirected to it; see ``paths``."""
    found = cut(paths(cut(redirect_trees(spark, sf_dir))))
    ids = table(spark, sf_dir, "mdx_index").where("id is not null").select(F.col("id").cast("long").alias("node_id"))
    # rows without a link that nothing leads to are their own end
    alone = ids.join(found.where("part = 0").select("node_id"), "node_id", "left_anti")
    zero = F.lit(0).cast("long")
    alone = alone.select("node_id", F.col("node_id").alias("root_id"), zero.alias("depth"), zero.alias("n_below"), F.lit(0).alias("part"), F.array("node_id").alias("path"))
    return found.unionByName(alone)


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows redirected to a row, over one link or more: node_id, descendant_id, distance. Rows with none (n_below 0 in p5_paths) have no row."""
    return descendants(paths(cut(redirect_trees(spark, sf_dir))))
