"""The pN_ queries of the corpus operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.normalize import canonical_normalize
from lexloom.llm.canonical import map_values
from lexloom.llm.charform import consistent_forms, is_suspect
from lexloom.llm.leaks import find_leaks
from lexloom.llm.markup import clean_texts, find_markup, labelled_pages, train
from lexloom.llm.mojibake import find_damaged, repaired
from lexloom.llm.pieces import split_column
from lexloom.llm.tokens import encode_column
from lexloom.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; a file too small to be split is spread over the cores, as most of the work is done per row in Python."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name not in FIXED and df.rdd.getNumPartitions() < cores // 2 else df


#: Tables of a fixed number of rows.
FIXED = ("dict_header", "ref_headword", "eval_item")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    got = split_column(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False)
    return got.where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, with their text."""
    return split_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text: number of pieces, most tokens of one, most characters shared by two, and whether the pieces without what they share are the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    pieces = split_column(docs, "doc_id", "text")
    own = F.substring(F.col("text"), (F.col("shared") + 1).cast("int"), F.length("text"))
    per = pieces.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.max("n_tokens").alias("most_tokens"), F.max("shared").alias("most_shared"), F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("all")
    )
    per = per.withColumn("joined", F.md5(F.array_join(F.transform("all", lambda x: x["own"]), ""))).drop("all")
    return docs.select("doc_id", F.md5("text").alias("_m")).join(per, "doc_id").select("doc_id", "n_pieces", "most_tokens", "most_shared", (F.col("joined") == F.col("_m")).alias("whole"))


def leaked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leaked_passages(spark, sf_dir).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked test items with the number of documents each stands in, and the longest passage of it in words."""
    return leaked_passages(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "dict_header").groupBy(F.col("dict_id").alias("source")).agg(F.min("lang").alias("lang"))
    rows = table(spark, sf_dir, "mdx_index").select(F.lit("mdx_index").alias("src"), F.col("id").alias("row_id"), F.col("dict_id").alias("source"), "text")
    return rows.join(F.broadcast(lang), "source", "left")


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headwords and bodies as records of one source each."""
    header = table(spark, sf_dir, "dict_header")
    lang = header.groupBy(F.col("dict_id").alias("source")).agg(F.min("lang").alias("lang"))
    titles = header.select(F.lit("dict_header").alias("src"), F.col("header_id").alias("row_id"), F.lit("titles").alias("source"), F.col("title").alias("text"), "lang")
    bodies = table(spark, sf_dir, "aggregate_section").select(
        F.lit("aggregate_section").alias("src"), F.col("section_id").alias("row_id"), F.col("dict_id").alias("source"), F.col("body").alias("text")
    )
    return index_texts(spark, sf_dir).unionByName(titles).unionByName(bodies.join(F.broadcast(lang), "source", "left"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that were read with an encoding other than the one written."""
    bad, _ = find_damaged(encoded_texts(spark, sf_dir))
    return bad.select("src", "row_id")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged fields with the chain they went through and the text as originally written, where it can be restored."""
    records = encoded_texts(spark, sf_dir)
    bad, counts = find_damaged(records)
    # the damaged ones first, so that only their texts are moved to be told apart
    return repaired(records.where("text is not null").join(bad, ["src", "row_id"]).dropDuplicates(["src", "row_id"]), counts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords and normalised headwords of text dictionaries that are not in the consistent form; encoding damage aside."""
    texts = index_texts(spark, sf_dir)
    # learned from what p4_found learns from, so that the same rows are damaged
    bad, _ = find_damaged(texts, encoded_texts(spark, sf_dir))
    kinds = table(spark, sf_dir, "dict_header").where("kind = 'mdx'").select("dict_id").distinct()
    rows = table(spark, sf_dir, "mdx_index").join(F.broadcast(kinds), "dict_id", "left_semi").select("id", "text", "normalized")
    # other rows are no case: their text is its own form by its characters, and normalized follows from it
    open_ = is_suspect(F.col("text")) | (F.col("normalized") != canonical_normalize("text"))
    rows = cut(rows.where(open_))
    rows = rows.join(bad.select(F.col("row_id").alias("id")), "id", "left_anti")
    rows = rows.join(consistent_forms(rows), "text", "left").withColumn("form", F.coalesce("form", "text"))
    fields = F.array(
        F.when(F.col("form") != F.col("text"), F.lit("text")),
        F.when(F.col("normalized") != canonical_normalize("form"), F.lit("normalized")),
    )
    return rows.select("id", F.explode(F.array_compact(fields)).alias("field"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the text dictionaries: id, its headword in the consistent form, and the normalisation of that.

    Damage by a wrong encoding is put right first, where it can be.
    """
    texts = index_texts(spark, sf_dir)
    bad, counts = find_damaged(texts, encoded_texts(spark, sf_dir))
    kinds = table(spark, sf_dir, "dict_header").where("kind = 'mdx'").select(F.col("dict_id").alias("source")).distinct()
    rows = cut(texts.join(F.broadcast(kinds), "source", "left_semi").join(bad, ["src", "row_id"], "left"))
    mended = repaired(rows.where("z is not null"), counts).select("row_id", F.col("restored").alias("text"))
    rows = rows.where("z is null").select("row_id", "text").unionByName(mended)
    # other texts are their own form by their characters
    rows = cut(rows.select(F.col("row_id").alias("id"), "text", F.coalesce(is_suspect(F.col("text")), F.lit(False)).alias("odd")))
    odd = rows.where("odd")
    formed = odd.join(consistent_forms(odd), "text", "left").select("id", F.coalesce("form", "text").alias("text"))
    return rows.where("not odd").select("id", "text").unionByName(formed).withColumn("normalized", canonical_normalize("text"))


def entered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_id, value of everything typed, offered or contributed."""
    contrib = table(spark, sf_dir, "dict_header").where("origin = 'contrib'").select("dict_id").distinct()
    typed = table(spark, sf_dir, "query_form").select(F.lit("query_form").alias("src"), F.col("query_id").alias("row_id"), F.col("word").alias("value"))
    offered = table(spark, sf_dir, "fuzzy_suggestion").select(F.lit("fuzzy_suggestion").alias("src"), F.col("suggestion_id").alias("row_id"), F.col("word").alias("value"))
    headwords = table(spark, sf_dir, "mdx_index").join(F.broadcast(contrib), "dict_id", "left_semi")
    return typed.unionByName(offered).unionByName(headwords.select(F.lit("mdx_index").alias("src"), F.col("id").alias("row_id"), F.col("text").alias("value")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered values with the canonical entry they stand for, 0 for none; a form sent again counts once."""
    got = map_values(entered_values(spark, sf_dir), table(spark, sf_dir, "ref_headword"), "ref_id", "canonical")
    return got.groupBy("src", "row_id").agg(F.max("ref_id").alias("ref_id"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand for no entry, with the number of rows that have them."""
    got = map_values(entered_values(spark, sf_dir), table(spark, sf_dir, "ref_headword"), "ref_id", "canonical", with_value=True)
    return got.where("ref_id = 0").groupBy("src", "value").agg(F.countDistinct("row_id").alias("rows"))


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "aggregate_section").select(F.lit("aggregate_section").alias("src"), F.col("section_id").alias("row_id"), F.col("body").alias("text"))
    pages = table(spark, sf_dir, "query_json_payload").select(F.lit("query_json_payload").alias("src"), F.col("payload_id").alias("row_id"), F.col("html").alias("text"))
    return bodies.unionByName(pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup each body and page carries; a row delivered twice counts once."""
    texts = marked_texts(spark, sf_dir)
    return find_markup(texts, train(labelled_pages(texts))).distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and pages as clean text with their structure kept."""
    texts = marked_texts(spark, sf_dir)
    return clean_texts(texts, train(labelled_pages(texts)))
