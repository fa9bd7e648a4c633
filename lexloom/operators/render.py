"""Aggregated answers: sections of several dictionaries joined to one document or payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.html import section_meta, split_styles, style_fingerprint
from lexloom.functions.text import escape_html, escape_js, is_resource_key, sanitize


def dedup_styles(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """sections(render_id, ord, dict_id, body) with ``body`` freed of style tags and ``head``: tags not seen earlier in the render.

    Other columns are kept on request, so that bodies need not be moved again to meet them.

    First wins per (render, dictionary, tag): a window over the exploded tags, keyed by their fingerprint, hence spread out.
    """
    s = sections.withColumn("_s", split_styles(sanitize("body")))
    tags = s.select("render_id", "ord", "dict_id", F.posexplode("_s.styles").alias("pos", "tag")).withColumn("key", style_fingerprint("tag"))
    first = Window.partitionBy("render_id", "dict_id", "key").orderBy("ord", "pos")
    kept = tags.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    head = kept.groupBy("render_id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    head = head.select("render_id", "ord", F.array_join(F.transform("t", lambda x: x["tag"]), "").alias("head"))
    return s.join(head, ["render_id", "ord"], "left").select("render_id", "ord", "dict_id", *keep, F.col("_s.body").alias("body"), F.coalesce("head", F.lit("")).alias("head"))


def render_aggregate(sections: DataFrame) -> DataFrame:
    """render_id, hit_count, html of sections(render_id, word, ord, dict_id, title, body), numbered in order."""
    s = dedup_styles(sections, ("word", "title")).withColumnRenamed("body", "_body")
    piece = F.concat(
        F.lit('<section class="dict-section" data-dict-id="'), escape_html("dict_id"), F.lit('"><h2>'), escape_html(F.coalesce("title", F.lit(""))),
        F.lit("</h2>"), F.coalesce("head", F.lit("")), F.lit('<div class="dict-body">'), F.coalesce("_body", F.lit("")), F.lit("</div></section>"),
    )
    got = s.groupBy("render_id", "word").agg(F.count(F.lit(1)).alias("hit_count"), F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))).alias("ps"))
    html = F.concat(
        F.lit('<main data-word="'), escape_html("word"), F.lit('"><p>'), F.col("hit_count").cast("string"), F.lit("</p>"),
        F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</main>"),
    )
    return got.select("render_id", "word", "hit_count", html.alias("html"))


RESET = "<style>html,body{margin:0;padding:0;overflow:hidden}</style>"
LAST_STYLE = '<link rel="stylesheet" type="text/css" href="/article-style.css">'
#: Tells the page around a frame its height and the links clicked in it; the dictionary's id stands between the two halves.
BRIDGE = (
    '<script>(()=>{const id="',
    '";const tell=m=>parent.postMessage(Object.assign({dictId:id},m),"*");const box=document.querySelector(".dict-scope");'
    "const grown=()=>tell({height:Math.ceil(box.scrollHeight)});new ResizeObserver(grown).observe(box);addEventListener('load',grown);"
    "addEventListener('click',e=>{const a=e.target.closest('a[href]');if(a&&/^(sound:|entry:|\\/)/.test(a.getAttribute('href')))"
    "{e.preventDefault();tell({href:a.getAttribute('href')})}})})()</script>",
)


def frame_pages(sections: DataFrame) -> DataFrame:
    """render_id, ord, frame: each section as a document of its own in the ``srcdoc`` of a sandboxed frame.

    sections: render_id, ord, dict_id, body, extra_css, extra_js. In the head stand a reset, the dictionary's own styles (each once in a
    render), its extra styles and the sheet that comes last; in the body the entry within its dictionary's scope, extra script and bridge.
    """
    s = dedup_styles(sections, ("extra_css", "extra_js")).withColumnRenamed("body", "_body")
    id_ = escape_html(F.coalesce("dict_id", F.lit("")))
    block = lambda tag, c: F.when(F.trim(c) != "", F.concat(F.lit(f"<{tag}>"), F.col(c), F.lit(f"</{tag}>"))).otherwise("")
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1">' + RESET), "head", block("style", "extra_css"),
        F.lit(LAST_STYLE + '</head><body><div class="dict-scope" data-dict-id="'), id_, F.lit('"><div class="dict-body">'), F.coalesce("_body", F.lit("")), F.lit("</div></div>"),
        block("script", "extra_js"), F.lit(BRIDGE[0]), escape_js(F.coalesce("dict_id", F.lit(""))), F.lit(BRIDGE[1] + "</body></html>"),
    )
    frame = F.concat(F.lit('<iframe class="dict-frame" data-dict-id="'), id_, F.lit('" srcdoc="'), escape_html(page), F.lit('" loading="lazy" sandbox="allow-scripts allow-popups allow-forms"></iframe>'))
    return s.select("render_id", "ord", frame.alias("frame"))


def first_audio(sections: DataFrame) -> DataFrame:
    """render_id, audio: the first sound of a render's sections, in order."""
    s = sections.select("render_id", "ord", section_meta("body", "dict_id")["audio"].alias("audio")).where("audio is not null")
    return s.groupBy("render_id").agg(F.min_by("audio", "ord").alias("audio"))


def json_payload(sections: DataFrame) -> DataFrame:
    """render_id, payload: word, matched, hit_count and the metadata of each section, as JSON; resource keys are no words."""
    s = sections.where(~F.coalesce(is_resource_key("word"), F.lit(False))).withColumn("meta", section_meta("body", "dict_id"))
    one = F.struct("ord", F.struct("dict_id", "title", "meta.headword", "meta.phonetics", "meta.audio", "meta.entries", "meta.sense_count").alias("s"))
    got = s.groupBy("render_id", "word").agg(F.count(F.lit(1)).alias("hit_count"), F.sort_array(F.collect_list(F.struct("ord", F.to_json(one["s"]).alias("j")))).alias("ss"), F.min_by("matched", "ord").alias("matched"))
    body = F.concat(
        F.lit('{"word":'), F.to_json(F.array("word")).substr(F.lit(2), F.length(F.to_json(F.array("word"))) - 2), F.lit(',"hit_count":'), F.col("hit_count").cast("string"),
        F.lit(',"sections":['), F.array_join(F.transform("ss", lambda x: x["j"]), ","), F.lit("]}"),
    )
    return got.select("render_id", "word", "matched", "hit_count", body.alias("payload"))
