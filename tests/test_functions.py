import pytest
from pyspark.sql import functions as F

from lexloom.functions import html as H
from lexloom.functions import links as L
from lexloom.functions import normalize as N
from lexloom.functions import text as T


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    return [r["x"] for r in df.select("i", make(F.col("w")).alias("x")).orderBy("i").collect()]


def test_canonical_normalize(spark):
    got = column(spark, ["Café—menu", "CAFE MENU", "naïve", "it's", "  Hello,World  ", "", "...", None], N.canonical_normalize)
    assert got == ["cafe menu", "cafe menu", "naive", "it's", "hello world", "", "", None]


def test_prefix_upper():
    assert [N.prefix_upper(x) for x in ("cafe", "a", "", "\U0010ffff", "퟿")] == ["caff", "b", None, None, None]


def test_query_candidates(spark):
    got = column(spark, [" Running ", "Café—menu", "went", None, "  "], N.query_candidates)
    assert {"Running", "running", "run"} <= set(got[0]) and got[0][0] == "Running"
    assert {"café-menu", "cafe-menu", "cafe menu"} <= set(got[1])
    assert "go" in got[2] and got[3] == [] and got[4] == []


def test_lemmas(spark):
    got = column(spark, ["categories", "wolves", "stopped", "bigger", "mice", "two words", "naïve"], N.lemma_candidates)
    assert "category" in got[0] and {"wolf", "wolfe"} <= set(got[1]) and "stop" in got[2] and "bigg" in got[3] and "mouse" in got[4]
    assert got[5] == [] and got[6] == []


def test_lookup_key_has_no_final_sigma(spark):
    assert column(spark, ["ΟΔΟΣ", "a\tb", "l’eau – x", "a　 b"], N.lookup_key) == ["οδοσ", "ab", "l'eau - x", "a b"]


def test_admission(spark):
    assert column(spark, ["hello", "\\path\\to", "12monkeys", "a@b", "", None], T.is_fts_admitted) == [True, False, False, False, False, None]


def test_redirect_target(spark):
    values = ["@@@LINK=go\r\n\0", "﻿@@@LINK= a b \n<p>x", "@@@LINK=", "x @@@LINK=y", "", None, "@@@LINK=\x01a"]
    assert column(spark, values, L.redirect_target) == ["go", "a b", None, None, None, None, "a"]


@pytest.mark.parametrize(
    ("attr", "value", "kind"),
    [
        ("href", "entry://a?b", "entry"), ("href", "entry://#A", "fragment"), ("href", "sound://a.mp3", "audio"), ("href", "https://x", "external"),
        ("href", "#top", "external"), ("href", "word", "entry"), ("href", "/css/a.css", "resource"), ("href", "/word", "entry"), ("src", "word", "resource"),
        ("href", "a/b", "resource"), ("href", "x.png", "resource"), ("href", "", "none"),
    ],
)
def test_link_kind(spark, attr, value, kind):
    df = spark.createDataFrame([(attr, value)], "a string, v string")
    assert df.select(L.link_kind("a", "v")).first()[0] == kind


def test_entry_target_undoes_escapes(spark):
    values = ["entry://it&#x27;s?x", "entry://%C3%A9t%C3%A9#A_1", "entry://a%zz", "a&amp;b", "x.css", None]
    df = spark.createDataFrame([(i, "href", v) for i, v in enumerate(values)], "i int, a string, v string")
    assert [r["t"] for r in L.with_entry_target(df, "a", "v", "t").orderBy("i").collect()] == ["it's", "été", "a%zz", "a&b", None, None]


def test_percent_encode(spark):
    assert column(spark, ["hello world-_.*", "é"], L.percent_encode) == ["hello%20world%2D%5F%2E%2A", "%C3%A9"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a href="sound://uk/us.mp3">', 'href="/dict/d1/audio/uk/us.mp3"'), ('<a href="entry://hello world">', 'href="/dict/d1/entry/hello%20world"'),
        ('<a href="entry://#A_1">', 'href="#A_1"'), ('<a href="entry://weather#A_2">', 'href="/dict/d1/entry/weather#A_2"'),
        ('<a data-href="serendipity">', 'data-href="/dict/d1/entry/serendipity"'), ('<img src="\\img\\foo.png">', 'src="/dict/d1/res/img/foo.png"'),
        ('<use xlink:href="a.svg"/>', 'xlink:href="/dict/d1/res/a.svg"'), ('<use xlink:href="#icon"/>', 'xlink:href="#icon"'), ('<img src="data:x">', 'src="data:x"'),
        ('<img srcset="img/lo.png 480w, img/hi.png 1080w">', 'srcset="/dict/d1/res/img/lo.png 480w, /dict/d1/res/img/hi.png 1080w"'),
        ("<style>a{background:url(x.png)}</style>", "url(/dict/d1/res/x.png)"), ("<p style=\"background:url('y.png')\">", "url(/dict/d1/res/y.png)"),
        ('<style>a{b:url("z.png")}</style>', "b:url(/dict/d1/res/z.png)"), ("<style>a{b:url(a b.png)}</style>", "url(a b.png)"), ("<p style='b:url(\"https://x/y.png\")'>", 'url("https://x/y.png")'),
        ('<img srcset="https://x/a.png   1x, b.png 2x">', 'srcset="https://x/a.png   1x, /dict/d1/res/b.png 2x"'), ("<script>a('<img src=\"x.png\">')</script>", 'src="x.png"'), ("<!-- <a href=\"w\"> -->", 'href="w"'),
    ],
)
def test_rewrite(html, want):
    assert want in H.rewrite_one(html, "d1")


def test_scope_css():
    s = H.scope_selector("d1")
    assert H.scope_one("a, .b{x:1}", s) == f"{s} a, {s} .b {{x:1}}"
    assert H.scope_one(":root{--x:1}", s).startswith(s + " {")
    assert f"{s} p" in H.scope_one("@media print{p{x:1}}", s)
    assert H.scope_one("@font-face{font-family:x}", s) == "@font-face{font-family:x}"
    assert H.scope_one(":not(.b, .c), .d{x:1}", s) == f"{s} :not(.b, .c), {s} .d {{x:1}}"
    assert H.scope_one("@charset 'x';a{content:'}'}", s).count(s) == 1
    assert H.scope_one("a{x:1", s) == "a{x:1" and H.scope_one("", s) == "" and H.scope_one(None, s) is None


def test_meta():
    m = H.meta_one('<span class="hwd">go</span><span class="pron">ɡəʊ</span><span class="PRON">/goʊ/</span><a href="sound://hwd/uk/go.mp3"><a href="sound://hwd/ame/go1.mp3">', "d")
    assert (m["headword"], m["phonetics"], m["audio"]) == ("go", ["/ɡəʊ/", "/goʊ/"], "/dict/d/audio/hwd/ame/go1.mp3")
    m = H.meta_one('<a name="L_go_1"></a><span class="entry"><span class="hwd">go</span></span><li class="sense"><li class="sense x">', "d")
    assert m["entries"] == [{"id": "L_go_1", "label": "go"}] and m["sense_count"] == 2
    m = H.meta_one('<div class="chwd"><a href="#A_1">verb</a><a href="#B">noun</a></div><p id="A_1">', "d")
    assert m["entries"] == [{"id": "A_1", "label": "verb"}]
    assert H.meta_one(None, "d")["entries"] == [] and H.meta_one('<a href="entry://x">see</a>', "d")["headword"] == "see"


def test_meta_cases():
    two = '<span class="entry" id="LDOCE6_go_1"><a href="entry://go">go</a><p class="sense"></span><span id="LDOCE6_go_2" class="entry"><p class="sense sensenum"><p class="sensenum"></span>'
    m = H.meta_one(two, "d")
    assert [e["id"] for e in m["entries"]] == ["LDOCE6_go_1", "LDOCE6_go_2"] and m["entries"][0]["label"] == "go" and m["entries"][1]["label"] == "go 2" and m["sense_count"] == 2
    m = H.meta_one('<div class="entry" id="x_1"></div><div class="entry" id="x_1"></div><a href="/dict/d/audio/uk/go.mp3">', "d")
    assert m["entries"] == [{"id": "x_1", "label": "x 1"}] and m["audio"] == "/dict/d/audio/uk/go.mp3"
    assert H.meta_one("<" * 1000 + "<a class=", "d")["headword"] == "" and H.meta_one("", "d")["entries"] == []


def test_style_split():
    same = '<link rel="alternate stylesheet" href="/t.css">'
    assert H.style_key(same) == H.style_key("<LINK href='/t.css' rel='stylesheet'>") == "link:/t.css" and H.style_key("<link rel=icon href=x>") is None
    got = H.split_one(same + "<p>a</p><style type='x'>a>b{c:'</p>'}</style>b<link rel=icon href=x><style>open")
    assert got == {"body": "<p>a</p>b<link rel=icon href=x><style>open", "styles": ["<style type='x'>a>b{c:'</p>'}</style>", same]}


def test_sanitize_and_escape(spark):
    assert column(spark, ['<p onclick="x()">a<a href="javascript:y">', None], T.sanitize) == ["<p>a<a >", None]
    assert column(spark, ["<a href=\"x\">&'"], T.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]


def test_relevance_saturates(spark):
    df = spark.createDataFrame([("a", "a", -1e18), ("ab", "a", 1e18)], "w string, p string, s double")
    got = [r[0] for r in df.select(T.relevance("w", "p", F.col("s"))).collect()]
    assert got[0] == 2147481179 and got[1] < -2147479000
