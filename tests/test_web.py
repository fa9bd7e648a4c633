
from lexloom.functions import web as W
from lexloom.functions.register import register


def test_byte_range(spark):
    df = spark.createDataFrame([("bytes=10-19", 100), ("bytes=10-", 100), ("bytes=-20", 100), ("bytes=100-200", 100), ("bytes=5-2", 100), ("bytes=0-1,3-4", 100), (None, 100), ("bytes=-0", 9), ("bytes=0-", 0)], "h string, n long")
    got = [tuple(r[0]) if r[0] else None for r in df.select(W.byte_range("h", "n")).collect()]
    assert got == [(10, 19), (10, 99), (80, 99), None, None, None, None, None, None]


def test_cache_invalidation(spark):
    keys = ["entry:dict:abc123:hello", "resource:dict:abc123:/img/a.png", "negative:entry:dict:abc123:hello", "entry:aggregate:x", "entry:dict:other:hello", "resource:dict:other:/x.png", "resource:global:x"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(W.cache_key_involves("k", ["abc123"])).collect()] == [True] * 4 + [False] * 3


def test_navigation(spark):
    cases = {"sound://a": "audio", "#x": "anchor", "entry://a#b": "entry", "http://h/dict/d/entry/w": "entry", "/dict/d/audio/x": "audio", "/dict/d/res/x": "resource", "/resource/d/x": "resource", "/word": "entry", "https://e.org": "external"}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    assert [r[0] for r in df.select(W.navigation("k", "http://h")).collect()] == list(cases.values())


def test_lru_and_budget(spark):
    c = W.ByteLru(200)
    for k in "abc":
        c.put(k, b"x" * 80)
    assert c.get("a") is None and c.get("b") and c.get("c")
    c.put("big", b"x" * 201)
    assert c.get("big") is None and c.used == 160
    df = spark.createDataFrame([(1,), (8,), (100,), (0,)], "n int")
    assert [r[0] for r in df.select(W.reader_budget("n")).collect()] == [64 << 20, 32 << 20, 8 << 20, 64 << 20]


def test_highlight_and_etag(spark):
    assert W.highlight_one('<a title="go">Go gone</a><script>go()</script>', "go") == '<a title="go"><mark>Go</mark> <mark>go</mark>ne</a><script>go()</script>'
    assert W.highlight_one("a.b", ".") == "a<mark>.</mark>b" and W.highlight_one(None, "x") is None and W.highlight_one("x", " ") == "x"
    got = spark.createDataFrame([(b"abc",), (None,)], "b binary").select(W.etag("b")).collect()
    assert got[0][0] == 'W/"3-24d0127"' and got[1][0] is None


def test_registered_names(spark):
    register(spark)
    r = spark.sql("select lex_normalize('Café—menu it''s'), lex_nocase('ÀB'), lex_strip_tags('<b>a</b>  b'), lex_redirect('@@@LINK=go\\r\\n'), lex_redirect('x'), lex_rewrite_html('<a href=\"entry://x\">', 'd')").first()
    assert list(r) == ["cafe menu it's", "Àb", "a b", "go", None, '<a href="/dict/d/entry/x">']


def test_sql_functions_equal_their_expressions(spark):
    from pyspark.sql import functions as F

    from lexloom.functions.register import NATIVE

    register(spark)
    rows = [("It's Café—menu", "b", 2.5), ("@@@LINK=go\n", "@@@", 1.0), ("/a\\b.png?x", "/a", -3.0), ("stopp", "stop", 0.0), ('%C3%A9"<x>', "é", 1.0), ("bytes=1-5", None, 1.0), (None, "x", None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    df.createOrReplaceTempView("sql_cases")
    for name, (_, make) in NATIVE.items():
        parameters = [p.split() for p in name[name.index("(") + 1 : -1].split(", ")]
        given = {"STRING": ["x", "y"], "DOUBLE": ["z", "z"], "BIGINT": ["cast(abs(z) * 10 as bigint)"] * 2, "INT": ["cast(abs(z) * 10 as int)"] * 3}
        source = [given[kind][min(i, 1)] for i, (_, kind) in enumerate(parameters)]
        want = df.select(*[F.expr(e).alias(p) for e, (p, _) in zip(source, parameters)]).select(make().alias("r")).collect()
        assert spark.sql(f"select {name.split('(')[0]}({', '.join(source)}) as r from sql_cases").collect() == want, name
