"""From a typed word to what is shown, building indexes, and state over time."""

import random

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import entries as E
from lexloom.operators import lookup as K
from lexloom.operators import render as R
from lexloom.operators import state as S
from lexloom.sources import build as B
from lexloom.sources import container, files
from lexloom.streaming import changes

INDEX = [("d", 1, "go", "go"), ("d", 2, "went", "went"), ("d", 3, "a", "a"), ("d", 4, "b", "b"), ("e", 5, "went", "went"), ("e", 6, "Go", "go"), ("d", 7, "empty", "empty"), ("d", 8, "/css/a.css", None)]
BODIES = [("d", 1, b"<b>go</b> \xff"), ("d", 2, b"@@@LINK=go\r\n"), ("d", 3, b"@@@LINK=b"), ("d", 4, b"@@@LINK=a"), ("e", 5, b"own"), ("e", 6, b"Go of e"), ("d", 1, b"<b>go</b> \xff")]


def frames(spark):
    index = spark.createDataFrame(INDEX, "dict_id string, id long, text string, normalized string")
    bodies = spark.createDataFrame(BODIES, "dict_id string, id long, body binary")
    catalog = spark.createDataFrame([("d", 1, "D"), ("e", 2, None)], "dict_id string, ord int, title string")
    return index, bodies, catalog


def test_entries(spark):
    index, bodies, catalog = frames(spark)
    words = spark.createDataFrame([("went",), ("a",), ("empty",), ("nothing",), (None,), ("goes",), ("went",)], "word string")
    got = {(r["word"], r["dict_id"]): (r["matched"], r["hops"], r["body"], r["status"]) for r in E.entry_query(words, index, bodies).collect()}
    assert got["went", "d"] == ("go", 1, "<b>go</b> �", "ok") and got["went", "e"] == ("went", 0, "own", "ok") and got["goes", "d"][:2] == ("goes", 0)
    assert got["a", "d"][3] == "too_many_redirects" and {w for w, _ in got} == {"went", "a", "goes"}
    first = {r["word"]: (r["dict_id"], r["matched"], r["hops"], r["status"]) for r in E.first_query(words, index, bodies, catalog).collect()}
    assert first["went"] == ("d", "go", 1, "ok") and first["a"][3] == "too_many_redirects" and "nothing" not in first
    pages = {r["word"]: (r["hit_count"], r["html"]) for r in E.aggregate_query(words, index, bodies, catalog).collect()}
    assert pages["went"][0] == 2 and pages["went"][1].index("<h2>D</h2>") < pages["went"][1].index("own") and "a" not in pages
    assert E.aggregate_query(words, index, bodies, catalog, ["e"]).count() == 2
    assert E.entry_query(words.limit(0), index, bodies).count() == 0


def test_resources(spark):
    sources = spark.createDataFrame([("mdd", 0, "\\img\\a.png", 5), ("mdd", 0, "/big.png", (32 << 20) + 1), ("folder", 2, "img/a.png", 5), ("static", 4, "index.html", 1), ("static", 4, "big.png", 1)], "source string, rank int, key string, size long")
    paths = spark.createDataFrame([("/img/a.png",), ("big.png",), ("../x",), ("index.html",), ("none",), (None,), ("/go",)], "path string")
    got = {r["path"]: (r["source"], r["content_type"]) for r in E.resource_query(paths, sources).collect()}
    assert got == {"/img/a.png": ("mdd", "image/png"), "big.png": ("static", "image/png"), "index.html": ("static", "text/html")}
    index, bodies, catalog = frames(spark)
    got = {r["path"]: (r["source"], r["key"]) for r in E.path_query(paths, sources, index, bodies, catalog).collect()}
    assert got["/go"] == ("entry", "d") and got["index.html"][0] == "static" and "none" not in got


def test_frames(spark):
    body = "<style>a{}</style><p onclick='x()'>t</p>"
    s = spark.createDataFrame([("r", 1, 'd"1', body, " ", "f()"), ("r", 2, 'd"1', body, "b{}", None), ("r", 3, "e", None, None, None)], "render_id string, ord long, dict_id string, body string, extra_css string, extra_js string")
    got = {r["ord"]: r["frame"] for r in R.frame_pages(s).collect()}
    import html

    inner = {k: html.unescape(v.split('srcdoc="', 1)[1].split('"', 1)[0]) for k, v in got.items()}
    assert inner[1].count("<style>") == 2 and inner[2].count("<style>") == 2 and "b{}" in inner[2] and "onclick" not in inner[1] and "<script>f()</script>" in inner[1]
    assert 'const id="d\\"1"' in inner[1] and got[1].startswith('<iframe class="dict-frame" data-dict-id="d&quot;1"') and '<div class="dict-body"></div>' in inner[3]
    a = spark.createDataFrame([("r", 2, "d", '<a href="sound://b.mp3">'), ("r", 1, "d", "x"), ("r", 3, "d", '<a href="sound://c.mp3">'), ("q", 1, "d", None)], "render_id string, ord long, dict_id string, body string")
    assert [tuple(r) for r in R.first_audio(a).collect()] == [("r", "/dict/d/audio/b.mp3")]


def test_small_state(spark):
    fav = spark.createDataFrame([("Éa", 1), ("b", 2), ("a", 3), ("Z", 4)], "word string, added_at long")
    assert [r["word"] for r in S.favorites_by_word(fav).orderBy("place").collect()] == ["a", "b", "Éa", "Z"] or [r["word"] for r in S.favorites_by_word(fav).orderBy("place").collect()][0] == "a"
    assert S.favorites_clear(fav).count() == 0
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), ([], ["a"]), (["a"], ["a", "b"])], "c array<string>, k array<string>")
    assert [r[0] for r in df.select(T.enabled_filter("c", "k")).collect()] == [None, "__none__", "a"]
    paths = spark.createDataFrame([("/x/My.mdx",), ("/x/my.mdd",), ("/x/b.mdd",)], "path string")
    settings = spark.createDataFrame([("/x/My.mdx", "Mine", "cls", "a{}", None)], "path string, name string, container_class string, css string, js string")
    got = {r["name"]: r for r in S.logical_catalog(paths, settings).collect()}
    assert got["Mine"]["texts"] == got["Mine"]["resources"] == 1 and got["Mine"]["extra_css"] == "a{}" and got["b"]["primary_path"] is None
    cat = S.logical_catalog(paths, settings)
    parts = {r["dict_id"]: (r["css"], r["found"]) for r in S.custom_parts(cat, spark.createDataFrame([(got["Mine"]["dict_id"],), ("zz",)], "dict_id string")).collect()}
    assert parts == {got["Mine"]["dict_id"]: ("a{}", True), "zz": (None, False)}
    index = frames(spark)[0]
    assert K.random_seek(index, 3).first()["text"] == K.random_seek(index, 3).first()["text"]
    assert K.random_seek(index.limit(0), 1).first()["text"] in K.COMMON_WORDS and K.random_seek(index.where("id = 8"), 1).first()["text"] in K.COMMON_WORDS


def test_files_of_several_tasks(spark, tmp_path):
    words = [(f"w{i:04d}", b"x" * (i % 7)) for i in range(500)]
    for version in (1, 2):
        container.write_container(str(tmp_path / "a.mdx"), words, version, key_entries=37, block=100)
        spark.dataSource.register(container.ContainerSource)
        whole = [r[2:] for r in container.Container(str(tmp_path / "a.mdx")).rows()]
        df = spark.read.format("lexicon_container").option("task_bytes", "400").load("file://" + str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        assert [tuple(r)[2:] for r in df.orderBy("id").collect()] == whole and len(whole) > 490


def test_build_is_incremental_and_published_at_once(spark, tmp_path):
    folder, out = tmp_path / "dicts", str(tmp_path / "index")
    folder.mkdir()
    container.write_container(str(folder / "a.mdx"), [("alpha", b"1"), ("béta x", b"2")])
    container.write_container(str(folder / "a.mdd"), [("\\img.png", b"3")])
    (folder / "bad.mdx").write_bytes(b"\0\0\0\x08nonsense....")
    waited: list[float] = []
    assert B.current(out) is None and B.read_index(spark, out) is None
    meta = {r["path"].rsplit("/", 1)[1]: r for r in B.build(spark, str(folder), out, wait=waited.append).collect()}
    assert waited == [5.0, 20.0] and meta["bad.mdx"]["attempts"] == 3 and meta["bad.mdx"]["error"] and meta["a.mdx"]["rows"] == 2 and meta["a.mdx"]["has_fts"] and not meta["a.mdd"]["has_fts"]
    rows = {r["text"]: (r["normalized"], r["fts"]) for r in B.read_index(spark, out).collect()}
    assert rows == {"alpha": ("alpha", True), "béta x": ("beta x", False), "\\img.png": (None, False)}
    (folder / "bad.mdx").unlink()
    container.write_container(str(folder / "b.mdx"), [("gamma", b"1")])
    B.build(spark, str(folder), out, wait=waited.append)
    assert B.current(out) == 2 and {r["text"] for r in B.read_index(spark, out).collect()} == {"alpha", "béta x", "\\img.png", "gamma"} and len(waited) == 2
    st = {r["path"].rsplit("/", 1)[1]: r for r in B.status(spark, str(folder), out, {str(folder / "b.mdx"): False}).collect()}
    assert st["a.mdx"]["up_to_date"] and st["b.mdx"]["has_fts"] and not st["b.mdx"]["fts_enabled"] and set(st) == {"a.mdx", "b.mdx"}


def test_folders(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"12345")
    got = [tuple(r) for r in files.folder_resources(spark, str(tmp_path), "folder", 2).collect()]
    assert got == [("folder", 2, "img/a.png", 5)]
    assert files.dictionary_folder(environ={"LEXLOOM_DICTIONARIES": "/x"}) == "/x" and files.dictionary_folder(environ={})


def stream(spark, tmp_path, name, rows, schema, make):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("w", at(s), ok) for s, ok in ((0, True), (0.5, True), (0.6, False), (0.7, True), (5, True), (500, True))]
    random.Random(1).shuffle(rows)
    got = stream(spark, tmp_path, "bursts_", rows, "key string, ts timestamp, relevant boolean", changes.debounced)
    assert sorted((r["start"], r["n"]) for r in got)[:3] == [(at(0), 2), (at(0.7), 1), (at(5), 1)]
    miss = [("k", at(s), f) for s, f in ((0, False), (10, True), (25, True), (26, False), (30, True))]
    got = stream(spark, tmp_path, "misses_", miss, "key string, ts timestamp, found boolean", changes.negative_cache)
    assert [r["known_miss"] for r in sorted(got, key=lambda r: r["ts"])] == [False, True, False, False, True]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.mdx").write_bytes(b"x")
    (tmp_path / "w" / "a.db").write_bytes(b"x")
    calls: list[int] = []
    changes.watch(spark, str(tmp_path / "w"), str(tmp_path / "seen"), str(tmp_path / "wc"), lambda: calls.append(1), once=True).awaitTermination()
    assert calls == [1] and [r["path"][-5:] for r in spark.read.parquet(str(tmp_path / "seen")).select(F.col("path")).collect()] == ["a.mdx"]
