import struct

import pytest

from lexloom.sources import codecs as C
from lexloom.sources import config, container
from lexloom.streaming import changes


def test_ripemd128():
    assert C.ripemd128(b"").hex() == "cdf26213a150dc3ecb610f18f6b38b46"
    assert C.ripemd128(b"abc").hex() == "c14a12199c66e4ba84636b0f69144c77"


@pytest.mark.parametrize("data", [b"", b"a", b"hello", bytes(range(256)), b"x" * 1000])
def test_cipher_round_trip(data):
    key = b"\x01\x02\xff\x80abcd"
    assert C.decrypt(C.encrypt(data, key), key) == data


def test_lzo():
    end = b"\x11\0\0"
    assert C.lzo1x(bytes([17 + 4]) + b"abcd" + end, 4) == b"abcd"
    # four literals, then a match of length 3 at distance 4, then a long match over itself
    assert C.lzo1x(bytes([17 + 4]) + b"abcd" + bytes([(3 - 1) << 5 | (3 & 7) << 2, 0]) + end, 7) == b"abcdabc"
    assert C.lzo1x(bytes([17 + 4]) + b"abcd" + bytes([32 | 18, 3 << 2, 0]) + end, 24) == b"abcd" * 6
    assert C.lzo1x(bytes([0, 5]) + b"z" * 23 + end, 23) == b"z" * 23
    for bad in (b"\x15abcd", bytes([17 + 4]) + b"abcd" + bytes([0x40, 9]) + end):
        with pytest.raises((C.Corrupt, IndexError)):
            C.lzo1x(bad, 7)


WORDS = [("alpha", b"<b>alpha</b>"), ("béta", b"@@@LINK=alpha"), ("gamma", b"x" * 300), ("你好", b"")]


@pytest.mark.parametrize(("version", "encoding", "encrypted", "kind"), [(1, "UTF-8", 0, 2), (1, "UTF-16", 0, 0), (2, "UTF-8", 2, 2), (2, "UTF-16", 0, 2), (2, "GBK", 0, 0)])
def test_container_round_trip(spark, tmp_path, version, encoding, encrypted, kind):
    path = str(tmp_path / "a.mdx")
    words = [w for w in WORDS if encoding != "GBK" or w[0] != "béta"]
    container.write_container(path, words, version, encoding, encrypted, block=1000, kind=kind)
    (tmp_path / "bad.mdx").write_bytes(b"\0\0\0\x08nonsense....")
    (tmp_path / "._x.mdx").write_bytes(b"")
    spark.dataSource.register(container.ContainerSource)
    df = spark.read.format("lexicon_container").load(str(tmp_path))
    got = df.where("error is null").orderBy("id").collect()
    assert [r["text"] for r in got] == [w for w, b in words if w != "你好"]  # the last, empty, lies past the last block
    assert df.where("error is not null").count() == 1
    bodies = {r["id"]: bytes(r["body"]) for r in container.read_records(df).collect()}
    assert [bodies[r["id"]] for r in got] == [b for w, b in words if b]


def test_record_locations_clamp(tmp_path):
    path = str(tmp_path / "a.mdx")
    container.write_container(path, [("a", b"1" * 6), ("b", b"2" * 8), ("c", b"3" * 4)], block=10)
    got = [(r[3], r[4], r[5]) for r in container.Container(path).rows()]
    assert got == [("a", 0, 6), ("b", 6, 4), ("c", 4, 4)]


def test_header_cases():
    raw = '<D generatedbyengineversion="3.1" encoding="UTF-8"/>'.encode("utf-16-le")
    import zlib

    blob = struct.pack(">I", len(raw)) + raw + struct.pack("<I", zlib.adler32(raw))
    h = container.parse_header(blob)
    assert (h.version, h.encrypted, h.encoding) == (2, "No", "UTF-8")
    with pytest.raises(C.Corrupt):
        container.parse_header(blob[:-1] + b"\0")


def test_config(spark, tmp_path):
    (tmp_path / "a.toml").write_text('name = "A"\ncss = "@a.css"\njs = "@../x"\nfts = false\n')
    (tmp_path / "a.css").write_text("p{}")
    (tmp_path / "b.toml").write_text("= broken")
    got = config.load(str(tmp_path / "a.mdx"))
    assert (got["name"], got["css"], got["js"], got["fts"], got["fts_tokenizer"]) == ("A", "p{}", None, False, "unicode61")
    assert config.load(str(tmp_path / "b.mdx")) is None and config.load(str(tmp_path / "c.mdx")) is None
    assert config.configs(spark, [str(tmp_path / "a.mdx"), str(tmp_path / "b.mdx")]).count() == 1


def test_stream_bursts_and_cache(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("k", float(t), 20.0) for t in (0, 5, 19, 25, 60)] + [("j", 3.0, 20.0)]
    df = spark.createDataFrame(rows, "key string, t double, ttl double").select("key", F.timestamp_seconds("t").alias("ts"), "ttl")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.ttl_cache(stream).writeStream.format("memory").queryName("cache").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["hit"] for r in spark.sql("select * from cache where key = 'k' order by ts").collect()]
    assert got == [False, True, True, False, False]
    q = changes.bursts(stream, "ts", "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from bursts").count() >= 4
    assert changes.relevant(spark.createDataFrame([("a.MDX",), ("a.db",), (None,)], "path string")).count() == 1
    changes.ingest(spark, str(tmp_path / "in"), "key string, ts timestamp, ttl double", str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("key"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
