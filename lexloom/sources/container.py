"""Dictionary container files (.mdx text, .mdd resources) as a Spark data source, and a writer for small ones.

    spark.dataSource.register(ContainerSource)
    spark.read.format("lexicon_container").load("/folder")        # index rows, as many input partitions as key blocks need

Paths are local, or of any file system with a scheme that the Arrow library knows (hdfs://, s3://). A file that cannot be read is one row with ``error`` set; it never fails the job. Record bodies are read per block with
``read_records``: every block is fetched and decompressed once, whatever the number of records asked of it.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.sources.codecs import Corrupt, decrypt, encrypt, lzo1x, ripemd128

MAX_INFO, MAX_BLOCK = 64 << 20, 256 << 20
SCHEMA = "path string, kind string, id long, text string, record_offset long, record_length long, block_offset long, block_size long, block_dsize long, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_attribute = re.compile(r'(\w+)="((?:.|\r\n|[\r\n])*?)"')


@dataclass
class Header:
    attributes: dict[str, str]
    version: int
    encrypted: str
    encoding: str
    size: int


def parse_header(data: bytes) -> Header:
    """Attributes with lower-case names; the checksum must hold."""
    if len(data) < 8:
        raise Corrupt("header: too short")
    (n,) = struct.unpack(">I", data[:4])
    raw = data[4 : 4 + n]
    if len(raw) != n or len(data) < 8 + n:
        raise Corrupt("header: out of bounds")
    if zlib.adler32(raw) != struct.unpack("<I", data[4 + n : 8 + n])[0]:
        raise Corrupt("header: checksum")
    found = {k.lower(): v for k, v in _attribute.findall(raw.decode("utf-16-le", "replace"))}
    if "generatedbyengineversion" not in found:
        raise Corrupt("header: no version")
    digit = found["generatedbyengineversion"][:1]
    if not digit.isdigit() or digit == "0":
        raise Corrupt(f"header: version {found['generatedbyengineversion']}")
    return Header(found, min(int(digit), 2), found.get("encrypted", "No"), found.get("encoding", ""), 8 + n)


def decode_block(data: bytes, size: int) -> bytes:
    """A key or record block: 4 bytes of flags, 4 of checksum, then the content, raw, LZO or zlib, perhaps encrypted."""
    if size > MAX_BLOCK:
        raise Corrupt("block: too large")
    if len(data) < 8:
        raise Corrupt("block: too short")
    (flags,) = struct.unpack("<I", data[:4])
    body = data[8:]
    cipher = flags >> 4 & 15
    if cipher == 1:
        body = decrypt(body, ripemd128(data[4:8]))
    elif cipher:
        raise Corrupt(f"block: cipher {cipher}")
    kind = flags & 15
    if kind == 0:
        out = body
    elif kind == 1:
        out = lzo1x(body, size)
    elif kind == 2:
        d = zlib.decompressobj()
        try:
            out = d.decompress(body, size + 1)
        except zlib.error as e:
            raise Corrupt(f"block: {e}") from e
    else:
        raise Corrupt(f"block: compression {kind}")
    if len(out) != size:
        raise Corrupt(f"block: {len(out)} bytes instead of {size}")
    return out


def headword(raw: bytes, encoding: str) -> str:
    name = encoding.strip().lower()
    if name in ("utf-16", "utf16", "utf-16le"):
        return raw.decode("utf-16-le", "ignore")
    try:
        return raw.decode("utf-8", "replace") if name in ("utf-8", "utf8") else raw.decode(name, "ignore")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _local(path: str) -> str | None:
    """A path of this machine's file system (or one mounted in it); None for one of another file system."""
    if path.startswith("file:"):
        return re.sub("^file:(?://)?", "", path)
    return None if re.match(r"[a-z][a-z0-9+.-]*://", path, re.I) else os.path.abspath(path)


def _remote(path: str):
    """File system and path in it; its library is only loaded where it is needed, as it starts threads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    here = _local(path)
    if here is not None:
        return open(here, "rb")
    system, inner = _remote(path)
    return system.open_input_file(inner)


def exists(path: str) -> bool:
    here = _local(path)
    if here is not None:
        return os.path.exists(here)
    system, inner = _remote(path)
    return system.get_file_info(inner).type.name != "NotFound"


def read_text(path: str) -> str:
    with open_file(path) as f:
        return f.read().decode()


def write_bytes(path: str, data: bytes) -> None:
    """A file with its folders, complete under its name or not there."""
    here = _local(path)
    if here is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(here + ".part", "wb") as f:
            f.write(data)
        os.replace(here + ".part", here)
        return
    system, inner = _remote(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner + ".part") as f:
        f.write(data)
    system.move(inner + ".part", inner)


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


class Container:
    """Index of one file: key entries and record blocks, with nothing of the records read.

    ``first`` and ``after`` choose some of the key blocks; the entry that follows them is read too, as it ends the last of theirs.
    """

    def __init__(self, path: str, first: int = 0, after: int | None = None) -> None:
        self.path = path
        with open_file(path) as f:
            head = f.read(4)
            (n,) = struct.unpack(">I", head.ljust(4, b"\0"))
            self.header = parse_header(head + f.read(n + 4))
            self.wide = self.header.version == 2
            self.encoding = self.header.encoding or "utf-16"
            self.width = 2 if self.encoding.lower() in ("utf-16", "utf16", "utf-16le") else 1
            self.key_blocks = self._key_blocks(f)
            after = len(self.key_blocks) if after is None else min(after, len(self.key_blocks))
            at = f.tell()
            self.entries = []
            self.before = sum(n for _, _, n in self.key_blocks[:first])
            self.own = sum(n for _, _, n in self.key_blocks[first:after])
            for k, (csize, dsize, _) in enumerate(self.key_blocks):
                if first <= k < after or (k == after and after > first):
                    f.seek(at)
                    self.entries += self._items(decode_block(f.read(csize), dsize))
                at += csize
            f.seek(at)
            self._record_blocks(f)

    def _numbers(self, f, n: int) -> tuple[int, ...]:
        raw = f.read(n * (8 if self.wide else 4))
        if len(raw) != n * (8 if self.wide else 4):
            raise Corrupt("numbers: out of bounds")
        return struct.unpack(f">{n}{'Q' if self.wide else 'I'}", raw)

    def _key_blocks(self, f) -> list[tuple[int, int, int]]:
        """(stored size, size, entries) of every key block."""
        if self.wide:
            raw = f.read(44)
            if len(raw) != 44 or zlib.adler32(raw[:40]) != struct.unpack(">I", raw[40:])[0]:
                raise Corrupt("key header: checksum")
            count, _, info_size, csize, _ = struct.unpack(">5Q", raw[:40])
            data = f.read(csize)
            if data[:4] != b"\x02\0\0\0" or info_size > MAX_INFO:
                raise Corrupt("key info: form or size")
            if self.header.encrypted in ("2", "3"):
                data = data[:8] + decrypt(data[8:], ripemd128(data[4:8] + struct.pack("<I", 0x3695)))
            elif self.header.encrypted not in ("0", "1", "No", ""):
                raise Corrupt(f"key info: encryption {self.header.encrypted}")
            info = decode_block(b"\x02\0\0\0" + data[4:8] + data[8:], info_size)
        else:
            count, _, csize, _ = self._numbers(f, 4)
            info = f.read(csize)
        out, i = [], 0
        num, size = ("Q", 8) if self.wide else ("I", 4)
        for _ in range(count):
            (entries,) = struct.unpack_from(f">{num}", info, i)
            i += size
            for _ in (0, 1):  # first and last headword of the block
                (n,) = struct.unpack_from(">H" if self.wide else ">B", info, i)
                i += (2 if self.wide else 1) + (n + 1 if self.wide else n) * self.width
            out.append((*struct.unpack_from(f">2{num}", info, i), entries))
            i += 2 * size
        if i != len(info):
            raise Corrupt("key info: trailing bytes")
        return out

    def _items(self, data: bytes) -> Iterator[tuple[int, str]]:
        i, size = 0, 8 if self.wide else 4
        end = b"\0" * self.width
        while i + size <= len(data):
            (off,) = struct.unpack_from(">Q" if self.wide else ">I", data, i)
            i += size
            j = data.find(end, i)
            while self.width == 2 and j >= 0 and (j - i) % 2:
                j = data.find(end, j + 1)
            stop = j if j >= 0 else len(data)
            yield off, headword(data[i:stop], self.encoding)
            i = stop + self.width

    def _record_blocks(self, f) -> None:
        count, _, info, _ = self._numbers(f, 4)
        if info != count * (16 if self.wide else 8):
            raise Corrupt("record info: size")
        sizes = self._numbers(f, 2 * count)
        base, at, total = f.tell(), 0, 0
        self.blocks: list[tuple[int, int, int, int]] = []  # start in the text, file offset, stored size, size
        for c, d in zip(sizes[::2], sizes[1::2]):
            self.blocks.append((total, base + at, c, d))
            at, total = at + c, total + d

    def rows(self) -> Iterator[tuple]:
        """Index rows: a merge of entries and blocks, both in order; a record ends where the next begins, or with its block."""
        kind = "mdd" if self.path.lower().endswith(".mdd") else "mdx"
        starts = [b[0] for b in self.blocks]
        whole = self.before == 0 and self.own >= len(self.entries)  # what the info says is not trusted where it does not matter
        for k, (off, text) in enumerate(self.entries if whole else self.entries[: self.own]):
            b = bisect_right(starts, off) - 1
            if b < 0 or off >= self.blocks[b][0] + self.blocks[b][3]:
                continue  # beyond the last block
            start, where, csize, dsize = self.blocks[b]
            end = self.entries[k + 1][0] if k + 1 < len(self.entries) else start + dsize
            length = min(end, start + dsize) - off
            if length < 0:
                raise Corrupt("entries: out of order")
            yield (self.path, kind, self.before + k + 1, text, off - start, length, where, csize, dsize, None)


def sizes(folder: str) -> list[tuple[str, int, int]]:
    """(path, size, time in seconds) of the container files of a folder, not of its folders: texts before resources, by path.

    macOS companions are left out; a path of a file is that file.
    """
    here = _local(folder)
    if here is not None:
        names = [here] if os.path.isfile(here) else [os.path.join(here, n) for n in os.listdir(here)]
        found = [(os.path.realpath(p), st.st_size, int(st.st_mtime), p == here) for p in names if os.path.isfile(p) for st in [os.stat(p)]]
    else:
        from pyarrow import fs

        system, inner = _remote(folder)
        info = system.get_file_info(inner)
        scheme = folder.split(":", 1)[0] + "://"
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        found = [(scheme + i.path, i.size, int(i.mtime.timestamp()) if i.mtime else 0, i is info) for i in infos if i.type == fs.FileType.File]
    base = lambda p: p.rsplit("/", 1)[-1]
    rows = [(p, size, at) for p, size, at, named in found if named or (p.lower().endswith((".mdx", ".mdd")) and not base(p).startswith("._"))]
    return sorted(rows, key=lambda r: (r[0].lower().endswith(".mdd"), r[0]))


def scan_folder(folder: str) -> list[str]:
    return [p for p, _, _ in sizes(folder)]


#: Stored bytes of key blocks a task reads.
TASK_BYTES = 32 << 20


class _File(InputPartition):
    def __init__(self, path: str, first: int = 0, after: int | None = None) -> None:
        self.path, self.first, self.after = path, first, after


FAILURES = (Corrupt, struct.error, OSError, IndexError)


def kind_of(e: Exception) -> str:
    """The kind of a failure, as data: checksum, version, encryption, size, decompression, bounds, input."""
    text = str(e).lower()
    if isinstance(e, OSError):
        return "io"
    if isinstance(e, (struct.error, IndexError)):
        return "out_of_bounds"
    for sign, kind in (("checksum", "checksum"), ("version", "version"), ("encrypt", "encryption"), ("bounds", "out_of_bounds"), ("large", "too_large"), ("size", "too_large"), ("compress", "decompress")):
        if sign in text:
            return kind
    return "corrupt"


class _Reader(DataSourceReader):
    """A file is read by as many tasks as its key blocks need; a file that cannot be read is one row with its error."""

    def __init__(self, folder: str, task_bytes: int) -> None:
        self.folder, self.task_bytes = folder, task_bytes

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in scan_folder(self.folder):
            try:
                blocks = Container(path, 0, 0).key_blocks
            except FAILURES:
                out.append(_File(path))
                continue
            first = size = 0
            for k, (csize, _, _) in enumerate(blocks):
                if k > first and size + csize > self.task_bytes:
                    out.append(_File(path, first, k))
                    first, size = k, 0
                size += csize
            out.append(_File(path, first, len(blocks)))
        return out or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        try:
            for r in Container(partition.path, partition.first, partition.after).rows():
                rows.append(r)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        except FAILURES as e:
            rows.append((partition.path, None, None, None, None, None, None, None, None, f"{kind_of(e)}: {type(e).__name__}: {e}"))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=COLUMNS)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexicon_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def read_records(index: DataFrame) -> DataFrame:
    """path, id, body BINARY of index rows: rows of a block meet, and the block is decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        data = b""
        for b in batches:
            out = []
            for path, _id, where, csize, dsize, off, n in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (path, where) != held:
                    try:
                        with open_file(path) as f:
                            f.seek(where)
                            data = decode_block(f.read(csize), dsize)
                    except (Corrupt, OSError):
                        data = None
                    held = (path, where)
                out.append(None if data is None else data[off : off + n])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["path", "id", "body"])

    cols = ["path", "id", "block_offset", "block_size", "block_dsize", "record_offset", "record_length"]
    rows = index.where("error is null").select(*cols).repartition("path", "block_offset").sortWithinPartitions("path", "block_offset")
    return rows.mapInArrow(run, "path string, id long, body binary")


def _pack(data: bytes, kind: int = 2) -> bytes:
    body = zlib.compress(data) if kind == 2 else data
    return struct.pack("<I", kind) + struct.pack(">I", zlib.adler32(data)) + body


def write_container(path: str, entries: list[tuple[str, bytes]], version: int = 2, encoding: str = "UTF-8", encrypted: int = 0, block: int = 4096, kind: int = 2, key_entries: int = 0) -> None:
    """A small container of (headword, body) in order; ``kind`` 0 raw or 2 zlib, ``encrypted`` 0 or 2, ``key_entries`` a key block (0: all in one)."""
    attributes = f'<Dictionary GeneratedByEngineVersion="{version}.0" Encrypted="{encrypted or "No"}" Encoding="{encoding}" />\r\n\0'.encode("utf-16-le")
    wide = version >= 2
    n, size = (">Q", 8) if wide else (">I", 4)
    enc = "utf-16-le" if encoding.lower().startswith("utf-16") else encoding
    end = b"\0\0" if enc == "utf-16-le" else b"\0"
    groups = [entries[i : i + key_entries] for i in range(0, len(entries), key_entries)] or [[]] if key_entries else [entries]
    key_blocks, info, off = [], b"", 0
    width = len(end)
    for group in groups:
        keys = b""
        for word, body in group:
            keys += struct.pack(n, off) + word.encode(enc) + end
            off += len(body)
        key_blocks.append(_pack(keys, kind))
        info += struct.pack(n, len(group))
        for word in (group[0][0], group[-1][0]) if group else ("", ""):
            raw = word.encode(enc)
            info += struct.pack(">H" if wide else ">B", len(raw) // width) + raw + (end if wide else b"")
        info += struct.pack(n, len(key_blocks[-1])) + struct.pack(n, len(keys))
    key_block = b"".join(key_blocks)
    text = b"".join(b for _, b in entries)
    blocks = [text[i : i + block] for i in range(0, len(text), block)] or [b""]
    packed = [_pack(b, kind) for b in blocks]
    f = io.BytesIO()
    f.write(struct.pack(">I", len(attributes)) + attributes + struct.pack("<I", zlib.adler32(attributes)))
    if wide:
        stored = _pack(info)
        if encrypted == 2:
            stored = stored[:8] + encrypt(stored[8:], ripemd128(stored[4:8] + struct.pack("<I", 0x3695)))
        head = struct.pack(">5Q", len(groups), len(entries), len(info), len(stored), len(key_block))
        f.write(head + struct.pack(">I", zlib.adler32(head)) + stored)
    else:
        f.write(struct.pack(">4I", len(groups), len(entries), len(info), len(key_block)) + info)
    f.write(key_block)
    fmt = ">4Q" if wide else ">4I"
    f.write(struct.pack(fmt, len(packed), len(entries), len(packed) * 2 * size, sum(map(len, packed))))
    for raw, full in zip(packed, blocks):
        f.write(struct.pack(n, len(raw)) + struct.pack(n, len(full)))
    f.write(b"".join(packed))
    write_bytes(path, f.getvalue())


def index_rows(containers: DataFrame) -> DataFrame:
    """Index rows with their normalisation; resources have none."""
    from lexloom.functions.normalize import canonical_normalize

    return containers.where("error is null").withColumn("normalized", F.when(F.col("kind") == "mdx", canonical_normalize("text")))
