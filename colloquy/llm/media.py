"""Media columns: payloads as members of archive files, behind a custom Spark data source.

`write_archive` stores each payload as an 8-bit greyscale PNG, 64 samples wide, in archive files of a shared folder: each
task streams its members into one file, followed by an index of them and a footer that finds the index. The commit
writes a manifest of the files of the tasks that succeeded, so what a lost or repeated task leaves behind is never read.

`read_archive` (format "media_archive") plans byte ranges over the archive files on the driver from names and sizes
alone. A range reads the members that begin in it, one by one, and hands them on as Arrow batches of at most
`BATCH_BYTES`. Each member is read by its offset and retried on its own; one that can't be read or whose checksum is
wrong after all tries becomes a row with an error and no media, and the others are unaffected.

Defined cases: a null text is an empty one; an empty payload is 64 zero bytes; null ids and repeated rows are members of
their own; very long texts are one member (up to 2^31 rows of 64 samples); an empty table is an archive without members;
other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_folder

WIDTH = 64
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
SCHEMA = "doc_id long, n_bytes long, media binary, error string"

_PNG = b"\x89PNG\r\n\x1a\n"
#: Index entry: offset, length, checksum, unpadded bytes, whether the id is null, id.
_ENTRY = struct.Struct("<QQIQ?q")
_FOOTER = struct.Struct("<QQ8s")
_MAGIC = b"MEDIAIX1"
_MANIFEST = "_manifest.json"


def payload_of(text: bytes | None) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 1) -> bytes:
    """A greyscale PNG with the payload's bytes as samples, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of a PNG as `encode` makes them; checks the structure and each chunk's checksum."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit greyscale image")
            shape = height, width + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path; a path without a scheme is a local or mounted one, also where it is spelt `file:/path`."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.arc"
        index = bytearray()
        at = members = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in iterator:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    text = text.as_py() or b""
                    media = encode(payload_of(text), self.level)
                    out.write(media)
                    index += _ENTRY.pack(at, len(media), zlib.crc32(media), len(text), doc_id is None, doc_id or 0)
                    at += len(media)
                    members += 1
            out.write(bytes(index))
            out.write(_FOOTER.pack(at, members, _MAGIC))
        return Written(name, members)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        with fs.open_output_stream(f"{base}/{_MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(m.file for m in messages if m and m.members)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, tries: int):
        self.path, self.range_bytes, self.tries = path, range_bytes, tries

    def partitions(self) -> list[Range]:
        fs, base = file_system(self.path)
        with fs.open_input_stream(f"{base}/{_MANIFEST}", compression=None) as f:
            files = json.loads(f.read())
        ranges = []
        for info in fs.get_file_info([f"{base}/{name}" for name in files]):
            name = info.path.rpartition("/")[2]
            ranges += [Range(name, low, low + self.range_bytes) for low in range(0, info.size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, base = file_system(self.path)
        with fs.open_input_file(f"{base}/{partition.file}") as f:
            rows: list[tuple] = []
            held = 0
            for offset, n, crc, n_bytes, no_id, doc_id in members_of(f, partition.low, partition.high):
                media, error = member(f, offset, n, crc, self.tries)
                rows.append((None if no_id else doc_id, n_bytes, media, error))
                held += n
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def members_of(f, low: int, high: int) -> Iterator[tuple]:
    """Index entries of the members that begin in [low, high), found by bisection; the index is read in pieces."""
    size = f.size()
    end, count, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
    if magic != _MAGIC:
        raise OSError("an archive without its footer")

    def begin(i: int) -> int:
        return _ENTRY.unpack(f.read_at(_ENTRY.size, end + i * _ENTRY.size))[0]

    a, b = 0, count
    while a < b:
        mid = (a + b) // 2
        a, b = (mid + 1, b) if begin(mid) < low else (a, mid)
    while a < count:
        piece = f.read_at(min(count - a, 4096) * _ENTRY.size, end + a * _ENTRY.size)
        for entry in _ENTRY.iter_unpack(piece):
            if entry[0] >= high:
                return
            yield entry
        a += 4096


def member(f, offset: int, n: int, crc: int, tries: int) -> tuple[bytes | None, str | None]:
    """One member's bytes, or what went wrong in the last of its tries."""
    error = None
    for k in range(tries):
        try:
            media = f.read_at(n, offset)
            if zlib.crc32(media) == crc:
                return media, None
            error = "checksum"
        except OSError as e:
            error = str(e)
        time.sleep(0.05 * 2**k if k + 1 < tries else 0)
    return None, f"offset {offset}: {error}"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "media", "error"])


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("level", 1)))


def write_archive(docs: DataFrame, path: str) -> None:
    """Stores the texts of docs (doc_id, text) in a new archive folder."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    fs, base = file_system(path)
    fs.create_dir(base, recursive=True)
    docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").write.format("media_archive").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(path)


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation, entropy in bits and the commonest sample (the smallest of equally common ones)."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n = counts.sum()
    p = counts[counts > 0] / n
    levels = np.arange(256)
    mean = float((counts * levels).sum() / n)
    deviation = float(np.sqrt((counts * (levels - mean) ** 2).sum() / n))
    return f"h={len(samples)};mean={mean:.4f};dev={deviation:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};mode={int(counts.argmax())}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of members, computed from the media bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column(2):
                stored = stored.as_py()
                if stored is None:
                    out.append((None,) * 6)
                    continue
                samples = decode(stored)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(3)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores, reads back and describes every text; the archive stays in the session's shared folder."""
    path = new_folder(docs.sparkSession, "media")
    write_archive(docs, path)
    return media_features(read_archive(docs.sparkSession, path))
