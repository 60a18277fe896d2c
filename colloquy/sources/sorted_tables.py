"""A source of key-value stores that are kept as sorted tables and write-ahead logs, as browsers keep their local storage.

`spark.read.format("sorted_tables").option("path", folder)` gives file, sequence, deleted, key and value of every entry
that the store's files hold, deletions and overwritten values included; `newest` leaves what a reader of the store would
see. Planning lists files and sizes alone. A table is cut into byte ranges of `partBytes`, each a task of its own that
reads the table's footer and index and then the blocks that begin in its range; a log is cut in the same way, at the
borders of its 32 KB blocks, and a record belongs to the range in which it begins. So a task holds one block or one
record, however large the store is, and can be run again anywhere. Nothing is locked and nothing is written.

Which files are alive is told by the manifest that CURRENT names: tables that were added and not removed, and logs from
the log number on. Without CURRENT (a copy of some files) all tables and logs are read.

Keys and values are bytes. Blocks are plain or Snappy; checksums are not verified. A last log record that was cut off by
a crash is left out, as the store itself does; a table whose footer is not one is an error, as its rows would be lost
unseen. An empty or missing folder and empty logs have no rows. Entries of equal key and sequence are equal; a deletion
has a null value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tail import Files

# Fixed values of the format.
MAGIC = 0xDB4775248B80FB57
FOOTER, TRAILER, LOG_BLOCK, LOG_HEAD = 48, 5, 1 << 15, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
DELETION, VALUE = 0, 1

PART_BYTES = 16 << 20
SCHEMA = "file string, sequence long, deleted boolean, key binary, value binary"


@dataclass
class Part(InputPartition):
    file: str
    size: int
    begin: int
    end: int


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def sized(data: bytes, at: int) -> tuple[bytes, int]:
    length, at = varint(data, at)
    return data[at : at + length], at + length


def entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Keys and values of a block; each key repeats the first bytes of the one before."""
    end = len(block) - 4 * (int.from_bytes(block[-4:], "little") + 1)
    at, key = 0, b""
    while at < end:
        shared, at = varint(block, at)
        own, at = varint(block, at)
        length, at = varint(block, at)
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + length]
        at += own + length


def block_at(f, offset: int, size: int) -> bytes:
    import pyarrow as pa

    raw = f.read_at(size + TRAILER, offset)
    if raw[size] == 0:
        return raw[:size]
    if raw[size] != 1:
        raise ValueError(f"blocks compressed by method {raw[size]} are not known")
    return pa.decompress(raw[:size], varint(raw, 0)[0], codec="snappy", asbytes=True)


def table_entries(f, part: Part) -> Iterator[tuple[int, bool, bytes, bytes]]:
    footer = f.read_at(FOOTER, part.size - FOOTER) if part.size >= FOOTER else b""
    if len(footer) < FOOTER or int.from_bytes(footer[-8:], "little") != MAGIC:
        raise ValueError(f"{part.file} is no sorted table")
    at = varint(footer, varint(footer, 0)[1])[1]
    offset, at = varint(footer, at)
    for _, handle in entries(block_at(f, offset, varint(footer, at)[0])):
        begin, at = varint(handle, 0)
        if part.begin <= begin < part.end:
            for key, value in entries(block_at(f, begin, varint(handle, at)[0])):
                tag = int.from_bytes(key[-8:], "little")
                yield tag >> 8, tag & 255 == DELETION, key[:-8], value


def log_records(f, begin: int, end: int) -> Iterator[bytes]:
    """Records that begin from begin (a block's border) to before end, each put together from its pieces."""
    at, pieces = begin, None
    while True:
        block = f.read_at(LOG_BLOCK, at)
        place = 0
        while place + LOG_HEAD <= len(block):
            _, length, kind = struct.unpack_from("<IHB", block, place)
            if kind in (FULL, FIRST):
                if at + place >= end:
                    return
                pieces = []
            body = block[place + LOG_HEAD : place + LOG_HEAD + length]
            if kind not in (FULL, FIRST, MIDDLE, LAST):
                # The rest of a block that was laid out ahead and not written.
                break
            if len(body) < length:
                return
            if pieces is not None:
                pieces.append(body)
                if kind in (FULL, LAST):
                    yield b"".join(pieces)
                    pieces = None
            place += LOG_HEAD + length
        at += LOG_BLOCK
        if len(block) < LOG_BLOCK or (pieces is None and at >= end):
            return


def batch_entries(record: bytes) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """The changes of one write: they are numbered from the write's sequence on."""
    first, count = struct.unpack_from("<QI", record)
    at = 12
    for nth in range(count):
        kind = record[at]
        key, at = sized(record, at + 1)
        value, at = sized(record, at) if kind == VALUE else (b"", at)
        yield first + nth, kind == DELETION, key, value


def live(edits: Iterator[bytes]) -> tuple[set[int], int]:
    """Numbers of the tables that are alive after all edits of a manifest, and the first log that counts."""
    tables: set[int] = set()
    log = 0
    for edit in edits:
        at = 0
        while at < len(edit):
            tag, at = varint(edit, at)
            if tag == 1:
                _, at = sized(edit, at)
            elif tag == 5:
                _, at = sized(edit, varint(edit, at)[1])
            elif tag == 6:
                number, at = varint(edit, varint(edit, at)[1])
                tables.discard(number)
            elif tag == 7:
                number, at = varint(edit, varint(edit, at)[1])
                tables.add(number)
                _, at = sized(edit, sized(edit, varint(edit, at)[1])[1])
            elif tag in (2, 3, 4, 9):
                number, at = varint(edit, at)
                log = number if tag == 2 else log
            else:
                raise ValueError(f"unknown tag {tag} in a manifest")
    return tables, log


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.part_bytes = Files(options), int(options.get("partBytes", PART_BYTES))

    def alive(self, listed: dict[str, int]) -> dict[str, int]:
        """Tables and logs that count, of each folder by its own manifest."""
        system, out = self.files.system()[0], {}
        folders: dict[str, tuple[set[int], int] | None] = {}
        for file, size in sorted(listed.items()):
            folder, _, name = file.rpartition("/")
            stem, _, kind = name.rpartition(".")
            if kind not in ("ldb", "sst", "log") or not stem.isdigit():
                continue
            if folder not in folders:
                folders[folder] = None
                if f"{folder}/CURRENT" in listed:
                    with system.open_input_file(f"{folder}/CURRENT") as f:
                        manifest = f"{folder}/{f.read().decode().strip()}"
                    with system.open_input_file(manifest) as f:
                        folders[folder] = live(log_records(f, 0, listed[manifest]))
            known = folders[folder]
            if known is None or (int(stem) >= known[1] if kind == "log" else int(stem) in known[0]):
                out[file] = size
        return out

    def partitions(self) -> list[Part]:
        parts = []
        for file, size in self.alive(self.files.listed()).items():
            step = max(1, self.part_bytes // LOG_BLOCK) * LOG_BLOCK if file.endswith(".log") else self.part_bytes
            parts += [Part(file, size, at, min(at + step, size)) for at in range(0, size, step)]
        return parts or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.file:
            return
        with self.files.system()[0].open_input_file(part.file) as f:
            if part.file.endswith(".log"):
                found = (e for record in log_records(f, part.begin, part.end) for e in batch_entries(record))
            else:
                found = table_entries(f, part)
            for sequence, deleted, key, value in found:
                yield part.file, sequence, deleted, key, None if deleted else value


class SortedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sorted_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SortedTables)


def newest(records: DataFrame, *within: str) -> DataFrame:
    """The entries that a store's reader sees: of each key the one of the highest sequence, unless it is a deletion.

    within names columns that tell stores apart, as sequences of several stores can't be compared. One pass and one
    shuffle; only the newest entry of a key is kept while it is counted together, so a key that is written often is no load.
    """
    last = F.max_by(F.struct("sequence", "deleted", "value"), "sequence").alias("last")
    return records.groupBy(*within, "key").agg(last).where("NOT last.deleted").select(*within, "key", "last.value", "last.sequence")
