"""Binary forms of the driver's tables, for the queries that read such forms: messages in wire format and files of stores."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sorted_tables as tables

#: Entries after which a block of a table ends, and after which a key stands whole again.
BLOCK_ENTRIES, RESTART = 40, 16
FILE_ROW = "path string, kind string, sequence long, deleted boolean, key binary, value binary"


def varint(n: Column) -> Column:
    """The bytes of a number that isn't negative, seven bits each, lowest first."""
    n = n.cast("long")
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    bits = lambda i: F.call_function("shiftright", n, (i * 7).cast("int")).bitwiseAND(127)
    more = lambda i: F.when(i < groups - 1, 128).otherwise(0).cast("long")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(bits(i).bitwiseOR(more(i))), 2, "0")), ""))


def number_field(field: int, n: Column) -> Column:
    return F.concat(varint(F.lit(field << 3)), varint(n))


def sized_field(field: int, value: Column) -> Column:
    """A field of text or of a nested message."""
    raw = value.cast("binary")
    return F.concat(varint(F.lit(field << 3 | 2)), varint(F.length(raw)), raw)


def packed(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def prefixed(raw: bytes) -> bytes:
    return packed(len(raw)) + raw


def block_of(entries: list[tuple[bytes, bytes]], compress: bool) -> bytes:
    """A block with its trailer (whose checksum is left zero)."""
    import pyarrow as pa

    out, restarts, before = bytearray(), [], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % RESTART == 0:
            restarts.append(len(out))
        else:
            while shared < min(len(key), len(before)) and key[shared] == before[shared]:
                shared += 1
        out += packed(shared) + packed(len(key) - shared) + packed(len(value)) + key[shared:] + value
        before = key
    restarts = restarts or [0]
    raw = bytes(out) + struct.pack(f"<{len(restarts) + 1}I", *restarts, len(restarts))
    return (pa.compress(raw, codec="snappy", asbytes=True) + b"\1" if compress else raw + b"\0") + bytes(4)


def table_bytes(rows: Iterator[tuple[int, bool, bytes, bytes | None]]) -> Iterator[bytes]:
    """A sorted table, piece by piece, of rows (sequence, deleted, key, value) in the order of their keys; every other block compressed."""
    at, index = 0, []
    for nth, some in enumerate(itertools.batched(rows, BLOCK_ENTRIES)):
        entries = [(k + struct.pack("<Q", s << 8 | (tables.DELETION if d else tables.VALUE)), v or b"") for s, d, k, v in some]
        block = block_of(entries, nth % 2 == 1)
        index.append((entries[-1][0], packed(at) + packed(len(block) - tables.TRAILER)))
        at += len(block)
        yield block
    footer = b""
    for entries in ([], index):
        block = block_of(entries, False)
        footer += packed(at) + packed(len(block) - tables.TRAILER)
        at += len(block)
        yield block
    yield footer.ljust(tables.FOOTER - 8, b"\0") + struct.pack("<Q", tables.MAGIC)


def log_bytes(records: Iterator[bytes]) -> Iterator[bytes]:
    """A log of records, cut at the borders of its blocks."""
    at = 0
    for record in records:
        first = True
        while True:
            room = tables.LOG_BLOCK - at % tables.LOG_BLOCK
            if room < tables.LOG_HEAD:
                yield bytes(room)
                at += room
                continue
            piece, record = record[: room - tables.LOG_HEAD], record[room - tables.LOG_HEAD :]
            kind = (tables.FULL if first else tables.LAST) if not record else (tables.FIRST if first else tables.MIDDLE)
            yield struct.pack("<IHB", 0, len(piece), kind) + piece
            at, first = at + tables.LOG_HEAD + len(piece), False
            if not record:
                break


def writes(rows: Iterator[tuple[int, bool, bytes, bytes | None]]) -> Iterator[bytes]:
    """Rows as writes: those whose sequences follow each other are one, up to three."""
    batch: list[tuple] = []
    for row in itertools.chain(rows, [None]):
        if batch and (row is None or len(batch) == 3 or row[0] != batch[-1][0] + 1):
            yield struct.pack("<QI", batch[0][0], len(batch)) + b"".join(bytes([tables.DELETION]) + prefixed(k) if d else bytes([tables.VALUE]) + prefixed(k) + prefixed(v or b"") for _, d, k, v in batch)
            batch = []
        batch.append(row)


def manifest_bytes(alive: list[int], removed: list[int], log: int) -> bytes:
    """A manifest that adds all tables, then removes some and names the log."""
    added = b"".join(packed(7) + packed(0) + packed(n) + packed(1) + prefixed(b"a") + prefixed(b"z") for n in [*alive, *removed])
    gone = b"".join(packed(6) + packed(0) + packed(n) for n in removed)
    return b"".join(log_bytes(iter([packed(1) + prefixed(b"order") + added, gone + packed(2) + packed(log) + packed(3) + packed(99) + packed(4) + packed(7)])))


def write_files(rows: DataFrame, alive: list[int], removed: list[int], log: int) -> int:
    """Writes rows (FILE_ROW) as tables (`ldb`, by key) and logs (`log`, by sequence), with a manifest a folder; gives the number of files.

    A task writes one file after the other, piece by piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        each = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for path, of in itertools.groupby(each, key=lambda r: r[0]):
            system, file = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))
            folder = file.rpartition("/")[0]
            system.create_dir(folder, recursive=True)
            entries = ((s, d, bytes(k), None if d else bytes(v)) for _, _, s, d, k, v in of)
            with system.open_output_stream(file) as f:
                for piece in log_bytes(writes(entries)) if file.endswith(".log") else table_bytes(entries):
                    f.write(piece)
            if file.endswith(f"{alive[0]:06d}.ldb"):
                for name, content in (("MANIFEST-000001", manifest_bytes(alive, removed, log)), ("CURRENT", b"MANIFEST-000001\n")):
                    with system.open_output_stream(f"{folder}/{name}") as f:
                        f.write(content)
            yield pd.DataFrame({"path": [path]})

    order = F.when(F.col("kind") == "log", F.col("sequence")).otherwise(0)
    by_key = F.when(F.col("kind") == "ldb", F.col("key"))
    return rows.select(*[c.split()[0] for c in FILE_ROW.split(", ")]).repartition("path").sortWithinPartitions("path", order, by_key, F.desc("sequence")).mapInPandas(run, "path string").count()
