"""A streaming source of lines that are appended to files, such as transcripts and logs.

`spark.readStream.format("growing_lines").option("path", folder).option("suffix", ".jsonl")` gives file, position (the
byte at which a line begins) and line of each whole line that was appended since the last batch. An offset holds, per
file, a fingerprint of its first line and the byte after its last whole line; a partial last line waits until it ends.
The offsets are all that the source remembers, so a query that restarts from its checkpoint goes on where it was.

A file whose first line is another one was replaced and is read from its beginning; so is one that was cut shorter. A
file that was renamed (rotated) is known by its first line, as long as no file of the old name has it still, and is read
on from where it was. What is appended is read in byte ranges of at most PART_BYTES, each in a task of its own: a range
holds the lines that begin in it. Files are read through pyarrow's file systems, so that paths may be addresses
(file:, hdfs:, s3:, gs:) that driver and executors share.

Blank lines are left out; bytes that aren't UTF-8 become replacement characters; a file that goes away after a batch was
planned has no lines; an empty or missing folder has none yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PART_BYTES = 16 << 20
_BLOCK = 1 << 16
SCHEMA = "file string, position long, line string"


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


class Files:
    """The files under a path, and what can be told of them from a few reads."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def system(self):
        from pyarrow import fs

        path = self.path
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(self) -> dict[str, int]:
        from pyarrow import fs

        system, path = self.system()
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def whole(self, file: str, size: int) -> tuple[str, int] | None:
        """Fingerprint of the first line, and the byte after the last whole line; None if there is no whole line."""
        try:
            with self.system()[0].open_input_file(file) as f:
                head, at = b"", 0
                while b"\n" not in head and at < size:
                    head += f.read_at(min(_BLOCK, size - at), at)
                    at = len(head)
                if b"\n" not in head:
                    return None
                end = size
                while end > 0:
                    begin = max(0, end - _BLOCK)
                    last = f.read_at(end - begin, begin).rfind(b"\n")
                    if last >= 0:
                        return hashlib.sha256(head[: head.index(b"\n")]).hexdigest()[:16], begin + last + 1
                    end = begin
        except (FileNotFoundError, OSError):
            pass
        return None

    def offset(self) -> dict:
        return {file: list(x) for file, size in sorted(self.listed().items()) if (x := self.whole(file, size))}

    def lines(self, part: Range) -> Iterator[tuple[str, int, str]]:
        try:
            f = self.system()[0].open_input_file(part.file)
        except FileNotFoundError:
            return
        with f:
            at, rest, began = part.begin, b"", part.begin
            if at > 0:
                # A line that begins before the range belongs to the one before.
                at -= 1
                began = -1
            while began < part.end:
                block = f.read_at(_BLOCK, at)
                if not block:
                    return
                at += len(block)
                if began < 0:
                    first = block.find(b"\n")
                    if first < 0:
                        if at >= part.end:
                            return
                        continue
                    began = at - len(block) + first + 1
                    block = block[first + 1 :]
                *done, rest = (rest + block).split(b"\n")
                for raw in done:
                    if began >= part.end:
                        return
                    if raw.strip():
                        yield part.file, began, raw.rstrip(b"\r").decode(errors="replace")
                    began += len(raw) + 1


def appended(start: dict, end: dict) -> list[tuple[str, int, int]]:
    """What of each file came between two offsets: file, first byte, byte behind."""
    moved: dict[str, list[int]] = {}
    for file, (head, at) in start.items():
        if end.get(file, [None])[0] != head:
            moved.setdefault(head, []).append(at)
    out = []
    for file, (head, to) in sorted(end.items()):
        before = start.get(file)
        begin = before[1] if before and before[0] == head else max(moved.get(head, [0]))
        if begin > to:
            begin = 0
        if begin < to:
            out.append((file, begin, to))
    return out


def ranges(parts: list[tuple[str, int, int]], part_bytes: int) -> list[Range]:
    return [Range(file, at, min(at + part_bytes, end)) for file, begin, end in parts for at in range(begin, end, part_bytes)]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.part_bytes = Files(options), int(options.get("partBytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.offset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(appended(start, end), self.part_bytes)

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return self.files.lines(partition)


class WholeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.part_bytes = Files(options), int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(appended({}, self.files.offset()), self.part_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return self.files.lines(partition) if partition.file else iter(())


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WholeReader:
        return WholeReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


_LINE = "uuid string, sessionId string, session_id string, type string, isSidechain boolean, timestamp string, message string"


def transcript_lines(lines: DataFrame) -> DataFrame:
    """Lines (SCHEMA) that are JSON objects as records: file, position, session_id, line_uuid, line_type, body, fingerprint.

    The session is the line's own, else that of the folder `local_...` above it. The fingerprint tells a line by its
    uuid, else by its place in the file; lines that aren't objects are left out.
    """
    parsed = lines.withColumn("said", F.from_json("line", _LINE)).where(F.ltrim("line").startswith("{") & F.expr("try_parse_json(line)").isNotNull())
    folder = F.nullif(F.regexp_extract("file", r"/local_([0-9a-fA-F-]{32,36})/", 1), F.lit(""))
    seed = F.coalesce(F.nullif(F.col("said.uuid"), F.lit("")), F.concat(F.lit("at="), F.col("position").cast("string")))
    session = F.coalesce(F.nullif(F.col("said.sessionId"), F.lit("")), F.nullif(F.col("said.session_id"), F.lit("")), folder)
    return parsed.select("file", "position", session.alias("session_id"), F.nullif(F.col("said.uuid"), F.lit("")).alias("line_uuid"), F.col("said.type").alias("line_type"), F.col("line").alias("body"), fingerprint(F.col("file"), F.lit("transcript_line"), seed).alias("fingerprint"))


def fingerprint(path: Column, kind: Column, seed: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, kind, seed), 256), 1, 32)


def unseen(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records whose fingerprint was not emitted before, each once; for scans that don't remember where they were."""
    first = records.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in records.columns if c != "fingerprint"]), F.struct("file", "position")).alias("row")).select("row.*", "fingerprint").select(*records.columns)
    return first.join(seen.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*records.columns)
