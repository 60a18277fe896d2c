"""What the operators share: table reading, the shared folder, lineage cuts, word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words; the rest are digits, a-z after lower-casing, and every byte of a non-ASCII character.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: One translation lower-cases A-Z and turns separators into spaces.
WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))

#: Text that one step inside a task handles at once, in bytes.
CHUNK_BYTES = 4 << 20

#: Rows of a few numbers that one task handles well.
TASK_ROWS = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; a temporary one for local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/colloquy-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    A checkpoint keeps the estimated size of the plan that it cuts, and a join's estimate is the product of its sides'. Where
    cuts are joined again and again, use `narrow`.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Settings of the Parquet writer for rows of megabytes: a row group each, as by itself it looks at its buffers every 100 rows
#: only; and no statistics, as it holds the least and the greatest value of each row group until a file ends.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: a compact lineage cut for wide or large rows."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, limit: str) -> Iterator[None]:
    """Actions inside hand their tasks Arrow batches of about so many bytes, or of one longer row.

    A batch exists up to four times at once: as Arrow vectors and as a stream, each with room to grow, and in the Python worker.
    """
    kind = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, limit)
    try:
        yield
    finally:
        spark.conf.set(kind, before) if before else spark.conf.unset(kind)


def narrow(df: DataFrame, name: str, rows: int) -> DataFrame:
    """`written`, of about so many rows of a few numbers, in no more files than they need; for rounds of joins.

    The size that Spark plans with is that of the files. Joined in rounds, checkpoints would double the digits of theirs in
    each round: after twenty, one such number takes megabytes of the driver's memory.
    """
    return written(df.coalesce(max(1, -(-rows // TASK_ROWS))), name)


def tidy(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark's cleaner removes the shuffles of results that were cut and let go.

    Without it many small shuffles stay on the executors' disks until the driver's heap happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(sizes: list[int], limit: int = CHUNK_BYTES):
    """Ranges of consecutive rows with about limit bytes each; a single long row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
