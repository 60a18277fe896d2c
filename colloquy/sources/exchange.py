"""Reading and writing of captures and sessions: JSON lines, documents, spans, Markdown, Parquet and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGE = "struct<id:string,role:string,content_text:string,ts:double,model_name:string,token_estimate:int>"
ENVELOPE = f"session_id string, provider string, started_at double, messages array<{_MESSAGE}>"


def read_lines(spark: SparkSession, path: str, schema: str = ENVELOPE) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, bad lines). A bad line is never fatal; blank lines are neither."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("at", F.col("_metadata.file_path"))
    ok = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    rows = lines.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, lines.where(~ok)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of JSON documents {"sessions": [...]}."""
    return spark.read.schema(f"sessions array<struct<session_id:string,provider:string,started_at:double,messages:array<{_MESSAGE}>>>").json(path, multiLine=True).select(F.explode("sessions").alias("s")).select("s.*")


def printable_runs(spark: SparkSession, path: str, least: int = 6) -> DataFrame:
    """(path, run): printable ASCII runs of binary files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(rf"[\x20-\x7E]{{{least},}}"), F.lit(0))).alias("run"))


def envelopes(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A row per session with its messages in order. One conversation is one row by the format's definition."""
    fields = F.struct(F.col("ts"), F.col("id").cast("string").alias("id"), "role", "content_text", "model_name", F.col("token_estimate").cast("int").alias("token_estimate"))
    listed = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(fields)).alias("messages"))
    return sessions.join(listed, sessions["id"] == listed["session_id"], "left").select(sessions["id"].cast("string").alias("session_id"), "provider", "started_at", "messages")


def write_envelopes(sessions: DataFrame, messages: DataFrame, path: str) -> None:
    envelopes(sessions, messages).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def imported(rows: DataFrame) -> DataFrame:
    """Messages of envelopes."""
    m = rows.select("session_id", F.posexplode("messages").alias("turn_index", "m"))
    return m.select("session_id", "turn_index", "m.*")


def markdown(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, document): a heading, then each message under its role."""
    said = F.transform("messages", lambda m: F.concat(F.lit("## "), F.initcap(m["role"]), F.lit("\n\n"), F.coalesce(m["content_text"], F.lit(""))))
    when = F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd HH:mm 'UTC'")
    return envelopes(sessions, messages).select("session_id", F.concat_ws("\n\n", F.concat(F.lit("# Session "), F.col("session_id")), when, F.array_join(said, "\n\n")).alias("document"))


def export_parquet(table: DataFrame, path: str, ts: str | None = None, cutoff: float | None = None) -> int:
    """Writes a table (its rows from cutoff on) whole with zstd, and gives the rows read back."""
    rows = table if cutoff is None else table.where(F.col(ts) >= cutoff)
    rows.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.parquet(path).count()


def archive(captures: DataFrame, cutoff: float, path: str) -> DataFrame:
    """Writes captures older than cutoff as gzip JSON lines, verifies the count, and gives those that stay."""
    old = captures.where(F.col("created_at") < cutoff)
    old.write.option("compression", "gzip").json(path)
    n, back = old.count(), captures.sparkSession.read.text(path).count()
    if n != back:
        raise OSError(f"archived {back} of {n} rows: nothing is removed")
    return captures.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff))


def body_chars(captures: DataFrame, cutoff: float) -> DataFrame:
    """What archiving would take: rows and characters."""
    return captures.where(F.col("created_at") < cutoff).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """One row per key; of an old and a new one the new, or with replace=False the old."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    pick = F.max_by if replace else F.min_by
    return both.groupBy(*keys).agg(pick(F.struct(*existing.columns), "__new").alias("r")).select("r.*")


def enriched(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of updates (one row per key)."""
    new = updates.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in updates.columns if c != key])
    return rows.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in updates.columns and c != key else F.col(c) for c in rows.columns])
