"""Folders that the driver and all executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """Where the session keeps what it derives: spark.checkpoint.dir, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def signature(spark: SparkSession, path: str) -> str:
    """Changes with the files' names, sizes and times; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    digest = hashlib.sha256()
    for r in files.orderBy("path").toLocalIterator():
        digest.update(f"{r.path}|{r.length}|{r.at}\n".encode())
    return digest.hexdigest()[:24]
