"""Shared-folder tables: how the operators cut lineage so that a lost executor costs only a reread."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: a folder of our own if all of Spark runs in this process, else an error, as executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once into the shared folder and return it read back: every later use starts from the files. The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that names each row: doc_id if it does, else a new number given to the stored rows."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs, "doc_id"
    row = fresh(docs, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "named-rows"), row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While an action runs, hand Python workers at most so many rows at a time: for texts, a few MB."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of at most so many rows, so that what a Python worker makes of a batch stays small."""
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows]
