"""Helpers that the training-data operators share: tables, scratch folders, unit encoding."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes (about) that a worker takes on at a time; Spark's own batches end at spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files give fewer splits than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name != "benchmark" and df.rdd.getNumPartitions() < cores else df


def optional_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table, or None where there is none; any other fault is raised."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without one there is no safe place, and it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, bin_: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors. The path is put into bin_."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if bin_ is not None:
        bin_.append(path)
    return spark.read.schema(df.schema).parquet(path)


def final(df: DataFrame, name: str, bin_: list[str], into: list[str] | None = None) -> DataFrame:
    """A result that is settled, after which the tables that led to it are removed; its own stays for the caller, who may have its path put into ``into``."""
    out = settle(df, name, into)
    discard(bin_)
    return out


def small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """A settled table of narrow rows, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(bin_: list[str]) -> None:
    """Removes settled tables that nothing reads any more."""
    for path in bin_:
        fs, place = filesystem(path)
        fs.delete_dir(place)
    bin_.clear()


def batches(source, rows: int = BATCH_ROWS, bytes_: int = BATCH_BYTES):
    """The rows of Arrow batches in batches of at most so many rows and about so many bytes; the session's own sizes stay as they are."""
    for b in source:
        step = max(1, min(rows, int(b.num_rows * bytes_ / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def filesystem(uri: str):
    """The file system and path of a URI, for executors that write files of their own format to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
