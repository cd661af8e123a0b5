"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is not set a folder in the warehouse, which is shared as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def filesystem(uri: str):
    """The file system and path of a URI, for executors that write files of other formats to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def settle(df: DataFrame, name: str, bin_: list[str] | None = None) -> DataFrame:
    """df written and read again: lineage ends here, and what is used several times is made once. The path is put into bin_."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if bin_ is not None:
        bin_.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, bin_: list[str]) -> None:
    """Removes settled tables that nothing reads any more."""
    for path in bin_:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    bin_.clear()


def final(df: DataFrame, name: str, bin_: list[str]) -> DataFrame:
    """df settled, after which the tables that led to it go."""
    out = settle(df, name)
    discard(df.sparkSession, bin_)
    return out


def bounded(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """A settled table of narrow rows, to be broadcast if it has at most so many."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
