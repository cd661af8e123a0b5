"""Vectors as segment files in the shared folder, and jobs over tiles (pairs of segments).

A search of many queries over all vectors is work on pairs of blocks. Neither side is shuffled or
broadcast for it: both are written once as segments of a bounded number of rows, the driver learns
their names alone, and each task reads the few segments of its tiles. A task that is run again
writes new names; names that no finished task has told are never read.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Tiles that one task works through at most.
TASK_TILES = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & (F.size(vector) > 0)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as segments of so many rows take, and at least one a core while these have a thousand rows."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-n // rows), min(cores, -(-n // 1024))))


def write(df: DataFrame, folder: str, pack, rows: int) -> list[str]:
    """Writes the rows of each partition as segments of at most so many rows; pack makes a table's arrays by name. The names of the files."""

    def run(batches):
        fs, place = common.filesystem(folder)
        held: list[pa.RecordBatch] = []

        def put():
            found = io.BytesIO()
            np.savez(found, **pack(pa.Table.from_batches(held)))
            name = uuid.uuid4().hex
            fs.create_dir(place, recursive=True)
            with fs.open_output_stream(f"{place}/{name}") as out:
                out.write(found.getvalue())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, rows - sum(x.num_rows for x in held))
                held.append(part)
                at += part.num_rows
                if sum(x.num_rows for x in held) == rows:
                    yield put()
        if held:
            yield put()

    return sorted(r.name for r in df.mapInArrow(run, "name string").collect())


def read(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, place = common.filesystem(folder)
    with fs.open_input_stream(f"{place}/{name}") as f, np.load(io.BytesIO(f.read())) as found:
        return dict(found)


def tiles(spark: SparkSession, left: tuple[str, list[str]], right: tuple[str, list[str]], run, schema: str) -> DataFrame:
    """The rows that run(left segment, iterator of right segments) yields (as record batches), for every left segment with a run of right ones.

    Sides are (folder, names). A task holds one left segment and one right segment at a time.
    """
    (folder, names), (other, others) = left, right
    if not names or not others:
        return spark.createDataFrame([], schema)
    cores = spark.sparkContext.defaultParallelism
    step = max(1, min(TASK_TILES, len(others), len(names) * len(others) // (3 * cores)))
    runs = -(-len(others) // step)

    def go(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                own, at = names[i // runs], i % runs * step
                yield from run(read(folder, own), (read(other, n) for n in others[at : at + step]))

    return spark.range(0, len(names) * runs, 1, len(names) * runs).mapInArrow(go, schema)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components of a column of lists one after another (double precision), and the length of each list."""
    flat = column.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, np.int64)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths.astype(np.int64)
