"""Writers: single JSON results, training archives, and append-only tables."""

from __future__ import annotations

import json
import time
import traceback
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import filesystem


def one_json(df: DataFrame, order: str, **fields) -> DataFrame:
    """One row with one JSON object: the rows as an array in order, and further fields; for results of bounded size."""
    row = F.struct(*[c for c in df.columns if c != order])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("r")))), lambda x: x["r"])
    return df.agg(rows.alias("items")).select(F.to_json(F.struct("items", *(F.lit(v).alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"}).alias("value"))


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Adds rows to a table folder; Spark's commit protocol makes them visible at once or not at all."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def artefacts(df: DataFrame, path: str, outputs: dict[str, Column], mode: str = "errorifexists") -> None:
    """Writes the rows that meet each output's condition as JSON under path/output=<name>, all in one pass and one commit.

    A row may go to several outputs (results and review) or to none.
    """
    names = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in outputs.items())))
    df.withColumn("output", F.explode(names)).write.mode(mode).partitionBy("output").option("ignoreNullFields", "false").json(path)


def logged(spark: SparkSession, path: str, run_id: str, stage: str, work: Callable[[], object]) -> object:
    """Runs one stage and appends a row (run_id, stage, status, seconds, error) to the log table; a failure is logged and raised again."""
    began, error = time.monotonic(), None
    try:
        return work()
    except Exception:
        error = traceback.format_exc()
        raise
    finally:
        row = (run_id, stage, "failed" if error else "done", time.monotonic() - began, error)
        append(spark.createDataFrame([row], "run_id string, stage string, status string, seconds double, error string"), path)


#: Bytes of an archive's own records for a sample besides its names, which stand in it several times; what deflating may add at most.
_ENTRY, _NAMES, _GROWTH = 700, 8, 1.01


def export_archives(rows: DataFrame, folder: str, size: int = 1 << 30, schema_version: str = "training_export_v1") -> DataFrame:
    """Writes samples as ZIP files of at most ``size`` bytes into a shared folder; the manifest: archive, n_samples, n_bytes, first_id, last_id.

    rows(sample_id, evidence_text, label JSON). Samples are dealt to ranges of their ids by bytes; a task writes the archives of its range
    one after another, each as a stream, with samples/<id>/evidence.txt, label.json and a manifest.json of its own. A sample that is
    larger alone is an archive of its own. What a lost task has written is in no manifest; the manifest is written last, to
    manifest.parquet. Null texts are empty, null labels {}; repeated ids are samples of their own; without rows there is no archive.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col("sample_id").cast("string").alias("sample_id"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), F.coalesce("label", F.lit("{}")).alias("label"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("evidence_text") + F.octet_length("label") + _ENTRY), F.lit(0))).first()[0]
    parts = max(1, -(-total // (8 * size)), min(spark.sparkContext.defaultParallelism, total // size))

    def write(batches):
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        out = archive = None
        names: list[str] = []

        def close():
            nonlocal out
            archive.writestr("manifest.json", json.dumps({"schema_version": schema_version, "sample_count": len(names), "samples": names}, ensure_ascii=False))
            archive.close()
            n = out.tell()
            out.close()
            out = None
            row = ([path], [len(names)], [n], [names[0]], [names[-1]])
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["archive", "n_samples", "n_bytes", "first_id", "last_id"])

        for b in batches:
            for sample, text, label in zip(*(b.column(c).to_pylist() for c in ("sample_id", "evidence_text", "label"))):
                text, label = text.encode(), label.encode()
                need = int((len(text) + len(label)) * _GROWTH) + _ENTRY + _NAMES * len((sample or "").encode())
                if out is not None and out.tell() + need + closing > size:
                    yield close()
                if out is None:
                    path, closing = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip", 1000
                    out = fs.open_output_stream(f"{place}/{path.rsplit('/', 1)[1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(f"samples/{sample}/evidence.txt", text)
                archive.writestr(f"samples/{sample}/label.json", label)
                names.append(sample)
                closing += _ENTRY // 2 + _NAMES * len((sample or "").encode())  # the directory and the manifest grow with each sample
        if out is not None:
            yield close()

    made = plain.repartitionByRange(parts, "sample_id").mapInArrow(write, "archive string, n_samples long, n_bytes long, first_id string, last_id string")
    made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest.parquet")
    return spark.read.schema(made.schema).parquet(f"{folder.rstrip('/')}/manifest.parquet")
