"""Readers: documents of several formats, segments, labelled records, and tables with defaults for missing columns."""

from __future__ import annotations

import io
import shutil
import subprocess
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import json_arrays

SUFFIXES = ("txt", "json", "pdf", "docx")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a .docx file, blank ones left out; an unreadable file is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(_WORD + "t")) for p in root.iter(_WORD + "p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(content: bytes) -> str:
    """Text of a PDF by an optional parser, else by the command pdftotext; without either it is an error."""
    try:
        import fitz  # optional
    except ImportError:
        if not shutil.which("pdftotext"):
            raise RuntimeError("no PDF parser") from None
        return subprocess.run(["pdftotext", "-enc", "UTF-8", "-", "-"], input=content, capture_output=True, check=True, timeout=300).stdout.decode("utf-8")
    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _parsed(parse: Callable[[bytes], str] | None, content: bytes | None) -> tuple[str | None, str | None]:
    if parse is None or content is None:
        return None, None
    try:
        return parse(content), None
    except Exception as e:  # whatever a parser raises belongs to its file, not to the job
        return None, f"{type(e).__name__}: {e}"


def documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None, strict: bool = False) -> DataFrame:
    """path, suffix, sha256, n_bytes, text, error of the files under a path.

    A file that can't be read and a suffix that isn't known give a null text and an error; with ``strict`` they fail the job.
    Files are read whole by the binary source; text formats are decoded on the JVM, the others by a pandas UDF.
    """
    parsers = {"pdf": pdf_text, "docx": docx_text} | (parsers or {})

    @F.pandas_udf("text string, error string")
    def parse(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(parsers.get(s), c) for s, c in zip(suffix, content)], columns=["text", "error"], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")
    rows = rows.withColumn("_parsed", parse("suffix", "content"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    plain, known = F.when(valid, F.decode("content", "UTF-8")), F.col("suffix").isin("txt", "json", *parsers)
    text = F.when(F.col("suffix") == "txt", plain).when(F.col("suffix") == "json", snapshot_text(plain)).otherwise(F.col("_parsed.text"))
    error = F.when(~known, F.lit("unsupported_suffix")).when(F.col("suffix").isin("txt", "json") & ~valid, F.lit("not_utf8")).otherwise(F.col("_parsed.error"))
    rows = rows.withColumns({"text": text, "error": error})
    if strict:
        rows = rows.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error"))))
    return rows.drop("content", "_parsed")


def snapshot_text(raw):
    """Text of a JSON snapshot: an array of segments, or an object that has them; the clean text of each, else the raw one."""
    segment = "array<struct<clean_text:string,raw_text:string>>"
    rows = F.coalesce(F.from_json(F.get_json_object(raw, "$.segments"), segment), F.from_json(raw, segment))
    line = F.transform(rows, lambda r: F.trim(F.coalesce(F.nullif(r["clean_text"], F.lit("")), r["raw_text"], F.lit(""))))
    return F.array_join(F.filter(line, lambda x: x != ""), "\n")


SEGMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("session_title", "segment_id", "speaker_id", "speaker_name", "speaker_role", "speaker_department", "timestamp", "raw_text", "clean_text")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("quality_flags", "uncertainties", "nbest")]
    + [T.StructField("asr_confidence", T.DoubleType())]
)


def segments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Segments of JSON array files of any size, with their file and their place in it (ord); ``json_arrays.array_items`` says what broken files give."""
    rows = json_arrays.array_items(spark, path, strict=strict)
    return rows.select("file", "ord", F.from_json("value", SEGMENT).alias("s")).select("file", "ord", "s.*")


def json_items(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The items of JSON array files of any size, each as its own JSON text (value), with their file and their place in it (ord)."""
    return json_arrays.array_items(spark, path, strict=strict)


def record_faults(records: DataFrame, fields: Iterable[str], raw: str = "value") -> DataFrame:
    """Adds missing and extra: how a JSON record's keys differ from the exact contract."""
    want = F.array(*map(F.lit, fields))
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return records.withColumns({"missing": F.array_except(want, keys), "extra": F.array_except(keys, want)})


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds columns that an older table lacks, with a type and a default each."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns})
