"""Record contracts, views and pages that the other operators and the API share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C, text as T
from ..sources import readers
from . import ordered

# The fields of a labelled record.
LABELLED_FIELDS = (
    "segment_id",
    "subsegment_id",
    "speaker_id",
    "speaker_confidence",
    "start_ms",
    "end_ms",
    "text_raw",
    "asr_confidence",
    "nbest",
    "missing_fields",
    "task_category",
)


def labelled_record_fault(records: DataFrame) -> DataFrame:
    """Adds fault: the first rule of the labelled-record contract that a row breaks, or null.

    records(segment_id, subsegment_id, text_raw, task_category); a repeated key is a fault of each of its rows.
    """
    n = records.groupBy("segment_id", "subsegment_id").agg(F.count("*").alias("_n"))
    out = records.join(n, (records["segment_id"].eqNullSafe(n["segment_id"])) & (records["subsegment_id"].eqNullSafe(n["subsegment_id"]))).select(records["*"], "_n")
    fault = (
        F.when(T.strip(F.col("segment_id")) == "", F.lit("segment_id_blank"))
        .when(~F.coalesce(F.col("subsegment_id").rlike("^[0-9]{3}$"), F.lit(False)), F.lit("subsegment_id_format"))
        .when(T.strip(F.col("text_raw")) == "", F.lit("text_blank"))
        .when(~F.coalesce(F.col("task_category").isin(*C.LABEL_CODES.values()), F.lit(False)), F.lit("unknown_category"))
        .when(F.col("_n") > 1, F.lit("key_repeated"))
    )
    return out.withColumn("fault", fault).drop("_n")


def labelled_records(raw: DataFrame) -> DataFrame:
    """The eleven fields of raw(value, one JSON object each) and fault: keys that differ first, then the rules of ``labelled_record_fault``."""
    lists, numbers = ("nbest", "missing_fields"), ("speaker_confidence", "start_ms", "end_ms", "asr_confidence")
    schema = ", ".join(f"{f} {'array<string>' if f in lists else 'double' if f in numbers else 'string'}" for f in LABELLED_FIELDS)
    keyed = readers.record_faults(raw, LABELLED_FIELDS).withColumn("_r", F.from_json("value", schema))
    rows = keyed.select((F.size("missing") + F.size("extra") > 0).alias("_keys"), *(F.col(f"_r.{f}").alias(f) for f in LABELLED_FIELDS))
    fault = F.when(F.col("_keys"), F.lit("keys_differ")).when(F.col("segment_id").isNull(), F.lit("segment_id_blank")).when(F.col("text_raw").isNull() & F.col("fault").isNull(), F.lit("text_blank")).otherwise(F.col("fault"))
    return labelled_record_fault(rows).withColumn("fault", fault).drop("_keys")


def upload_fault(n_bytes: Column, suffix: Column, date: Column, kind: Column, limit: int = 30 << 20, suffixes: tuple[str, ...] = ("txt", "json", "pdf", "docx")) -> Column:
    """Why an upload is refused, or null."""
    return (
        F.when(~F.coalesce(suffix.isin(*suffixes), F.lit(False)), F.lit("unsupported_suffix"))
        .when(F.coalesce(n_bytes, F.lit(0)) == 0, F.lit("empty_file"))
        .when(n_bytes > limit, F.lit("too_large"))
        .when(F.try_to_date(date, "yyyy-MM-dd").isNull(), F.lit("bad_date"))
        .when(T.strip(kind) == "", F.lit("type_required"))
    )


def decoded(tasks: DataFrame) -> DataFrame:
    """Tasks with work_items as an array (broken JSON: empty) and department, project and priority filled from the description's lines."""
    items = F.coalesce(F.from_json("work_items_json", "array<string>"), F.array().cast("array<string>"))
    fill = {c: F.coalesce(T.nullable(F.col(c)), F.nullif(F.trim(T.label_line(F.col("description"), label)), F.lit(""))) for c, label in (("department", "部门"), ("project", "项目"), ("priority", "优先级"))}
    return tasks.withColumns({"work_items": items, **fill})


def with_canonical_project(cands: DataFrame) -> DataFrame:
    """Candidates whose project label is the canonical name where one was resolved; the original stays as source_name."""
    return cands.withColumns({"source_name": F.col("project"), "project": F.coalesce(T.nullable(F.col("canonical_name")), F.col("project"))})


def page(rows: DataFrame, order: list, number: int, size: int = 10, within: str | None = None, block: int = ordered.BLOCK) -> DataFrame:
    """One page of each group (or of all rows) in an order, with row numbers.

    A page of all rows is the tail of a top-k, which keeps ``number`` * ``size`` rows a task; only these are numbered. Beyond ``block``
    rows that gives way to numbers by range, where no task holds all rows before the page; so do groups that are larger.
    """
    if within is None and number * size <= block:
        rows = rows.orderBy(*order).limit(number * size).withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        rows = ordered.numbered(rows, [within] if within else [], order, "row_number", block)
    return rows.filter(F.col("row_number").between((number - 1) * size + 1, number * size))


def failed_events(log: DataFrame, failures: DataFrame) -> DataFrame:
    """Event rows of failures(event_key, run_id, seq, failure_reason) that the log doesn't hold; the run is part of the key."""
    rows = failures.withColumns({"event_key": F.concat_ws(":", "event_key", F.lit("failed"), "run_id"), "failure_reason": T.truncated(F.col("failure_reason"), 500), "execution_status": F.lit("failed")})
    first = rows.groupBy("event_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "event_key"]), "seq").alias("r")).select("event_key", "r.*")
    return first.join(log.select("event_key"), "event_key", "left_anti")


def run_state(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Runs after changes(run_id, seq, status, error_summary): the last status, the last error, and when each was set."""
    last = changes.groupBy("run_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("_s"), F.max_by("error_summary", F.when(F.col("error_summary").isNotNull(), F.col("seq"))).alias("error_summary"), F.max("seq").alias("updated_seq"))
    return runs.join(last, "run_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def training_label(tasks: DataFrame, schema_version: str = "training_sample_v1") -> DataFrame:
    """sample_id, label and provenance of tasks, nested as the export has them."""
    return tasks.select(
        F.col("task_id").alias("sample_id"),
        F.struct("title", "description", "status", "priority").alias("label"),
        F.struct("source_session_id", "created_at", F.lit(schema_version).alias("schema_version")).alias("provenance"),
    )
