"""Validation and routing of seven-label classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C, text as T

SIGNALS = ("explicit_action", "explicit_actor", "explicit_deadline", "safety_related")


def lexicon_signals(text: Column, action=C.ACTION_WORDS, responsibility=C.RESPONSIBILITY_WORDS, time=C.TIME_WORDS, status=C.STATUS_WORDS, safety=C.SAFETY_WORDS) -> dict[str, Column]:
    """Whether a text holds a word of each list."""
    return {f"has_{k}": T.contains_any(text, v) for k, v in (("action", action), ("responsibility", responsibility), ("time", time), ("status", status), ("safety", safety))}


def guard_routes(rows: DataFrame, text: str = "text", lexicons: dict | None = None) -> DataFrame:
    """Raises routes of rows(primary_label, route, the signals) where rules see a task; adds final_route and overrides."""
    hits = lexicon_signals(F.col(text), **(lexicons or {}))
    rows = rows.withColumns({"_a": F.col("explicit_action") | hits["has_action"], "_r": F.col("explicit_actor") | hits["has_responsibility"], "_t": F.col("explicit_deadline") | hits["has_time"], "_s": hits["has_status"], "_f": F.col("safety_related") | hits["has_safety"]})
    weak = F.col("_a") & (F.col("_r") | F.col("_t") | F.col("_s"))
    open_ = ~F.col("route").isin("EXTRACT", "HUMAN_REVIEW")
    label = F.col("primary_label")
    rule = (
        F.when(label.isin(*C.CANDIDATE_LABELS) & open_, F.lit("candidate_label_recalled"))
        .when((label == "report") & weak & open_, F.lit("actionable_report_recalled"))
        .when(label.isin("suggestion", "non_task") & weak & (F.col("route") == "DISCARD"), F.lit("weak_task_signal_review"))
    )
    rows = rows.withColumn("_rule", rule)
    route = F.when(F.col("_rule").isin("candidate_label_recalled", "actionable_report_recalled"), F.lit("EXTRACT")).when(F.col("_rule").isNotNull(), F.lit("HUMAN_REVIEW")).otherwise(F.col("route"))
    rows = rows.withColumn("_route", route)
    late = F.col("_f") & F.col("_route").isin("DISCARD", "CONTEXT_ONLY")
    over = F.filter(F.array(F.when(F.col("_f") & ~F.col("safety_related"), F.lit("safety_keyword_signal")), F.col("_rule"), F.when(late, F.lit("safety_candidate_review"))), lambda x: x.isNotNull())
    return rows.withColumns({"final_route": F.when(late, F.lit("HUMAN_REVIEW")).otherwise(F.col("_route")), "overrides": over, "final_safety": F.col("_f")}).drop("_a", "_r", "_t", "_s", "_f", "_rule", "_route")


def batch_faults(rows: DataFrame, batch: str, path: str, fault: str = "fault", first: int = 5) -> DataFrame:
    """batch, n_rows, n_faults and its first faults in the order of their path, as texts path: fault."""
    counts = rows.groupBy(batch).agg(F.count("*").alias("n_rows"), F.count(fault).alias("n_faults"))
    w = Window.partitionBy(batch).orderBy(path, fault)
    best = rows.filter(F.col(fault).isNotNull()).select(batch, path, fault, F.row_number().over(w).alias("_n")).filter(F.col("_n") <= first)
    said = best.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(": ", F.col(path).cast("string"), fault).alias("s")))).alias("_l"))  # at most ``first`` a batch
    return counts.join(said, batch, "left").select(batch, "n_rows", "n_faults", F.coalesce(F.transform("_l", lambda x: x["s"]), F.array().cast("array<string>")).alias("first_faults"))


def response_fault(raw: Column, segment_id: Column, text: Column) -> Column:
    """The first fault of a model response, or null: JSON, key order, segment, label, secondary label, evidence."""
    bare = T.without_fence(raw)
    get = lambda path: F.get_json_object(bare, path)
    labels = F.create_map(*(F.lit(x) for kv in C.LABEL_CODES.items() for x in kv))
    evidence = F.coalesce(get("$.evidence"), F.lit(""))
    return (
        F.when(F.try_parse_json(bare).isNull() | F.json_object_keys(bare).isNull(), F.lit("not_json_object"))
        .when(F.get(F.json_object_keys(bare), F.lit(0)) != "label_code", F.lit("label_code_not_first"))
        .when(~F.coalesce(get("$.segment_id") == segment_id, F.lit(False)), F.lit("segment_mismatch"))
        .when(~F.coalesce(F.element_at(labels, get("$.label_code")) == get("$.primary_label"), F.lit(False)), F.lit("label_code_mismatch"))
        .when(F.instr(F.coalesce(get("$.secondary_labels"), F.lit("")), F.concat(F.lit('"'), get("$.primary_label"), F.lit('"'))) > 0, F.lit("secondary_repeats_primary"))
        .when((evidence == "") | (F.instr(text, evidence) == 0), F.lit("evidence_not_in_text"))
    )
