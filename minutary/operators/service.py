"""Labelled records to events: the path that matches records with all tasks and asks a client for a command each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import commands, matching, store


def corrected(rows: DataFrame, client: Callable[[], dict[str, Column]], fault: Column, retry: Callable[[], dict[str, Column]] | None = None) -> DataFrame:
    """rows with the client's command, attempts and fault. A faulty command is made once more; one that is faulty still becomes a NOOP.

    ``fault`` reads the command's columns; ``retry`` sees the first command and its fault as well. All in one projection: a model that
    is called by partition goes through ``models.ask_twice``, which sends only faulty rows again.
    """
    first = client()
    out = rows.withColumns(first).withColumn("fault", fault)
    if retry:
        second = retry()
        bad = F.col("fault").isNotNull()
        out = out.withColumns({k: F.when(bad, second[k]).otherwise(F.col(k)) for k in first} | {"attempts": F.when(bad, F.lit(2)).otherwise(F.lit(1))}).withColumn("fault", fault)
    else:
        out = out.withColumn("attempts", F.lit(1))
    nothing = commands.noop(first)
    return out.withColumns({k: F.when(F.col("fault").isNull(), F.col(k)).otherwise(nothing[k]) for k in first})


def to_commands(records: DataFrame, tasks: DataFrame, decisions: bool = False, client: Callable[[], dict[str, Column]] = commands.rule_command, fault: Column | None = None, retry: Callable[[], dict[str, Column]] | None = None) -> DataFrame:
    """One command a record of the categories that count; records(record_id, seq, text, task_category).

    Every record is matched with the tasks as they stand at the start of the batch. An update without one clear target is a NOOP.
    With ``fault`` commands are checked, made once more by ``retry``, and given up as NOOP (``corrected``).
    """
    kept = records.filter(F.col("task_category").isin("task", "task_update", *(["decision"] if decisions else [])))
    texts = kept.filter("task_category = 'task_update'").select(F.col("record_id").alias("text_id"), "text")
    found = matching.decide_all(texts, matching.score_all(texts, tasks)).select(F.col("text_id").alias("record_id"), "decision", F.col("task_id").alias("target_task_id"))
    rows = kept.join(found, "record_id", "left")
    rows = rows.withColumn("task_category", F.when(F.col("task_category") == "decision", F.lit("task")).otherwise(F.col("task_category")))
    return rows.withColumns(client()) if fault is None else corrected(rows, client, fault, retry)


def to_events(made: DataFrame, tasks: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Event rows of the commands on top of the stored tasks, with all their fields and versions.

    made: what ``to_commands`` gives; commands that name a version, patch fields or a source key of their own keep them. Each updates
    the version that its task has at its turn unless it expects another one.
    """
    own = set(made.columns)
    given = lambda c, other: F.col(c) if c in own else other
    nothing = F.lit(None)
    key = F.concat_ws(":", F.col("record_id").cast("string"), F.lit("1"))
    new = made.select(
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("target_task_id", T.digest_id("T", 10, F.col("record_id").cast("string"))).alias("task_id"),
        key.alias("event_key"),
        "db_action",
        given("expected_version", nothing.cast("long")).alias("expected_version"),
        given("title", F.when(F.col("db_action").isin("CREATE", "UPDATE_FIELDS"), T.truncated(F.col("text"), 60))).alias("title"),
        *(given(f, nothing).alias(f) for f in ("description", "work_items", "assignee_raw", "deadline_raw")),
        "status",
        F.when(F.col("db_action") == "CREATE", given("source_key", key)).alias("source_key"),
    )
    return store.apply_commands(new, tasks, log)
