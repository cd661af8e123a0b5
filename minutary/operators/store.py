"""The audited store as an append-only event log with derived snapshots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C, text as T
from ..sources.scratch import final, settle
from . import claims, ordered

MUTATIONS = ("CREATE", "UPDATE_FIELDS", "UPDATE_STATUS", "SOFT_DELETE")


def split_new(log: DataFrame, commands: DataFrame) -> DataFrame:
    """Marks each command new or duplicate by event_key: of the log, or of an earlier command (least seq)."""
    first = commands.groupBy("event_key").agg(F.min("seq").alias("_first"))
    seen = log.select("event_key").distinct().withColumn("_seen", F.lit(True))
    out = commands.join(first, "event_key").join(seen, "event_key", "left")
    return out.withColumn("duplicate", (F.col("seq") > F.col("_first")) | F.coalesce("_seen", F.lit(False))).drop("_first", "_seen")


def versions(log: DataFrame) -> DataFrame:
    """Adds version: how many applied mutations the task has had up to the event."""
    w = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    applied = (F.col("execution_status") == "applied") & F.col("db_action").isin(*MUTATIONS)
    return log.withColumn("version", F.count_if(applied).over(w))


def snapshot(log: DataFrame, fields: tuple[str, ...] = ("title", "status")) -> DataFrame:
    """Current state of each task by last non-null value of each field; map-side, no ordering of groups."""
    applied = log.filter((F.col("execution_status") == "applied") & F.col("db_action").isin(*MUTATIONS))
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields if f != "status"]
    status = F.when(F.bool_or(F.col("db_action") == "SOFT_DELETE"), F.lit("cancelled")).otherwise(F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("open"))).alias("status")
    return applied.groupBy("task_id").agg(*last, status, F.count("*").alias("version"), F.max(F.when(F.col("db_action") == "SOFT_DELETE", 1).otherwise(0)).alias("is_deleted"), F.min("seq").alias("created_seq"), F.max("seq").alias("updated_seq"))


FIELDS = ("title", "description", "work_items", "assignee_raw", "deadline_raw")
_KINDS = {f: "array<string>" if f == "work_items" else "string" for f in FIELDS}
RESULT = "seq long, task_id string, event_key string, db_action string, execution_status string, failure_reason string, version_before long, version_after long, " + ", ".join(f"{f} {k}" for f, k in _KINDS.items()) + ", status string, is_deleted int"
_OUT = [f.split(" ")[0] for f in RESULT.split(", ")]


def _apply(batches):
    """Folds commands in order of task and seq on top of the stored task, if any; only the state of the task at hand is held, however many commands it has."""
    task = state = None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("seq", "task_id", "event_key", "db_action", "expected_version", "verdict", "version", "is_deleted", "status", *FIELDS)]
        out: list[list] = [[] for _ in _OUT]
        for seq, task_id, key, action, expected, verdict, version, deleted, status, *fields in zip(*cols):
            if task_id != task:
                task, state = task_id, None  # version, status, is_deleted, fields
            if version is not None:  # what is stored
                state = (version, status, deleted, fields)
                continue
            before, why, done = state[0] if state else 0, None, verdict or "applied"
            if verdict:
                pass
            elif action == "CREATE":
                state = (1, status or "open", 0, fields)
            elif state is None:
                why = "task_not_found"
            elif state[2]:
                why = "task_deleted"
            elif expected is not None and expected != before:
                why = "version_conflict"
            elif action == "SOFT_DELETE":
                state = (before + 1, "cancelled", 1, state[3])
            elif action == "UPDATE_STATUS" and status is not None:
                state = (before + 1, status, 0, state[3])
            elif action == "UPDATE_FIELDS" and any(x is not None for x in fields):
                state = (before + 1, state[1], 0, [y if x is None else x for x, y in zip(fields, state[3])])
            else:
                why = "ineffective_update"
            version, now, deleted, kept = state or (0, None, 0, [None] * len(FIELDS))
            for col, v in zip(out, (seq, task_id, key, action, "failed" if why else done, why, before, version, *kept, now, deleted)):
                col.append(v)
        kinds = {"seq": pa.int64(), "version_before": pa.int64(), "version_after": pa.int64(), "is_deleted": pa.int32(), "work_items": pa.list_(pa.string())}
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(_OUT, out)], _OUT)


def _filled(rows: DataFrame, **kinds: str) -> DataFrame:
    """rows with null columns of these names and kinds where they lack them."""
    return rows.withColumns({c: (F.col(c) if c in rows.columns else F.lit(None)).cast(k) for c, k in kinds.items()})


def apply_commands(commands: DataFrame, tasks: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Event rows of commands(seq, task_id, event_key, db_action, expected_version, status and any of FIELDS and source_key).

    tasks: what is stored (task_id, version, status, is_deleted, any of FIELDS and source_key); log: events that are there
    (event_key). An event_key counts once in the whole store: later commands of any task are duplicates, whatever came of the
    first. A CREATE whose source_key a stored task has, or one that was created before it, is a noop; one whose task is there
    already is a duplicate. A refused CREATE claims neither, so creations are settled first, round by round (``claims``).
    All else depends on the task alone: its commands are folded in order, in a stream over rows sorted by task, through
    versions. Fields that a patch leaves null stay as they are.
    """
    bin_: list[str] = []
    kinds = _KINDS | {"source_key": "string"}
    rows = _filled(commands, **kinds).select(F.col("seq").cast("long").alias("seq"), "task_id", "event_key", "db_action", F.col("expected_version").cast("long").alias("expected_version"), "status", *kinds)
    rows = split_new(log if log is not None else rows.select("event_key").limit(0), rows)
    stored = None if tasks is None else _filled(tasks, **kinds, version="long", is_deleted="int", status="string").select("task_id", F.coalesce("version", F.lit(1)).alias("version"), "status", F.coalesce("is_deleted", F.lit(0)).alias("is_deleted"), *kinds)
    rows = settle(rows, "commands", bin_)
    made = rows.filter("db_action = 'CREATE' and not duplicate").select("seq", "task_id", "source_key")
    if stored is not None:
        free = made.join(stored.select("task_id"), "task_id", "left_anti")
        made = free.join(stored.filter("source_key is not null").select("source_key"), "source_key", "left_anti")
    won = settle(claims.winners(made, ["task_id", "source_key"], "seq", bin_), "created", bin_)
    taken = won.filter("source_key is not null").select("source_key", F.col("seq").alias("_since"))
    if stored is not None:
        taken = taken.unionByName(stored.filter("source_key is not null").select("source_key", F.lit(-(1 << 62)).alias("_since")))
    taken = taken.groupBy("source_key").agg(F.min("_since").alias("_since"))
    rows = rows.join(won.select("seq", F.lit(True).alias("_won")), "seq", "left").join(taken, "source_key", "left")
    create = F.col("db_action") == "CREATE"
    verdict = (
        F.when(F.col("duplicate"), F.lit("duplicate")).when(F.col("db_action") == "NOOP", F.lit("noop"))
        .when(create & F.col("_won").isNull(), F.when(F.col("_since") < F.col("seq"), F.lit("noop")).otherwise(F.lit("duplicate")))
    )
    rows = rows.select("seq", "task_id", "event_key", "db_action", "expected_version", verdict.alias("verdict"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("int").alias("is_deleted"), "status", *_KINDS)
    if stored is not None:
        asked = rows.select("task_id").distinct()
        rows = rows.unionByName(stored.join(asked, "task_id", "left_semi").select(*(F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("event_key", "string"), ("db_action", "string"), ("expected_version", "long"), ("verdict", "string"))), "task_id", "version", "is_deleted", "status", *_KINDS))
    ordered = rows.repartition("task_id").sortWithinPartitions("task_id", F.col("version").isNull(), "seq")
    return final(ordered.mapInArrow(_apply, RESULT), "events", bin_)


def history(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Published versions of each task, newest first: place, is_latest_release; session is the latest run of the event's session."""
    kept = events.filter((F.col("execution_status") == "applied") & F.col("db_action").isin(*C.HISTORY_ACTIONS) & F.try_parse_json("after_json").isNotNull())
    last = runs.groupBy("session_id").agg(F.max_by(F.struct("run_id", "session_date"), F.struct("started_at", "run_id")).alias("_m"))
    rows = kept.join(last, F.col("source_session_id") == last["session_id"], "left").select(events["*"], F.col("_m.run_id").alias("session_run_id"), F.coalesce("_m.session_date", "created_at").alias("published_at"))
    order = Window.partitionBy("task_id").orderBy(F.coalesce("published_at", F.lit("")).desc(), F.coalesce("created_at", F.lit("")).desc(), F.col("event_id").desc())
    return rows.withColumn("place", F.row_number().over(order)).withColumn("is_latest_release", F.col("place") == 1)


def back_fill_sessions(events: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """source_session_id of events that lack it: from their run, else the task named in the event key, else the stored JSON (after, then before)."""
    by_run = runs.groupBy("run_id").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("_by_run"))
    key = events.withColumn("_task", F.regexp_extract("event_key", r"^(?:[a-z-]+:)?([^:]+)", 1))
    by_task = tasks.select(F.col("task_id").alias("_task"), F.col("source_session_id").alias("_by_task"))
    out = key.join(by_run, "run_id", "left").join(by_task, "_task", "left")
    return out.select(*(c for c in events.columns if c != "source_session_id"), F.coalesce("source_session_id", "_by_run", "_by_task", *_stored(events, "$.source_session_id")).alias("source_session_id"))


def _stored(events: DataFrame, path: str) -> list:
    """A value of the snapshots that events carry, as far as these are JSON."""
    return [F.nullif(F.try_variant_get(F.try_parse_json(c), path, "string"), F.lit("")) for c in ("after_json", "before_json") if c in events.columns]


def run_summary(events: DataFrame) -> DataFrame:
    """Counters of each run."""
    s = F.col("execution_status")
    return events.groupBy("run_id").agg(F.count("*").alias("command_count"), F.count_if(s == "applied").alias("applied_count"), F.count_if(s.isin("noop", "duplicate")).alias("noop_count"), F.count_if(s == "failed").alias("failed_count"), F.count_distinct(F.when(s == "applied", F.col("task_id"))).alias("task_count"))


def review_id(session: str, candidate: str, payload: str):
    return F.concat(F.lit("R"), F.upper(F.substring(F.sha2(F.concat_ws(":", session, candidate, payload), 256), 1, 20)))


def resolve_reviews(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """The queue after answers(candidate_id, seq, verdict): the first answer to a pending row counts."""
    first = answers.filter(F.col("verdict").isin("approved", "rejected")).groupBy("candidate_id").agg(F.min_by("verdict", "seq").alias("_v"))
    return queue.join(first, "candidate_id", "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("_v", "status")).otherwise(F.col("status"))).drop("_v")


def link_projects(tasks: DataFrame, links: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with project_id of links(task_id, project_id) whose project exists, and the links whose project doesn't."""
    good = links.join(projects.select("project_id"), "project_id", "left_semi").groupBy("task_id").agg(F.max("project_id").alias("_p"))
    out = tasks.join(good, "task_id", "left").withColumn("project_id", F.coalesce("_p", "project_id")).drop("_p")
    return out, links.join(projects.select("project_id"), "project_id", "left_anti")


def training_rows(tasks: DataFrame, least: int = C.EXPORT_MIN_CHARS, around: int = C.EXPORT_NEIGHBOURS, block: int = ordered.BLOCK) -> DataFrame:
    """Tasks with enough evidence, with the evidence of their neighbours in the session, by natural order of source_key.

    A session of more than ``block`` tasks is cut into blocks that see each other's edge rows.
    """
    kept = tasks.filter(F.length(T.strip(F.col("evidence_text"))) >= least).withColumn("_k", T.natural_key(F.col("source_key")))

    def made(w):
        texts = lambda a, b: F.array_join(F.collect_list("evidence_text").over(w.rowsBetween(a, b)), "\n")
        return {"previous_text": texts(-around, -1), "following_text": texts(1, around)}

    return ordered.neighbours(kept, ["source_session_id"], ["_k", "task_id"], around, made, "place", block).drop("_k")
