"""Manual edits, approvals and migrations: each becomes rows of the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C, text as T
from . import commands

FIELDS = ("title", "description", "assignee_raw", "deadline_raw", "department", "project", "priority", "status")


def payload_fault(creating: bool = True) -> Column:
    """What is wrong with a manual payload, or null: title and evidence for a new task, a known state, evidence never patched."""
    state = ~F.coalesce(F.col("status").isin(*C.TASK_STATES), F.lit(True))
    if creating:
        return F.when(T.strip(F.col("title")) == "", F.lit("title_required")).when(T.strip(F.col("evidence_text")) == "", F.lit("evidence_required")).when(state, F.lit("unknown_status"))
    return F.when(F.col("evidence_text").isNotNull(), F.lit("evidence_is_fixed")).when(F.col("title").isNotNull() & (T.strip(F.col("title")) == ""), F.lit("title_required")).when(state, F.lit("unknown_status"))


def create(payloads: DataFrame) -> DataFrame:
    """HUMAN_CREATE rows of payloads without a fault; blanks become null, the state defaults to open."""
    good = payloads.filter(payload_fault().isNull())
    return good.withColumns({f: T.nullable(F.col(f)) for f in FIELDS if f != "status"} | {"status": F.coalesce("status", F.lit("open")), "db_action": F.lit("HUMAN_CREATE"), "source_session_id": F.coalesce(T.nullable(F.col("source_session_id")), F.lit("MANUAL")), "version": F.lit(1)})


def update(tasks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks after edits(task_id, seq, fields), and one HUMAN_UPDATE or HUMAN_SOFT_DELETE row for each edit of a task that is there.

    A field's last edit that isn't null counts; a blank clears it. An edit with action delete cancels the task; later ones of it fail.
    """
    live = edits.join(tasks.filter("is_deleted = 0").select("task_id", F.col("version").alias("_v0")), "task_id")
    w = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("_gone", F.coalesce(F.bool_or(F.col("action") == "delete").over(w), F.lit(False))).filter("not _gone")
    counted = live.withColumns({"version": F.col("_v0") + F.row_number().over(Window.partitionBy("task_id").orderBy("seq")), "db_action": F.when(F.col("action") == "delete", F.lit("HUMAN_SOFT_DELETE")).otherwise(F.lit("HUMAN_UPDATE"))})
    names = [f for f in FIELDS if f in edits.columns]
    last = counted.groupBy("task_id").agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in names), F.max("version").alias("_version"), F.bool_or(F.col("action") == "delete").alias("_del"))
    out = tasks.join(last, "task_id", "left")
    out = out.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), T.nullable(F.col(f"_{f}"))).otherwise(F.col(f)) for f in names if f in tasks.columns} | {"version": F.coalesce("_version", "version"), "is_deleted": F.when(F.col("_del"), 1).otherwise(F.col("is_deleted"))})
    if "status" in tasks.columns:
        out = out.withColumn("status", F.when(F.col("_del"), F.lit("cancelled")).otherwise(F.col("status")))
    return out.select(*tasks.columns), counted.select("task_id", "seq", "db_action", "version")


def approve(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each of requests(candidate_id, seq, payload_json) on reviews(candidate_id, session_id, status, candidate_json).

    A value of the payload goes before the candidate's; work items and metadata count as given where the payload has the field at all.
    A request without fault makes the task (version 2 if metadata follow) and settles the review, so that later ones find it resolved.
    A candidate may stand in candidate_json itself or under ``candidate`` there. Faults, the first that applies: not_found,
    already_resolved, title_required, evidence_required, work_items_not_list, initial_status, or the command's own.
    """
    doc, said = F.col("_doc"), F.coalesce("payload_json", F.lit("{}"))
    of = lambda d, f: F.get_json_object(d, f"$.{f}")
    has = lambda f: F.coalesce(F.array_contains(F.json_object_keys(said), f), F.lit(False))
    either = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    kind = lambda d: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(d), "$.work_items", "variant")), F.lit("VOID"))
    metadata = ("department", "project", "priority")

    rows = requests.select("candidate_id", "seq", "payload_json").join(reviews.select("candidate_id", "session_id", F.col("status").alias("_state"), F.coalesce(of("candidate_json", "candidate"), "candidate_json").alias("_doc")), "candidate_id", "left")
    title = T.strip(either(of(said, "title"), of(doc, "title")))
    rows = rows.withColumns({
        "title": title,
        "description": either(of(said, "description"), of(doc, "description"), title),
        "work_items": F.from_json(F.when(has("work_items"), of(said, "work_items")).otherwise(F.coalesce(either(of(doc, "work_items")), F.lit("[]"))), "array<string>"),
        "_list": F.when(has("work_items"), kind(said).startswith("ARRAY")).otherwise(either(of(doc, "work_items")).isNull() | kind(doc).startswith("ARRAY")),
        "assignee_raw": either(of(said, "assignee_raw"), of(doc, "assignee")),
        "deadline_raw": either(of(said, "deadline_raw"), of(doc, "deadline")),
        "status": F.coalesce(either(of(said, "status"), of(doc, "initial_status")), F.lit("open")),
        "evidence": T.strip(either(of(doc, "evidence"), of(doc, "source_text"))),
        "reviewer_note": either(of(said, "reviewer_note")),
    } | {f: F.when(has(f), of(said, f)).otherwise(of(doc, f)) for f in metadata})
    # what the command check reads of a CREATE
    rows = rows.withColumns({"db_action": F.lit("CREATE"), "source_text": F.col("evidence")} | {f: F.lit(None).cast("string") for f in ("target_task_id", "expected_version", "unique_target_id", "target_version")})
    fault = (
        F.when(F.col("_state").isNull(), F.lit("not_found"))
        .when(F.col("_state") != "pending", F.lit("already_resolved"))
        .when(F.col("title") == "", F.lit("title_required"))
        .when(F.col("evidence") == "", F.lit("evidence_required"))
        .when(~F.col("_list"), F.lit("work_items_not_list"))
        .when(~F.col("status").isin("open", "in_progress"), F.lit("initial_status"))
        .otherwise(commands.command_fault())
    )
    before = Window.partitionBy("candidate_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_fault", fault)
    rows = rows.withColumn("fault", F.when(F.count_if(F.col("_fault").isNull()).over(before) > 0, F.lit("already_resolved")).otherwise(F.col("_fault")))
    extra = F.coalesce(*metadata).isNotNull()
    good = lambda c: F.when(F.col("fault").isNull(), c)
    made = {
        "task_id": T.digest_id("T", 10, F.col("candidate_id")),
        "source_key": F.concat("session_id", F.lit(":review_"), "candidate_id", F.lit(":001")),
        "version": F.when(extra, F.lit(2)).otherwise(F.lit(1)),
        **{f: F.col(f) for f in ("title", "description", "work_items", "assignee_raw", "deadline_raw", "status", "evidence", "reviewer_note")},
        **{f: T.nullable(F.col(f)) for f in metadata},
    }
    return rows.select("candidate_id", "seq", "fault", *(good(c).alias(f) for f, c in made.items()))


def approval_events(decided: DataFrame) -> DataFrame:
    """Event rows of ``approve``: CREATE, and HUMAN_UPDATE where metadata followed."""
    return decided.filter("fault is null").select(F.explode(F.when(F.col("version") == 2, F.array(F.lit("CREATE"), F.lit("HUMAN_UPDATE"))).otherwise(F.array(F.lit("CREATE")))).alias("db_action"), "task_id", "source_key").withColumn("version", F.when(F.col("db_action") == "CREATE", 1).otherwise(2))


def settled_reviews(reviews: DataFrame, decided: DataFrame) -> DataFrame:
    """The queue after ``approve``: approved rows carry their task and note. At most one request of a review is without fault."""
    won = decided.filter("fault is null").select("candidate_id", F.col("task_id").alias("_task"), F.col("reviewer_note").alias("_note"))
    out = reviews.drop("task_id", "reviewer_note").join(won, "candidate_id", "left")
    return out.withColumns({"status": F.when(F.col("_task").isNotNull(), F.lit("approved")).otherwise(F.col("status")), "task_id": F.col("_task"), "reviewer_note": F.col("_note")}).drop("_task", "_note")


def replay_duplicates(groups: DataFrame) -> DataFrame:
    """Commands that fold duplicates into their canonical task: for each, an update of the canonical one, then its soft delete.

    groups(group_id, ord, task_id, title, version); the first row of a group is canonical.
    """
    first = groups.groupBy("group_id").agg(F.min_by(F.struct("task_id", "version"), "ord").alias("_c"))
    rows = groups.join(first, "group_id").withColumn("step", F.row_number().over(Window.partitionBy("group_id").orderBy("ord")) - 1).filter("step > 0")
    update = F.struct(F.lit("UPDATE_FIELDS").alias("db_action"), F.col("_c.task_id").alias("target_task_id"), (F.col("_c.version") + F.col("step") - 1).alias("expected_version"), F.col("title").alias("title"))
    delete = F.struct(F.lit("SOFT_DELETE").alias("db_action"), F.col("task_id").alias("target_task_id"), F.col("version").cast("long").alias("expected_version"), F.lit(None).cast("string").alias("title"))
    return rows.select("group_id", "step", F.posexplode(F.array(update, delete)).alias("part", "c")).select("group_id", "step", "part", "c.*")


def merge_tasks(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Events that merge each group's tasks into its first: GRANULARITY_MERGE there, MERGED_INTO on the others.

    Groups whose marker stands in done(event_key) already give no rows, so that a second run changes nothing.
    """
    first = groups.groupBy("group_id").agg(F.min_by("task_id", "ord").alias("into"))
    rows = groups.join(first, "group_id").withColumn("db_action", F.when(F.col("task_id") == F.col("into"), F.lit("GRANULARITY_MERGE")).otherwise(F.lit("MERGED_INTO")))
    rows = rows.withColumn("event_key", F.concat_ws(":", F.lit("merge"), "group_id", "task_id"))
    marks = rows.filter("db_action = 'GRANULARITY_MERGE'").select("group_id", "event_key").join(done.select("event_key"), "event_key", "left_semi").select("group_id")
    return rows.join(marks, "group_id", "left_anti").select("group_id", "task_id", "into", "db_action", "event_key")
