"""Queries over task candidates: normalising, merging, gating, commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as K, commands
from . import domain as D
from .registry import query


@query("WITH" + D.NORM + " SELECT ord, department, project, title, description, array_to_string(work_items, '|') AS work_items, assignee, deadline, priority, status, evidence, confidence FROM norm")
def cand_normalize(spark, sf_dir):
    return K.normalize(D.cands(spark, sf_dir)).select("ord", "department", "project", "title", "description", F.array_join("work_items", "|").alias("work_items"), "assignee", "deadline", "priority", "status", "evidence", "confidence")


_MERGE = (
    "WITH" + D.NORM + """,
g AS (SELECT department, CASE WHEN project = '' THEN title ELSE project END AS subject, count(*) AS n_merged, min(ord) AS ord, arg_min(project, ord) AS project, arg_min(title, ord) AS title,
  coalesce(arg_min(assignee, ord) FILTER (WHERE assignee <> ''), '') AS assignee, coalesce(arg_min(deadline, ord) FILTER (WHERE deadline <> ''), '') AS deadline, min(confidence) AS confidence,
  min(CASE priority WHEN '高' THEN 0 WHEN '中' THEN 1 ELSE 2 END) AS p, min(CASE status WHEN '进行中' THEN 0 WHEN '待执行' THEN 1 WHEN '已延期' THEN 2 ELSE 3 END) AS s,
  list(evidence ORDER BY ord) AS ev, list(work_items ORDER BY ord) AS wi, list(description ORDER BY ord) AS de FROM norm GROUP BY 1, 2),
m AS (SELECT *, list_reduce(ev, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || x END) AS evidence,
  list_filter(flatten(list_transform(wi, lambda w, i: CASE WHEN i = 1 THEN w ELSE list_append(w, de[i]) END)), lambda x: x <> '') AS items FROM g),
merged AS (SELECT ord, department, project, title, assignee, deadline, confidence, n_merged, evidence, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), '|') AS work_items, ['高','中','低'][p + 1] AS priority, ['进行中','待执行','已延期','已完成'][s + 1] AS status, p FROM m)
"""
)


@query(_MERGE + "SELECT * EXCLUDE (p) FROM merged")
def cand_merge(spark, sf_dir):
    return K.merge(D.cands(spark, sf_dir)).select("ord", "department", "project", "title", "assignee", "deadline", "confidence", "n_merged", "evidence", F.array_join("work_items", "|").alias("work_items"), "priority", "status")


@query(_MERGE + "SELECT ord, department, row_number() OVER (PARTITION BY department ORDER BY p, department, project, title, ord) AS place FROM merged")
def cand_order(spark, sf_dir):
    return K.sorted_rank(K.merge(D.cands(spark, sf_dir)), per="department").select("ord", "department", "place")


_GATE = (
    "WITH" + D.CANDS + f""",
gc AS (SELECT ord, {D.strip('department')} AS department, {D.strip('project')} AS project, {D.strip('title')} AS title, {D.strip('description')} AS description, {D.strip('assignee')} AS assignee, {D.strip('deadline')} AS deadline, {D.strip('priority')} AS priority, {D.strip('status')} AS status, {D.strip('evidence')} AS evidence, confidence,
  list_filter(list_transform(work_items, lambda x: {D.strip('x')}), lambda x: x <> '') AS wi FROM cands),
gated AS (SELECT *, CASE WHEN department = '' OR project = '' OR title = '' OR evidence = '' THEN 'missing_' || concat_ws('_', CASE WHEN department = '' THEN 'department' END, CASE WHEN project = '' THEN 'project' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN evidence = '' THEN 'evidence' END)
  WHEN status NOT IN ('待执行','进行中') THEN 'non_active_initial_status' WHEN confidence < 0.8 THEN 'low_model_confidence' END AS reason FROM gc)
"""
)


@query(_GATE + "SELECT ord, 'c-' || lpad(CAST(ord + 1 AS VARCHAR), CAST(greatest(3, length(CAST(ord + 1 AS VARCHAR))) AS INTEGER), '0') AS candidate_id, reason, CASE WHEN reason IS NULL THEN 'EXTRACT' ELSE 'HUMAN_REVIEW' END AS route, CASE WHEN reason = 'low_model_confidence' THEN 'model' END AS confidence_source FROM gated")
def gate_rows(spark, sf_dir):
    return K.gate(D.cands(spark, sf_dir)).select("ord", "candidate_id", "reason", "route", "confidence_source")


@query(_GATE + "SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM gated GROUP BY 1")
def gate_reason_counts(spark, sf_dir):
    return K.gate(D.cands(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def _line(label, x):
    return f"CASE WHEN {x} <> '' THEN '{label}：' || {x} END"


@query(_GATE + f"SELECT ord, concat_ws(chr(10), {_line('部门', 'department')}, {_line('项目', 'project')}, {_line('任务', 'title')}, {_line('描述', 'description')}, CASE WHEN len(wi) > 0 THEN '事项：' || array_to_string(wi, '；') END, {_line('责任人', 'assignee')}, {_line('期限', 'deadline')}, {_line('证据', 'evidence')}) AS source_text, '部门：' || department || chr(10) || '项目：' || project || chr(10) || description || chr(10) || '优先级：' || priority AS description_lines FROM gated")
def source_text_build(spark, sf_dir):
    return K.gate(D.cands(spark, sf_dir)).select("ord", "source_text", K.description_lines().alias("description_lines"))


@query("WITH" + D.TASKS + r" SELECT task_id, regexp_extract(description, '(?:^|\n)部门：\s*([^\n]+)', 1) AS department, regexp_extract(description, '(?:^|\n)优先级：\s*([^\n]+)', 1) AS priority_line, 'body ' || substring(task_id, 2) AS body FROM tasks")
def label_lines(spark, sf_dir):
    d = F.col("description")
    return D.tasks(spark, sf_dir).select("task_id", T.label_line(d, "部门").alias("department"), T.label_line(d, "优先级").alias("priority_line"), T.without_label_lines(d, ("部门", "项目", "优先级")).alias("body"))


_COMMANDS = (
    "WITH" + D.TASKS + """,
dc AS (SELECT task_id, ['CREATE','UPDATE','REVIEW'][CAST(substring(task_id, 2) AS BIGINT) % 3 + 1] AS decision, ['待执行','进行中','已完成','已延期','x'][CAST(substring(task_id, 2) AS BIGINT) % 5 + 1] AS st, status AS task_status FROM tasks),
mp AS (SELECT *, CASE st WHEN '待执行' THEN 'open' WHEN '进行中' THEN 'in_progress' WHEN '已完成' THEN 'completed' WHEN '已延期' THEN 'blocked' ELSE 'open' END AS new FROM dc),
ch AS (SELECT task_id, decision, CASE WHEN decision = 'CREATE' THEN 'CREATE' WHEN decision = 'REVIEW' THEN 'NOOP' WHEN new <> task_status THEN 'UPDATE_STATUS' ELSE 'UPDATE_FIELDS' END AS db_action, new FROM mp)
"""
)


@query(_COMMANDS + "SELECT task_id, db_action, CASE WHEN db_action IN ('CREATE', 'UPDATE_STATUS') THEN new END AS new_status FROM ch")
def command_choice(spark, sf_dir):
    k = "cast(substring(task_id, 2) as bigint)"
    rows = D.tasks(spark, sf_dir).selectExpr("task_id", f"element_at(array('CREATE','UPDATE','REVIEW'), cast({k} % 3 + 1 as int)) as decision", f"element_at(array('待执行','进行中','已完成','已延期','x'), cast({k} % 5 + 1 as int)) as status", "status as task_status")
    return commands.choose(rows).select("task_id", "db_action", "new_status")


@query(
    "WITH" + D.TASK_LOG + """,
c AS (SELECT seq, CASE WHEN seq % 23 = 0 THEN 'MERGE' ELSE db_action END AS db_action, CASE WHEN db_action <> 'CREATE' OR seq % 5 = 0 THEN task_id END AS target_task_id, CASE WHEN seq % 7 = 0 THEN 'T0' ELSE task_id END AS unique_target_id,
  CASE WHEN db_action NOT IN ('CREATE', 'NOOP') THEN seq % 4 END AS expected_version, seq % 2 * 2 + seq % 4 - seq % 2 * 2 + CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS target_version,
  CASE WHEN seq % 29 = 0 THEN ' ' ELSE title END AS title, status, CASE WHEN seq % 31 = 0 THEN 'forged' ELSE substring(event_key, 2, 4) END AS evidence, event_key AS source_text FROM task_log)
SELECT seq, CASE WHEN db_action = 'MERGE' THEN 'unknown_action' WHEN trim(title) = '' THEN 'blank_patch_field' WHEN NOT contains(source_text, evidence) THEN 'evidence_not_verbatim'
  WHEN db_action = 'CREATE' AND (target_task_id IS NOT NULL OR expected_version IS NOT NULL) THEN 'create_with_target' WHEN db_action = 'CREATE' AND title IS NULL THEN 'create_without_title' WHEN db_action = 'CREATE' AND status NOT IN ('open', 'in_progress') THEN 'create_status'
  WHEN db_action IN ('UPDATE_FIELDS','UPDATE_STATUS','SOFT_DELETE') AND (target_task_id IS NULL OR target_task_id <> unique_target_id) THEN 'target_not_unique'
  WHEN db_action IN ('UPDATE_FIELDS','UPDATE_STATUS','SOFT_DELETE') AND (expected_version IS NULL OR expected_version <> target_version) THEN 'version_mismatch'
  WHEN db_action = 'UPDATE_FIELDS' AND (title IS NULL OR status IS NOT NULL) THEN 'update_fields_patch' WHEN db_action = 'UPDATE_STATUS' AND (title IS NOT NULL OR status IS NULL OR status NOT IN ('open','in_progress','blocked','completed')) THEN 'update_status_patch'
  WHEN db_action IN ('SOFT_DELETE', 'NOOP') AND (title IS NOT NULL OR status IS NOT NULL) THEN 'patch_not_empty' ELSE 'ok' END AS fault FROM c"""
)
def command_validate(spark, sf_dir):
    rows = D.task_log(spark, sf_dir).selectExpr(
        "seq", "case when seq % 23 = 0 then 'MERGE' else db_action end as db_action", "case when db_action <> 'CREATE' or seq % 5 = 0 then task_id end as target_task_id", "case when seq % 7 = 0 then 'T0' else task_id end as unique_target_id",
        "case when db_action not in ('CREATE', 'NOOP') then seq % 4 end as expected_version", "seq % 4 + case when seq % 11 = 0 then 1 else 0 end as target_version", "case when seq % 29 = 0 then ' ' else title end as title", "status",
        "case when seq % 31 = 0 then 'forged' else substring(event_key, 2, 4) end as evidence", "event_key as source_text", "cast(null as string) as description", "cast(null as array<string>) as work_items", "cast(null as string) as assignee_raw", "cast(null as string) as deadline_raw",
    )
    return rows.select("seq", F.coalesce(commands.command_fault(), F.lit("ok")).alias("fault"))


_BATCH = (
    "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey, l_quantity, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem),"
    " c AS (SELECT k, r, CASE WHEN k % 9 = 0 AND r = 2 THEN 'NOOP' ELSE 'CREATE' END AS db_action, CASE WHEN k % 4 = 0 THEN '平台' || CAST(k AS VARCHAR) || '系统' ELSE 'Goal' || CAST(k % 5 AS VARCHAR) END AS anchor, l_partkey, CASE WHEN k % 7 = 0 THEN 'a' || CAST(r AS VARCHAR) ELSE 'a' END AS assignee FROM l),"
)


@query(
    _BATCH + """
b AS (SELECT k, any_value(anchor) AS anchor, bool_and(db_action = 'CREATE') AS creates, count(DISTINCT assignee) AS na, count(*) AS n, count(DISTINCT l_partkey % 3) AS items, arg_min(anchor || ' part ' || CAST(l_partkey AS VARCHAR), r) AS t0, min(r) AS r0, bool_and(k % 6 <> 0 OR r <> 1) AS anchored FROM c GROUP BY k)
SELECT k AS source_key, creates AND na <= 1 AND items >= 2 AND anchored AS merged, n AS n_commands, CASE WHEN creates AND na <= 1 AND items >= 2 AND anchored THEN CASE WHEN anchor LIKE '%系统' THEN '建设' || anchor ELSE '推进' || anchor END ELSE CASE WHEN k % 6 = 0 THEN 'x' ELSE '' END || t0 END AS title FROM b"""
)
def granularity_merge(spark, sf_dir):
    from pyspark.sql import Window

    line = D.read(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    anchor = "case when l_orderkey % 4 = 0 then concat('平台', cast(l_orderkey as string), '系统') else concat('Goal', cast(l_orderkey % 5 as string)) end"
    rows = line.selectExpr(
        "l_orderkey as source_key", "r as command_index", "case when l_orderkey % 9 = 0 and r = 2 then 'NOOP' else 'CREATE' end as db_action", f"concat(case when l_orderkey % 6 = 0 and r = 1 then 'x' else '(1)' end, {anchor}, ' part ', cast(l_partkey as string)) as title",
        "concat('item ', cast(l_partkey % 3 as string), '。') as description", "cast(null as array<string>) as work_items", "case when l_orderkey % 7 = 0 then concat('a', cast(r as string)) else 'a' end as assignee_raw", f"concat(' (2) ', {anchor}, '：做事') as source_text",
    )
    out = commands.merge_granularity(rows)
    return out.select("source_key", "merged", F.col("n_commands").cast("long").alias("n_commands"), F.regexp_replace("title", r"^\(1\)", "").alias("title"))


@query("WITH" + D.SEGMENTS + ", r AS (SELECT segment_id, clean_text AS text, ['task','task_update','report'][ord % 3 + 1] AS cat, CASE WHEN ord % 4 > 0 THEN 'T' || CAST(ord AS VARCHAR) END AS target FROM segments), h AS (SELECT *, contains(text, 'with') AS del, contains(text, 'the') OR contains(text, 'les') AS done, contains(text, 'that') AS blk FROM r), a AS (SELECT *, CASE WHEN cat = 'task' THEN 'CREATE' WHEN cat <> 'task_update' OR target IS NULL THEN 'NOOP' WHEN del THEN 'SOFT_DELETE' WHEN done OR blk THEN 'UPDATE_STATUS' ELSE 'UPDATE_FIELDS' END AS db_action FROM h) SELECT segment_id, db_action, CASE WHEN db_action = 'UPDATE_STATUS' THEN CASE WHEN done THEN 'completed' ELSE 'blocked' END END AS status FROM a")
def rule_client(spark, sf_dir):
    rows = D.segments(spark, sf_dir).selectExpr("segment_id", "clean_text as text", "element_at(array('task','task_update','report'), cast(ord % 3 + 1 as int)) as task_category", "case when ord % 4 > 0 then concat('T', cast(ord as string)) end as target_task_id")
    return rows.select("segment_id", *(c.alias(k) for k, c in commands.rule_command({"delete": ("with",), "done": ("the", "les"), "blocked": ("that",)}).items()))
