"""Queries over manual edits, approvals, migrations, imports and model edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import importer, manual, models
from . import domain as D, matching as M
from .registry import query


@query(M.IMPORT)
def import_batch(spark, sf_dir):
    """Every candidate in order against tasks as earlier candidates left them."""
    cands, tasks = M._sides(spark, sf_dir)
    return importer.import_batch(cands, tasks.withColumn("version", F.lit(1))).select("candidate_id", "decision", "reason", "db_action", "task_id", "version", F.round("score", 9).alias("score"))


_EDITS = "WITH" + D.TASKS + """, ed AS (SELECT 'T' || CAST(l_orderkey AS VARCHAR) AS task_id, l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS seq, CASE WHEN l_linenumber = 4 THEN 'delete' ELSE 'edit' END AS action, CASE l_linenumber WHEN 1 THEN 'n' || CAST(l_orderkey AS VARCHAR) WHEN 2 THEN ' ' END AS priority FROM lineitem),
lv AS (SELECT ed.*, coalesce(bool_or(action = 'delete') OVER (PARTITION BY ed.task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM ed JOIN tasks ON ed.task_id = tasks.task_id AND is_deleted = 0),
ct AS (SELECT *, 1 + row_number() OVER (PARTITION BY task_id ORDER BY seq) AS version FROM lv WHERE NOT gone)
"""


def _edits(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_extendedprice")
    line = D.read(spark, sf_dir, "lineitem").withColumn("_r", F.row_number().over(w))
    return line.selectExpr("concat('T', cast(l_orderkey as string)) as task_id", "l_orderkey * 1000 + l_linenumber * 100 + _r as seq", "case when l_linenumber = 4 then 'delete' else 'edit' end as action", "case l_linenumber when 1 then concat('n', cast(l_orderkey as string)) when 2 then ' ' end as priority")


@query(_EDITS + "SELECT task_id, seq, CASE WHEN action = 'delete' THEN 'HUMAN_SOFT_DELETE' ELSE 'HUMAN_UPDATE' END AS db_action, version FROM ct")
def manual_events(spark, sf_dir):
    return manual.update(D.tasks(spark, sf_dir).withColumn("version", F.lit(1)), _edits(spark, sf_dir))[1]


@query(_EDITS + ", la AS (SELECT task_id, arg_max(priority, seq) FILTER (WHERE priority IS NOT NULL) AS p, max(version) AS v, bool_or(action = 'delete') AS del FROM ct GROUP BY task_id) SELECT tasks.task_id, CASE WHEN p IS NULL THEN priority ELSE nullif(trim(p), '') END AS priority, coalesce(v, 1) AS version, CASE WHEN del THEN 1 ELSE is_deleted END AS is_deleted, CASE WHEN del THEN 'cancelled' ELSE status END AS status FROM tasks LEFT JOIN la ON la.task_id = tasks.task_id")
def manual_ops(spark, sf_dir):
    return manual.update(D.tasks(spark, sf_dir).withColumn("version", F.lit(1)), _edits(spark, sf_dir))[0].select("task_id", "priority", F.col("version").cast("long").alias("version"), "is_deleted", "status")


_GROUPS = "WITH g AS (SELECT o_custkey AS group_id, o_orderkey AS ord, 'T' || CAST(o_orderkey AS VARCHAR) AS task_id, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS step, min(o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders)\n"


def _groups(spark, sf_dir):
    return D.read(spark, sf_dir, "orders").selectExpr("o_custkey as group_id", "o_orderkey as ord", "concat('T', cast(o_orderkey as string)) as task_id", "o_orderpriority as title", "1 as version")


@query(_GROUPS + "SELECT group_id, step, 0 AS part, 'UPDATE_FIELDS' AS db_action, 'T' || CAST(c AS VARCHAR) AS target_task_id, step AS expected_version, title FROM g WHERE step > 0 UNION ALL SELECT group_id, step, 1, 'SOFT_DELETE', task_id, 1, NULL FROM g WHERE step > 0")
def duplicate_replay(spark, sf_dir):
    return manual.replay_duplicates(_groups(spark, sf_dir)).select("group_id", "step", "part", "db_action", "target_task_id", F.col("expected_version").cast("long").alias("expected_version"), "title")


@query(_GROUPS + "SELECT group_id, task_id, 'T' || CAST(c AS VARCHAR) AS into_task, CASE WHEN ord = c THEN 'GRANULARITY_MERGE' ELSE 'MERGED_INTO' END AS db_action FROM g WHERE group_id % 3 <> 0")
def merge_ids(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    done = manual.merge_tasks(groups.filter("group_id % 3 = 0"), spark.createDataFrame([], "event_key string"))
    return manual.merge_tasks(groups, done).select("group_id", "task_id", F.col("into").alias("into_task"), "db_action")


# every document is a review; three requests on it: nothing given, a title and a state, a title that comes late
_REVIEWS = "WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS named, doc_id % 7 = 0 AS done, source, " + D.strip("text") + """ AS ev FROM documents),
r AS (SELECT d.*, s.seq, CASE s.seq WHEN 1 THEN CASE WHEN named THEN 'x' ELSE '' END WHEN 2 THEN 'given' ELSE 'late' END AS title, CASE WHEN s.seq = 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'completed' ELSE 'in_progress' END ELSE 'open' END AS status, CASE WHEN s.seq = 2 THEN 'P' END AS project FROM d, (VALUES (1), (2), (3)) s(seq)),
f AS (SELECT *, CASE WHEN done THEN 'already_resolved' WHEN title = '' THEN 'title_required' WHEN ev = '' THEN 'evidence_required' WHEN status = 'completed' THEN 'initial_status' END AS own FROM r),
q AS (SELECT *, CASE WHEN count(*) FILTER (WHERE own IS NULL) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'already_resolved' ELSE own END AS fault FROM f)
"""


def _approvals(spark, sf_dir):
    docs = D.read(spark, sf_dir, "documents")
    key = F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate_id")
    whole = F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit("x")).otherwise(F.lit("")).alias("title"), F.col("text").alias("evidence"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("department"))
    reviews = docs.select(key, F.lit("M").alias("session_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("approved")).otherwise(F.lit("pending")).alias("status"), F.to_json(whole).alias("candidate_json"))
    given = F.to_json(F.struct(F.lit("given").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("completed")).otherwise(F.lit("in_progress")).alias("status"), F.lit("P").alias("project")))
    requests = docs.select(key, F.posexplode(F.array(F.lit("{}"), given, F.lit('{"title":"late"}'))).alias("seq", "payload_json")).withColumn("seq", F.col("seq") + 1)
    return reviews, manual.approve(reviews, requests)


@query(_REVIEWS + "SELECT 'c' || CAST(doc_id AS VARCHAR) AS candidate_id, seq, fault, CASE WHEN fault IS NULL THEN title END AS title, CASE WHEN fault IS NULL THEN ev END AS evidence, CASE WHEN fault IS NULL THEN status END AS status, CASE WHEN fault IS NULL AND doc_id % 3 = 0 THEN source END AS department, CASE WHEN fault IS NULL THEN project END AS project, CASE WHEN fault IS NULL THEN CASE WHEN project IS NOT NULL OR doc_id % 3 = 0 AND source IS NOT NULL THEN 2 ELSE 1 END END AS version FROM q")
def review_approve(spark, sf_dir):
    return _approvals(spark, sf_dir)[1].select("candidate_id", "seq", "fault", "title", "evidence", "status", "department", "project", "version")


@query(_REVIEWS + ", w AS (SELECT doc_id FROM q WHERE fault IS NULL) SELECT 'c' || CAST(doc_id AS VARCHAR) AS candidate_id, CASE WHEN done OR doc_id IN (FROM w) THEN 'approved' ELSE 'pending' END AS status, CASE WHEN doc_id IN (FROM w) THEN 'T' || left(sha256('c' || CAST(doc_id AS VARCHAR)), 10) END AS task_id FROM d")
def review_settle(spark, sf_dir):
    return manual.settled_reviews(*_approvals(spark, sf_dir)).select("candidate_id", "status", "task_id")


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'existing' WHEN 1 THEN 'new' WHEN 2 THEN 'none' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'existing' ELSE 'new' END WHEN 4 THEN 'existing' ELSE 'none' END AS resolution FROM part")
def resolution_spelling(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, (" Matched ", "new_project", "UNKNOWN", "odd", "reuse", "no_project"))), F.col("p_size") % 6 + 1)
    return D.read(spark, sf_dir, "part").select("p_partkey", models.resolution(word, F.when(F.col("p_partkey") % 2 == 0, F.lit("P1")), F.col("p_name")).alias("resolution"))


@query("SELECT conv_id, turn, 'UP_' || left(sha256('2026-01-0' || CAST(turn AS VARCHAR) || chr(0) || role || chr(0) || sha256(text)), 20) AS session_id, strlen(text) AS n_bytes FROM conversations")
def upload_ids(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.digest_id("UP_", 20, F.concat(F.lit("2026-01-0"), F.col("turn").cast("string")), F.col("role"), F.sha2("text", 256)).alias("session_id"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("WITH" + D.TASKS + r" SELECT task_id, CASE WHEN o_custkey % 9 = 0 THEN 'D0' ELSE regexp_extract(description, '(?:^|\n)部门：\s*([^\n]+)', 1) END AS department, '项目级任务' AS category, 'body ' || substring(task_id, 2) AS body FROM tasks")
def task_cards(spark, sf_dir):
    d = F.col("description")
    rows = D.tasks(spark, sf_dir).withColumns({"department": F.coalesce(F.nullif(F.lit(""), F.lit("")), T.label_line(d, "部门")), "project": T.label_line(d, "项目")})
    return rows.select("task_id", "department", F.when((F.col("department") != "") | (F.col("project") != ""), F.lit("项目级任务")).otherwise(F.lit("存量任务")).alias("category"), T.without_label_lines(d, ("部门", "项目", "优先级")).alias("body"))


@query("WITH w AS (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT (SELECT count(DISTINCT id) FROM w) AS requested, (SELECT count(DISTINCT id) FROM w WHERE id IN (SELECT c_custkey FROM k)) AS available, (SELECT count(DISTINCT id) FROM w WHERE id NOT IN (SELECT c_custkey FROM k)) AS missing")
def allow_list(spark, sf_dir):
    wanted = D.read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct()
    known = D.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("k"))
    return wanted.join(known, "id", "left").agg(F.count("*").alias("requested"), F.count("k").alias("available"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN '' ELSE CAST(conv_id // 2 AS VARCHAR) END AS segment_id, CASE WHEN turn % 5 = 0 THEN '1' ELSE '00' || CAST(turn AS VARCHAR) END AS subsegment_id, text AS text_raw, CASE WHEN turn % 3 = 0 THEN 'odd' ELSE 'task' END AS task_category FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY segment_id, subsegment_id) AS n FROM r) SELECT conv_id, turn, CASE WHEN segment_id = '' THEN 'segment_id_blank' WHEN NOT regexp_full_match(subsegment_id, '[0-9]{3}') THEN 'subsegment_id_format' WHEN trim(text_raw) = '' THEN 'text_blank' WHEN task_category = 'odd' THEN 'unknown_category' WHEN n > 1 THEN 'key_repeated' ELSE 'ok' END AS fault FROM n")
def record_contract(spark, sf_dir):
    from ..operators import records

    rows = D.read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "case when turn % 7 = 0 then '' else cast(conv_id div 2 as string) end as segment_id", "case when turn % 5 = 0 then '1' else concat('00', cast(turn as string)) end as subsegment_id", "text as text_raw", "case when turn % 3 = 0 then 'odd' else 'task' end as task_category")
    return records.labelled_record_fault(rows).select("conv_id", "turn", F.coalesce("fault", F.lit("ok")).alias("fault"))


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'unsupported_suffix' WHEN p_size % 5 = 0 THEN 'empty_file' WHEN p_size > 40 THEN 'too_large' WHEN p_size % 7 = 0 THEN 'bad_date' WHEN p_size % 11 = 0 THEN 'type_required' ELSE 'ok' END AS fault, 'LOCAL_' || left(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '_', 'g') || '_v1', 40) AS session_id FROM part")
def upload_checks(spark, sf_dir):
    from ..operators import records

    rows = D.read(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_size % 5 = 0 then 0L else cast(p_size as bigint) * 786432 end as n", "case when p_size % 6 = 0 then 'exe' else 'pdf' end as suffix", "case when p_size % 7 = 0 then '2026-13-01' else '2026-01-31' end as day", "case when p_size % 11 = 0 then ' ' else 'weekly' end as kind", "concat('/in/a.b/', p_name, '.v1.pdf') as path")
    return rows.select("p_partkey", F.coalesce(records.upload_fault(F.col("n"), F.col("suffix"), F.col("day"), F.col("kind")), F.lit("ok")).alias("fault"), T.local_session_id(F.col("path")).alias("session_id"))


@query("WITH" + D.TASKS + ", x AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, task_id) AS row_number FROM tasks WHERE is_deleted = 0) SELECT task_id, project_id, row_number FROM x WHERE row_number BETWEEN 4 AND 6")
def task_page(spark, sf_dir):
    from ..operators import records

    return records.page(D.tasks(spark, sf_dir).filter("is_deleted = 0"), [F.desc("created_at"), "task_id"], 2, 3, within="project_id").select("task_id", "project_id", "row_number")


@query("WITH" + D.TASKS + ", d AS (SELECT task_id, CASE WHEN o_custkey % 3 = 0 THEN '[\"a\",\"b\"]' WHEN o_custkey % 3 = 1 THEN '{broken' END AS j, CASE WHEN o_custkey % 2 = 0 THEN 'own' END AS dep, o_custkey FROM tasks) SELECT task_id, CASE WHEN j = '[\"a\",\"b\"]' THEN 2 ELSE 0 END AS n_items, coalesce(dep, 'D' || CAST(o_custkey % 9 AS VARCHAR)) AS department, 'P' || CAST(o_custkey % 40 AS VARCHAR) AS project FROM d")
def task_decode(spark, sf_dir):
    from ..operators import records

    rows = D.tasks(spark, sf_dir).withColumns({"work_items_json": F.expr("case when o_custkey % 3 = 0 then '[\"a\",\"b\"]' when o_custkey % 3 = 1 then '{broken' end"), "department": F.expr("case when o_custkey % 2 = 0 then 'own' end"), "project": F.lit(" ")})
    return records.decoded(rows).select("task_id", F.size("work_items").alias("n_items"), "department", "project")


@query("WITH" + D.TASK_LOG + ", f AS (SELECT event_key || ':failed:' || run_id AS event_key, seq, left('reason ' || CAST(seq AS VARCHAR), 500) AS failure_reason FROM task_log WHERE execution_status = 'failed') SELECT event_key, min(seq) AS seq, arg_min(failure_reason, seq) AS failure_reason FROM f GROUP BY event_key")
def failed_events(spark, sf_dir):
    from ..operators import records

    log = D.task_log(spark, sf_dir)
    failures = log.filter("execution_status = 'failed'").select("event_key", "run_id", "seq", F.concat(F.lit("reason "), F.col("seq").cast("string")).alias("failure_reason"))
    return records.failed_events(log, failures).select("event_key", "seq", "failure_reason")


@query("WITH" + D.RUNS + "," + D.TASK_LOG + ", c AS (SELECT run_id, seq, CASE WHEN seq % 3 > 0 THEN CASE WHEN seq % 2 = 0 THEN 'completed' ELSE 'failed' END END AS s, CASE WHEN seq % 10 = 0 THEN 'error ' || CAST(seq AS VARCHAR) END AS e FROM task_log), l AS (SELECT run_id, arg_max(s, seq) FILTER (WHERE s IS NOT NULL) AS s, arg_max(e, seq) FILTER (WHERE e IS NOT NULL) AS error_summary, max(seq) AS updated_seq FROM c GROUP BY run_id) SELECT run_id, coalesce(s, status) AS status, error_summary, updated_seq FROM runs LEFT JOIN l USING (run_id)")
def run_state(spark, sf_dir):
    from ..operators import records

    changes = D.task_log(spark, sf_dir).selectExpr("run_id", "seq", "case when seq % 3 > 0 then case when seq % 2 = 0 then 'completed' else 'failed' end end as status", "case when seq % 10 = 0 then concat('error ', cast(seq as string)) end as error_summary")
    return records.run_state(D.runs(spark, sf_dir), changes).select("run_id", "status", "error_summary", "updated_seq")
