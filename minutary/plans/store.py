"""Queries over the event log, tasks, runs and reviews."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import projects, store
from . import domain as D
from .registry import query


@query("WITH" + D.TASK_LOG + " SELECT seq, event_key, row_number() OVER (PARTITION BY event_key ORDER BY seq) > 1 OR event_key IN (SELECT event_key FROM task_log WHERE seq < 500) AS duplicate FROM task_log WHERE seq >= 500")
def event_dedupe(spark, sf_dir):
    log = D.task_log(spark, sf_dir)
    return store.split_new(log.filter("seq < 500"), log.filter("seq >= 500")).select("seq", "event_key", "duplicate")


@query("WITH" + D.TASK_LOG + " SELECT event_key, min(seq) AS seq FROM task_log WHERE seq >= 500 AND event_key NOT IN (SELECT event_key FROM task_log WHERE seq < 500) GROUP BY event_key")
def insert_or_ignore(spark, sf_dir):
    log = D.task_log(spark, sf_dir).select("event_key", "seq")
    return projects.insert_or_ignore(log.filter("seq < 500"), log.filter("seq >= 500"), "event_key", "seq").select("event_key", "seq")


_MUT = "db_action IN ('CREATE','UPDATE_FIELDS','UPDATE_STATUS','SOFT_DELETE') AND execution_status = 'applied'"


@query("WITH" + D.TASK_LOG + f" SELECT seq, task_id, count(*) FILTER (WHERE {_MUT}) OVER (PARTITION BY task_id ORDER BY seq) AS version FROM task_log")
def task_versions(spark, sf_dir):
    return store.versions(D.task_log(spark, sf_dir)).select("seq", "task_id", "version")


@query("WITH" + D.TASK_LOG + f" SELECT task_id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, CASE WHEN bool_or(db_action = 'SOFT_DELETE') THEN 'cancelled' ELSE coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), 'open') END AS status, count(*) AS version, max(CASE WHEN db_action = 'SOFT_DELETE' THEN 1 ELSE 0 END) AS is_deleted, min(seq) AS created_seq, max(seq) AS updated_seq FROM task_log WHERE {_MUT} GROUP BY task_id")
def task_snapshot(spark, sf_dir):
    return store.snapshot(D.task_log(spark, sf_dir))


#: Commands of all tasks, some with an event key that tasks share and source keys that clash; stored tasks; keys that are logged already.
_COMMANDS = D.TASK_LOG + """,
st AS (SELECT 'T' || CAST(c_custkey AS VARCHAR) AS task_id, CAST(c_custkey % 4 + 1 AS BIGINT) AS version, CASE c_custkey % 2 WHEN 0 THEN 'open' ELSE 'in_progress' END AS status, CASE WHEN c_custkey % 35 = 0 THEN 1 ELSE 0 END AS is_deleted,
  c_name AS title, 'held ' || CAST(c_custkey AS VARCHAR) AS description, CASE WHEN c_custkey % 2 = 0 THEN [c_name] END AS work_items, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS assignee_raw, CAST(NULL AS VARCHAR) AS deadline_raw,
  CASE WHEN c_custkey % 3 = 0 THEN 's' || CAST(c_custkey % 400 AS VARCHAR) END AS source_key FROM customer WHERE c_custkey % 5 = 0),
c AS (SELECT * REPLACE (CASE WHEN seq % 10 = 0 THEN 'shared:' || CAST(seq % 170 AS VARCHAR) ELSE event_key END AS event_key), CASE WHEN db_action = 'CREATE' AND seq % 11 > 0 THEN 's' || CAST(seq % 400 AS VARCHAR) END AS source_key FROM task_log),
k AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY seq) > 1 OR event_key = 'shared:0' AS dup FROM c)"""
#: Rounds of claims: rows that are first for task and source key win, rows that lose a key go.
_WON = """,
w(round, seq, task_id, source_key) AS (
  SELECT 0, seq, task_id, source_key FROM k WHERE db_action = 'CREATE' AND NOT dup AND task_id NOT IN (SELECT task_id FROM st) AND (source_key IS NULL OR source_key NOT IN (SELECT source_key FROM st WHERE source_key IS NOT NULL))
  UNION ALL
  SELECT round + 1, seq, task_id, source_key FROM (SELECT *, bool_or(ready) OVER (PARTITION BY task_id) AS t, bool_or(ready) OVER (PARTITION BY coalesce(source_key, 'none ' || seq)) AS s FROM
    (SELECT *, seq = min(seq) OVER (PARTITION BY task_id) AND seq = min(seq) OVER (PARTITION BY coalesce(source_key, 'none ' || seq)) AS ready FROM w)) WHERE NOT t AND NOT s),
won AS (SELECT seq, task_id, source_key FROM (SELECT *, seq = min(seq) OVER (PARTITION BY round, task_id) AND seq = min(seq) OVER (PARTITION BY round, coalesce(source_key, 'none ' || seq)) AS ready FROM w) WHERE ready),
tk AS (SELECT source_key, min(seq) AS since FROM (SELECT source_key, seq FROM won UNION ALL SELECT source_key, -1 FROM st) WHERE source_key IS NOT NULL GROUP BY 1)"""
_APPLY = "WITH RECURSIVE" + _COMMANDS + _WON + """,
e AS (SELECT k.seq, k.task_id, k.event_key, db_action, CASE WHEN db_action <> 'CREATE' AND k.seq % 5 = 0 THEN k.seq % 9 END AS expected,
  CASE WHEN k.seq % 6 > 0 THEN title END AS title, CASE WHEN db_action IN ('CREATE','UPDATE_FIELDS') AND k.seq % 4 = 0 THEN 'about ' || CAST(k.seq % 89 AS VARCHAR) END AS description,
  CASE WHEN db_action IN ('CREATE','UPDATE_FIELDS') AND k.seq % 7 = 0 THEN ['w' || CAST(k.seq % 5 AS VARCHAR), 'v'] END AS work_items, CASE WHEN db_action IN ('CREATE','UPDATE_FIELDS') AND k.seq % 8 = 0 THEN 'a' || CAST(k.seq % 11 AS VARCHAR) END AS assignee_raw,
  CASE WHEN db_action IN ('CREATE','UPDATE_FIELDS') AND k.seq % 9 = 0 THEN 'd' || CAST(k.seq % 13 AS VARCHAR) END AS deadline_raw, status, row_number() OVER (PARTITION BY k.task_id ORDER BY k.seq) AS r,
  CASE WHEN dup THEN 'duplicate' WHEN db_action = 'NOOP' THEN 'noop' WHEN db_action = 'CREATE' AND won.seq IS NULL THEN CASE WHEN since < k.seq THEN 'noop' ELSE 'duplicate' END END AS verdict
  FROM k LEFT JOIN won ON won.seq = k.seq LEFT JOIN tk ON tk.source_key = k.source_key),
f(task_id, r, seq, db_action, st, v0, v, title, description, work_items, assignee_raw, deadline_raw, status, del, made) AS (
  SELECT t.task_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), coalesce(st.version, 0), st.title, st.description, st.work_items, st.assignee_raw, st.deadline_raw, st.status, coalesce(st.is_deleted, 0), st.task_id IS NOT NULL
    FROM (SELECT DISTINCT task_id FROM e) t LEFT JOIN st ON st.task_id = t.task_id
  UNION ALL
  SELECT x.task_id, x.r, x.seq, x.db_action, x.st, x.v, CASE WHEN x.st = 'applied' THEN CASE WHEN x.db_action = 'CREATE' THEN 1 ELSE x.v + 1 END ELSE x.v END,
    CASE WHEN x.patch THEN coalesce(x.nt, x.ot) ELSE x.ot END, CASE WHEN x.patch THEN coalesce(x.nd, x.od) ELSE x.od END, CASE WHEN x.patch THEN coalesce(x.nw, x.ow) ELSE x.ow END, CASE WHEN x.patch THEN coalesce(x.na, x.oa) ELSE x.oa END, CASE WHEN x.patch THEN coalesce(x.nl, x.ol) ELSE x.ol END,
    CASE WHEN x.st = 'applied' THEN CASE x.db_action WHEN 'CREATE' THEN coalesce(x.ns, 'open') WHEN 'SOFT_DELETE' THEN 'cancelled' WHEN 'UPDATE_STATUS' THEN x.ns ELSE x.os END ELSE x.os END,
    CASE WHEN x.st = 'applied' AND x.db_action = 'SOFT_DELETE' THEN 1 ELSE x.del END, x.made OR (x.st = 'applied' AND x.db_action = 'CREATE')
  FROM (SELECT y.*, y.st = 'applied' AND y.db_action IN ('CREATE','UPDATE_FIELDS') AS patch FROM (SELECT e.task_id, e.r, e.seq, e.db_action, f.v, f.title AS ot, f.description AS od, f.work_items AS ow, f.assignee_raw AS oa, f.deadline_raw AS ol, f.status AS os, f.del, f.made,
      e.title AS nt, e.description AS nd, e.work_items AS nw, e.assignee_raw AS na, e.deadline_raw AS nl, e.status AS ns,
      CASE WHEN verdict IS NOT NULL THEN verdict WHEN e.db_action = 'CREATE' THEN 'applied'
        WHEN NOT f.made OR f.del = 1 OR (e.expected IS NOT NULL AND e.expected <> f.v) THEN 'failed' WHEN e.db_action = 'SOFT_DELETE' OR (e.db_action = 'UPDATE_STATUS' AND e.status IS NOT NULL)
        OR (e.db_action = 'UPDATE_FIELDS' AND (e.title IS NOT NULL OR e.description IS NOT NULL OR e.work_items IS NOT NULL OR e.assignee_raw IS NOT NULL OR e.deadline_raw IS NOT NULL)) THEN 'applied' ELSE 'failed' END AS st
    FROM f JOIN e ON e.task_id = f.task_id AND e.r = f.r + 1) y) x)
SELECT seq, task_id, db_action, st AS execution_status, v0 AS version_before, v AS version_after, title, description, array_to_string(work_items, '/') AS work_items, assignee_raw, deadline_raw, status, del AS is_deleted FROM f WHERE r > 0"""


def _stored(spark, sf_dir):
    return D.read(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").selectExpr(
        "concat('T', cast(c_custkey as string)) as task_id", "cast(c_custkey % 4 + 1 as long) as version", "case c_custkey % 2 when 0 then 'open' else 'in_progress' end as status",
        "case when c_custkey % 35 = 0 then 1 else 0 end as is_deleted", "c_name as title", "concat('held ', cast(c_custkey as string)) as description", "case when c_custkey % 2 = 0 then array(c_name) end as work_items",
        "case when c_custkey % 3 = 0 then c_mktsegment end as assignee_raw", "case when c_custkey % 3 = 0 then concat('s', cast(c_custkey % 400 as string)) end as source_key",
    )


@query(_APPLY)
def apply_log(spark, sf_dir):
    """Commands on top of stored tasks: one key for the whole store, claims of created tasks only, versions, five patch fields."""
    patch = "case when db_action in ('CREATE', 'UPDATE_FIELDS') and seq % {0} = 0 then {1} end"
    rows = D.task_log(spark, sf_dir).withColumns(
        {
            "event_key": F.expr("case when seq % 10 = 0 then concat('shared:', cast(seq % 170 as string)) else event_key end"),
            "expected_version": F.expr("case when db_action <> 'CREATE' and seq % 5 = 0 then seq % 9 end"),
            "title": F.expr("case when seq % 6 > 0 then title end"),
            "description": F.expr(patch.format(4, "concat('about ', cast(seq % 89 as string))")),
            "work_items": F.expr(patch.format(7, "array(concat('w', cast(seq % 5 as string)), 'v')")),
            "assignee_raw": F.expr(patch.format(8, "concat('a', cast(seq % 11 as string))")),
            "deadline_raw": F.expr(patch.format(9, "concat('d', cast(seq % 13 as string))")),
            "source_key": F.expr("case when db_action = 'CREATE' and seq % 11 > 0 then concat('s', cast(seq % 400 as string)) end"),
        }
    )
    out = store.apply_commands(rows, _stored(spark, sf_dir), rows.filter("event_key = 'shared:0'").select("event_key"))
    return out.select("seq", "task_id", "db_action", "execution_status", "version_before", "version_after", "title", "description", F.array_join("work_items", "/").alias("work_items"), "assignee_raw", "deadline_raw", "status", "is_deleted")


_SERVICE = """WITH r AS (SELECT l_orderkey AS k, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq, l_linenumber AS n, l_returnflag AS text FROM lineitem),
o AS (SELECT o_orderkey AS k, CAST(o_custkey % 5 + 1 AS BIGINT) AS v0, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS del0, o_orderpriority AS title0, 'about ' || CAST(o_orderkey AS VARCHAR) AS description, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status0 FROM orders),
x AS (SELECT r.*, v0, title0, description, status0, CASE WHEN n = 4 THEN 'SOFT_DELETE' WHEN n = 1 THEN 'UPDATE_FIELDS' WHEN n = 2 THEN 'UPDATE_STATUS' ELSE 'NOOP' END AS db_action,
  o.k IS NOT NULL AND del0 = 0 AND NOT coalesce(bool_or(n = 4) OVER (PARTITION BY r.k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live FROM r LEFT JOIN o ON o.k = r.k),
y AS (SELECT *, live AND db_action <> 'NOOP' AS done FROM x)
SELECT seq, 'T' || CAST(k AS VARCHAR) AS task_id, db_action, CASE WHEN db_action = 'NOOP' THEN 'noop' WHEN done THEN 'applied' ELSE 'failed' END AS execution_status, coalesce(v0, 0) + count(*) FILTER (WHERE done) OVER w AS version_after,
  coalesce(last_value(CASE WHEN done AND n = 1 THEN text END IGNORE NULLS) OVER w, title0) AS title, description, CASE WHEN bool_or(done AND n = 4) OVER w THEN 'cancelled' ELSE coalesce(last_value(CASE WHEN done AND n = 2 THEN 'blocked' END IGNORE NULLS) OVER w, status0) END AS status FROM y WINDOW w AS (PARTITION BY k ORDER BY seq)"""


@query(_SERVICE)
def service_events(spark, sf_dir):
    """Commands of a service on top of stored tasks: fields that a command leaves stay, versions go on from what is stored."""
    from ..operators import service

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    records = D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("seq"))
    made = records.selectExpr("seq as record_id", "seq", "l_returnflag as text", "concat('T', cast(l_orderkey as string)) as target_task_id", "case l_linenumber when 4 then 'SOFT_DELETE' when 1 then 'UPDATE_FIELDS' when 2 then 'UPDATE_STATUS' else 'NOOP' end as db_action", "case when l_linenumber = 2 then 'blocked' end as status")
    tasks = D.read(spark, sf_dir, "orders").selectExpr("concat('T', cast(o_orderkey as string)) as task_id", "cast(o_custkey % 5 + 1 as long) as version", "case when o_orderkey % 10 = 0 then 1 else 0 end as is_deleted", "o_orderpriority as title", "concat('about ', cast(o_orderkey as string)) as description", "case o_orderstatus when 'F' then 'completed' when 'O' then 'open' else 'in_progress' end as status")
    return service.to_events(made, tasks).select("seq", "task_id", "db_action", "execution_status", "version_after", "title", "description", "status")


@query("WITH" + D.RUNS + " SELECT session_id, arg_max(run_id, started_at) AS run_id, max(started_at) AS started_at FROM runs GROUP BY session_id")
def latest_run(spark, sf_dir):
    return projects.latest(D.runs(spark, sf_dir), "session_id", "started_at").select("session_id", "run_id", "started_at")


_HISTORY = "WITH" + D.TASK_LOG + "," + D.RUNS + """, lr AS (SELECT session_id, arg_max(session_date, started_at) AS session_date, arg_max(run_id, started_at) AS session_run_id FROM runs GROUP BY session_id),
h AS (SELECT event_id, task_id, session_run_id, coalesce(session_date, created_at) AS published_at, created_at FROM task_log LEFT JOIN lr ON lr.session_id = source_session_id WHERE execution_status = 'applied' AND db_action IN ('CREATE','UPDATE_FIELDS','UPDATE_STATUS','HUMAN_CREATE') AND json_valid(after_json)),
hp AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY published_at DESC, created_at DESC, event_id DESC) AS place FROM h)
"""


@query(_HISTORY + "SELECT event_id, task_id, session_run_id, published_at, place, place = 1 AS is_latest_release FROM hp")
def task_history(spark, sf_dir):
    return store.history(D.task_log(spark, sf_dir), D.runs(spark, sf_dir)).select("event_id", "task_id", "session_run_id", "published_at", "place", "is_latest_release")


@query(_HISTORY + ", t AS (SELECT task_id, count(*) AS n_events, max(created_at) AS last_event FROM task_log GROUP BY task_id) SELECT t.task_id, n_events, last_event, hp.event_id AS latest_release FROM t LEFT JOIN hp ON hp.task_id = t.task_id AND place = 1")
def task_detail(spark, sf_dir):
    log = D.task_log(spark, sf_dir)
    latest = store.history(log, D.runs(spark, sf_dir)).filter("is_latest_release").select("task_id", F.col("event_id").alias("latest_release"))
    return log.groupBy("task_id").agg(F.count("*").alias("n_events"), F.max("created_at").alias("last_event")).join(latest, "task_id", "left")


_BACKFILL = "WITH" + D.TASK_LOG + "," + D.RUNS + """, br AS (SELECT run_id, arg_max(session_id, started_at) AS m FROM runs GROUP BY run_id),
lg AS (SELECT * REPLACE (CASE WHEN seq % 4 = 0 THEN run_id ELSE 'none' END AS run_id), CASE WHEN seq % 7 = 0 THEN '{"source_session_id": "A' || seq || '"}' WHEN seq % 7 = 1 THEN '{bad' WHEN seq % 7 = 2 THEN '{"source_session_id": ""}' END AS after_, CASE WHEN seq % 3 = 0 THEN '{"source_session_id": "B' || seq || '"}' END AS before_ FROM task_log),
x AS (SELECT *, 'T' || nullif(regexp_extract(event_key, '^T([0-9]*[02468]):', 1), '') AS known FROM lg),
j AS (SELECT *, CASE WHEN json_valid(after_) THEN nullif(json_extract_string(after_, '$.source_session_id'), '') END AS a, CASE WHEN json_valid(before_) THEN nullif(json_extract_string(before_, '$.source_session_id'), '') END AS b FROM x)
SELECT seq, coalesce(source_session_id, br.m, 'TM' || known, a, b) AS source_session_id FROM j LEFT JOIN br USING (run_id)"""


@query(_BACKFILL)
def event_backfill(spark, sf_dir):
    """Runs are there for a quarter of the events and tasks for every second user, so that snapshots decide the rest."""
    log = D.task_log(spark, sf_dir).withColumns(
        {
            "run_id": F.expr("case when seq % 4 = 0 then run_id else 'none' end"),
            "after_json": F.expr("""case seq % 7 when 0 then concat('{"source_session_id": "A', cast(seq as string), '"}') when 1 then '{bad' when 2 then '{"source_session_id": ""}' end"""),
            "before_json": F.expr("""case when seq % 3 = 0 then concat('{"source_session_id": "B', cast(seq as string), '"}') end"""),
        }
    )
    tasks = log.filter("cast(substring(task_id, 2) as long) % 2 = 0").groupBy("task_id").agg(F.concat(F.lit("TM"), F.first("task_id")).alias("source_session_id"))
    return store.back_fill_sessions(log, D.runs(spark, sf_dir), tasks).select("seq", "source_session_id")


@query("WITH" + D.TASK_LOG + " SELECT run_id, count(*) AS command_count, count(*) FILTER (WHERE execution_status = 'applied') AS applied_count, count(*) FILTER (WHERE execution_status IN ('noop', 'duplicate')) AS noop_count, count(*) FILTER (WHERE execution_status = 'failed') AS failed_count, count(DISTINCT task_id) FILTER (WHERE execution_status = 'applied') AS task_count FROM task_log GROUP BY run_id")
def run_summary(spark, sf_dir):
    return store.run_summary(D.task_log(spark, sf_dir))


@query("WITH" + D.TASK_LOG + "," + D.RUNS + ", s AS (SELECT run_id, count(*) AS c, count(*) FILTER (WHERE execution_status = 'failed') AS f FROM task_log GROUP BY run_id) SELECT run_id, coalesce(c, 0) AS command_count, CASE WHEN coalesce(f, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM runs LEFT JOIN s USING (run_id)")
def reconcile(spark, sf_dir):
    s = store.run_summary(D.task_log(spark, sf_dir)).select("run_id", "command_count", "failed_count")
    return D.runs(spark, sf_dir).join(s, "run_id", "left").select("run_id", F.coalesce("command_count", F.lit(0)).alias("command_count"), F.when(F.coalesce("failed_count", F.lit(0)) > 0, F.lit("completed_with_errors")).otherwise(F.lit("completed")).alias("status"))


@query("WITH" + D.TASK_LOG + " SELECT execution_status, count(*) FILTER (WHERE db_action = 'CREATE') AS creates, count(*) FILTER (WHERE db_action = 'UPDATE_FIELDS') AS field_updates, count(*) FILTER (WHERE db_action = 'UPDATE_STATUS') AS status_updates, count(*) FILTER (WHERE db_action = 'SOFT_DELETE') AS deletes, count(*) AS n FROM task_log GROUP BY execution_status")
def action_counts(spark, sf_dir):
    c = lambda a, n: F.count_if(F.col("db_action") == a).alias(n)
    return D.task_log(spark, sf_dir).groupBy("execution_status").agg(c("CREATE", "creates"), c("UPDATE_FIELDS", "field_updates"), c("UPDATE_STATUS", "status_updates"), c("SOFT_DELETE", "deletes"), F.count("*").alias("n"))


@query("WITH" + D.TASKS + " SELECT task_id, project_id, status, source_session_id, row_number() OVER (PARTITION BY source_session_id ORDER BY created_at DESC, task_id) AS place FROM tasks WHERE is_deleted = 0 AND status <> 'cancelled' AND status = 'open'")
def tasks_list(spark, sf_dir):
    w = Window.partitionBy("source_session_id").orderBy(F.desc("created_at"), "task_id")
    return D.tasks(spark, sf_dir).filter("is_deleted = 0 and status <> 'cancelled' and status = 'open'").select("task_id", "project_id", "status", "source_session_id", F.row_number().over(w).alias("place"))


@query("WITH" + D.TASKS + " SELECT project_id, count(*) AS n_active, min(created_at) AS first_created FROM tasks WHERE is_deleted = 0 AND status NOT IN ('completed', 'cancelled') GROUP BY project_id")
def tasks_active(spark, sf_dir):
    return D.tasks(spark, sf_dir).filter("is_deleted = 0 and status not in ('completed', 'cancelled')").groupBy("project_id").agg(F.count("*").alias("n_active"), F.min("created_at").alias("first_created"))


@query("WITH" + D.TASK_LOG + " SELECT event_id, run_id, task_id, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, event_id DESC) AS place FROM task_log")
def events_list(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return D.task_log(spark, sf_dir).select("event_id", "run_id", "task_id", F.row_number().over(w).alias("place"))


@query("WITH" + D.RUNS + " SELECT run_id, session_id, started_at, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC) AS place, EXISTS (SELECT 1 FROM runs WHERE status = 'running') AS has_active FROM runs")
def sessions_list(spark, sf_dir):
    runs = D.runs(spark, sf_dir)
    active = runs.filter("status = 'running'").limit(1).agg((F.count("*") > 0).alias("has_active"))  # one row
    w = Window.partitionBy("session_id").orderBy(F.desc("started_at"))
    return runs.select("run_id", "session_id", "started_at", F.row_number().over(w).alias("place")).join(F.broadcast(active))


_REVIEW = "WITH" + D.CANDS + """, rq AS (SELECT ord, CAST(session AS VARCHAR) AS session_id, 'c-' || lpad(CAST(ord + 1 AS VARCHAR), CAST(greatest(3, length(CAST(ord + 1 AS VARCHAR))) AS INTEGER), '0') AS cid, 'R' || upper(left(sha256(CAST(session AS VARCHAR) || ':' || 'c-' || lpad(CAST(ord + 1 AS VARCHAR), CAST(greatest(3, length(CAST(ord + 1 AS VARCHAR))) AS INTEGER), '0') || ':' || evidence), 20)) AS candidate_id FROM cands WHERE confidence < 0.8 OR ord % 3 = 0)
"""


def _reviews(spark, sf_dir):
    rows = D.cands(spark, sf_dir).filter("confidence < 0.8 or ord % 3 = 0").withColumns({"session_id": F.col("session").cast("string"), "cid": T.position_id(F.col("ord") + 1)})
    return rows.withColumn("candidate_id", store.review_id("session_id", "cid", "evidence"))


@query(_REVIEW + "SELECT candidate_id, ord, session_id FROM rq")
def review_enqueue(spark, sf_dir):
    rows = _reviews(spark, sf_dir).select("candidate_id", "ord", "session_id")
    return projects.insert_or_ignore(rows.limit(0), rows, "candidate_id", "ord").select("candidate_id", "ord", "session_id")


@query(_REVIEW + "SELECT candidate_id, CASE ord % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM rq")
def review_resolve(spark, sf_dir):
    queue = _reviews(spark, sf_dir).withColumn("status", F.lit("pending"))
    first = queue.selectExpr("candidate_id", "ord as seq", "case ord % 4 when 0 then 'approved' when 1 then 'rejected' else 'maybe' end as verdict")
    later = first.selectExpr("candidate_id", "seq + 1000000 as seq", "case verdict when 'approved' then 'rejected' when 'rejected' then 'approved' else 'maybe' end as verdict")
    return store.resolve_reviews(queue, first.union(later)).select("candidate_id", "status")


@query("WITH" + D.TASKS + " SELECT task_id, CASE WHEN o_custkey % 5 = 0 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = (o_custkey * 2)) THEN project_id ELSE 'P' || CAST(o_custkey * 2 AS VARCHAR) END AS project_id FROM tasks")
def project_link(spark, sf_dir):
    tasks = D.tasks(spark, sf_dir)
    links = tasks.filter("o_custkey % 5 <> 0").selectExpr("task_id", "concat('P', cast(o_custkey * 2 as string)) as project_id")
    known = D.read(spark, sf_dir, "customer").selectExpr("concat('P', cast(c_custkey as string)) as project_id")
    return store.link_projects(tasks, links, known)[0].select("task_id", "project_id")


@query("WITH" + D.TASKS + " SELECT task_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, task_id) AS row_number FROM tasks WHERE contains(lower(title || ' ' || priority || ' ' || description), 'urgent') AND is_deleted = 0")
def search_page(spark, sf_dir):
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "task_id")
    hit = F.instr(F.lower(F.concat_ws(" ", "title", "priority", "description")), "urgent") > 0
    return D.tasks(spark, sf_dir).filter(hit & (F.col("is_deleted") == 0)).select("task_id", "project_id", F.row_number().over(w).alias("row_number"))


@query("WITH" + D.TASKS + r" SELECT task_id, title, trim(regexp_extract(description, '(?:^|\n)部门：\s*([^\n]+)', 1)) AS department, '' AS assignee FROM tasks WHERE is_deleted = 0 AND status NOT IN ('completed', 'cancelled')")
def stored_candidates(spark, sf_dir):
    """Active tasks as candidates: the department is that of the stored description."""
    from ..operators import matching

    return matching.active(D.tasks(spark, sf_dir)).select("task_id", "title", "department", "assignee")


_KEYWORDS = ("urgent", "HIGH 1", "p7", "特", "body 1")


@query("WITH" + D.TASKS + ", k AS (SELECT unnest(['" + "', '".join(_KEYWORDS) + "']) AS keyword) SELECT keyword, task_id FROM k JOIN tasks ON contains(lower(title || ' ' || priority || ' ' || description), lower(keyword))")
def search_index(spark, sf_dir):
    """Substring search through postings: all rows of several keywords."""
    import uuid

    from ..operators.search import SearchTable
    from ..sources import scratch

    table = SearchTable(f"{scratch.shared_folder(spark)}/search-{uuid.uuid4().hex}", "task_id", ("-created_at", "task_id"), ("title", "priority", "description"), 64)
    table.write(D.tasks(spark, sf_dir), 16)
    found = [table.hits(spark, k).select(F.lit(k).alias("keyword"), "task_id") for k in _KEYWORDS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_DEPT = r"CASE WHEN o_custkey % 9 = 0 THEN '未标注部门' ELSE regexp_extract(description, '(?:^|\n)部门：\s*([^\n]+)', 1) END"


@query("WITH" + D.TASKS + f" SELECT {_DEPT} AS department, count(*) AS n, min(CAST(substring(task_id, 2) AS BIGINT)) AS first_seen FROM tasks WHERE is_deleted = 0 GROUP BY 1")
def department_groups(spark, sf_dir):
    rows = D.tasks(spark, sf_dir).filter("is_deleted = 0").withColumns({"department": F.coalesce(F.when(F.col("o_custkey") % 9 > 0, T.nullable(T.label_line(F.col("description"), "部门"))), F.lit("未标注部门")), "n_": F.substring("task_id", 2, 20).cast("long")})
    return rows.groupBy("department").agg(F.count("*").alias("n"), F.min("n_").alias("first_seen"))


@query("WITH" + D.TASKS + r" SELECT 'department' AS facet, v, count(*) AS n FROM (SELECT regexp_extract(description, '(?:^|\n)部门：\s*([^\n]+)', 1) AS v FROM tasks) GROUP BY 2 UNION ALL SELECT 'project', v, count(*) FROM (SELECT regexp_extract(description, '(?:^|\n)项目：\s*([^\n]+)', 1) AS v FROM tasks) GROUP BY 2")
def facet_values(spark, sf_dir):
    d = F.col("description")
    both = F.array(F.struct(F.lit("department").alias("facet"), T.label_line(d, "部门").alias("v")), F.struct(F.lit("project").alias("facet"), T.label_line(d, "项目").alias("v")))
    return D.tasks(spark, sf_dir).select(F.explode(both).alias("x")).groupBy("x.facet", "x.v").agg(F.count("*").alias("n"))


_TRAIN = "WITH e AS (SELECT doc_id, doc_id // 8 AS m, text AS ev, length(regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '')) AS n FROM documents), k AS (SELECT * FROM e WHERE n >= 80)\n"


def _training(spark, sf_dir):
    return store.training_rows(D.read(spark, sf_dir, "documents").selectExpr("doc_id as task_id", "concat('m', cast(doc_id div 8 as string)) as source_session_id", "concat('c-', cast(doc_id as string)) as source_key", "text as evidence_text"))


@query(_TRAIN + "SELECT doc_id AS task_id, coalesce(string_agg(ev, chr(10) ORDER BY doc_id) OVER (PARTITION BY m ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS previous_text, coalesce(string_agg(ev, chr(10) ORDER BY doc_id) OVER (PARTITION BY m ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS following_text, row_number() OVER (PARTITION BY m ORDER BY doc_id) AS place FROM k")
def training_context(spark, sf_dir):
    return _training(spark, sf_dir).select("task_id", "previous_text", "following_text", "place")


@query(_TRAIN + "SELECT 'm' || CAST(m AS VARCHAR) AS session_id, count(*) AS sample_count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS samples FROM k GROUP BY m")
def training_manifest(spark, sf_dir):
    rows = _training(spark, sf_dir).groupBy(F.col("source_session_id").alias("session_id")).agg(F.count("*").alias("sample_count"), F.array_sort(F.collect_list("task_id")).alias("s"))
    return rows.select("session_id", "sample_count", F.array_join("s", ",").alias("samples"))


@query()
def zip_export(spark, sf_dir):
    """Archives of at most a megabyte; their manifest."""
    import uuid

    from ..sources import scratch, sinks

    rows = _training(spark, sf_dir).select(F.col("task_id").cast("string").alias("sample_id"), "evidence_text", F.to_json(F.struct("task_id", "place")).alias("label"))
    return sinks.export_archives(rows, f"{scratch.shared_folder(spark)}/export-{uuid.uuid4().hex}", 1 << 20).select("archive", "n_samples", "n_bytes")
