"""Views of the task domain over the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files give fewer splits than there are cores, dealt out to all; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task candidates: documents with labels; a project is a hundred consecutive documents of one source."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = spread(read(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    return d.selectExpr(
        "doc_id as ord",
        "case when doc_id % 13 = 0 then ' ' else source end as department",
        "case when doc_id % 11 = 0 then '' else concat(source, '-', cast(doc_id div 100 as string)) end as project",
        "concat(' ', left(split_part(text, '\\n', 1), 30)) as title",
        "text as description",
        "case when doc_id % 3 = 0 then array() else array(split_part(text, '\\n', 1), ' ', split_part(text, '\\n', 2), split_part(text, '\\n', 1)) end as work_items",
        "case when doc_id % 5 = 0 then '' else concat('a', cast(doc_id % 7 as string)) end as assignee",
        "case when doc_id % 4 = 0 then concat('d', cast(doc_id % 9 as string)) else '' end as deadline",
        "case doc_id % 4 when 0 then '高' when 1 then '中' when 2 then '低' else 'x' end as priority",
        "case doc_id % 5 when 0 then '进行中' when 1 then '待执行' when 2 then '已延期' when 3 then '已完成' else '' end as status",
        "case when doc_id % 17 = 0 then '' else split_part(text, '\\n', 1) end as evidence",
        "case quality when 1 then 0.9D when 0 then 0.5D end as confidence",
        "doc_id % 3 as session",
        "concat(source, '-', lang) as team",
        "text",
    )


CANDS = r"""
lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
cands AS (SELECT d.doc_id AS ord,
  CASE WHEN d.doc_id % 13 = 0 THEN ' ' ELSE source END AS department,
  CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE source || '-' || CAST(d.doc_id // 100 AS VARCHAR) END AS project,
  ' ' || left(split_part(text, chr(10), 1), 30) AS title,
  text AS description,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [split_part(text, chr(10), 1), ' ', split_part(text, chr(10), 2), split_part(text, chr(10), 1)] END AS work_items,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'a' || CAST(d.doc_id % 7 AS VARCHAR) END AS assignee,
  CASE WHEN d.doc_id % 4 = 0 THEN 'd' || CAST(d.doc_id % 9 AS VARCHAR) ELSE '' END AS deadline,
  CASE d.doc_id % 4 WHEN 0 THEN '高' WHEN 1 THEN '中' WHEN 2 THEN '低' ELSE 'x' END AS priority,
  CASE d.doc_id % 5 WHEN 0 THEN '进行中' WHEN 1 THEN '待执行' WHEN 2 THEN '已延期' WHEN 3 THEN '已完成' ELSE '' END AS status,
  CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS evidence,
  CASE lab.quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.5 END::DOUBLE AS confidence,
  d.doc_id % 3 AS session, source || '-' || lang AS team, text
  FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id)"""

#: SQL for stripping white space at both ends, of a placeholder.
STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def strip(x: str) -> str:
    return STRIP.format(x)


NORM = (
    CANDS
    + f""",
norm0 AS (SELECT ord, {strip('department')} AS department, {strip('project')} AS project, {strip('title')} AS title, {strip('description')} AS description,
  list_filter(list_transform(work_items, lambda x: {strip('x')}), lambda x: x <> '') AS wi, {strip('assignee')} AS assignee, {strip('deadline')} AS deadline,
  CASE WHEN priority IN ('高','中','低') THEN priority ELSE '中' END AS priority, CASE WHEN status IN ('进行中','待执行','已延期','已完成') THEN status ELSE '待执行' END AS status,
  {strip('evidence')} AS evidence, confidence, session, team FROM cands),
norm AS (SELECT * EXCLUDE (wi), CASE WHEN len(wi) = 0 AND description <> '' THEN [description] ELSE list_filter(wi, lambda x, i: list_position(wi, x) = i) END AS work_items
  FROM norm0 WHERE title <> '' AND evidence <> '')"""
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr("conv_id div 4 as file", "conv_id div 2 as session", "cast(conv_id div 2 as string) as session_title", "conv_id * 1000 + turn as ord", "concat(cast(conv_id as string), '-', cast(turn as string)) as segment_id", "role as speaker_id", "text as clean_text")


SEGMENTS = """
segments AS (SELECT conv_id // 4 AS file, conv_id // 2 AS session, CAST(conv_id // 2 AS VARCHAR) AS session_title, conv_id * 1000 + turn AS ord,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS segment_id, role AS speaker_id, text AS clean_text FROM conversations)"""


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands and events: one task a user, keys that repeat."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "concat('T', cast(user_id as string)) as task_id",
        "concat('T', cast(user_id as string), ':', event_type, ':', get_json_object(props, '$.k')) as event_key",
        "case event_type when 'signup' then 'CREATE' when 'click' then 'UPDATE_FIELDS' when 'purchase' then 'UPDATE_STATUS' when 'view' then 'NOOP' else 'SOFT_DELETE' end as db_action",
        "case when event_type = 'error' and value > 50 then 'failed' when event_type = 'view' then 'noop' else 'applied' end as execution_status",
        "case when event_type in ('signup', 'click') then concat('title ', cast(event_id % 97 as string)) end as title",
        "case when event_type = 'purchase' then case when value > 30 then 'completed' else 'in_progress' end end as status",
        "concat('R', cast(user_id % 40 as string)) as run_id",
        "case when event_id % 3 = 0 then null else concat('M', cast(user_id % 25 as string)) end as source_session_id",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as created_at",
        "lpad(cast(event_id as string), 12, '0') as event_id",
        "case when event_id % 19 = 0 then '{broken' else props end as after_json",
        "value",
    )


TASK_LOG = """
task_log AS (SELECT event_id AS seq, 'T' || CAST(user_id AS VARCHAR) AS task_id,
  'T' || CAST(user_id AS VARCHAR) || ':' || event_type || ':' || json_extract_string(props, '$.k') AS event_key,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'UPDATE_FIELDS' WHEN 'purchase' THEN 'UPDATE_STATUS' WHEN 'view' THEN 'NOOP' ELSE 'SOFT_DELETE' END AS db_action,
  CASE WHEN event_type = 'error' AND value > 50 THEN 'failed' WHEN event_type = 'view' THEN 'noop' ELSE 'applied' END AS execution_status,
  CASE WHEN event_type IN ('signup', 'click') THEN 'title ' || CAST(event_id % 97 AS VARCHAR) END AS title,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 30 THEN 'completed' ELSE 'in_progress' END END AS status,
  'R' || CAST(user_id % 40 AS VARCHAR) AS run_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'M' || CAST(user_id % 25 AS VARCHAR) END AS source_session_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
  CASE WHEN event_id % 19 = 0 THEN '{broken' ELSE props END AS after_json, value FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("concat('R', cast(o_orderkey as string)) as run_id", "concat('M', cast(o_custkey % 30 as string)) as session_id", "date_format(o_orderdate, 'yyyy-MM-dd') as session_date", "date_format(o_orderdate, 'yyyy-MM-dd') || '#' || lpad(cast(o_orderkey as string), 10, '0') as started_at", "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status", "o_custkey")


RUNS = """
runs AS (SELECT 'R' || CAST(o_orderkey AS VARCHAR) AS run_id, 'M' || CAST(o_custkey % 30 AS VARCHAR) AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS session_date,
  strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_custkey FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("concat('T', cast(o_orderkey as string)) as task_id", "concat('P', cast(o_custkey as string)) as project_id", "concat(o_orderpriority, ' ', cast(o_custkey as string)) as title", "case o_orderstatus when 'F' then 'completed' when 'O' then 'open' else 'in_progress' end as status", "case when o_orderkey % 10 = 0 then 1 else 0 end as is_deleted", "concat('M', cast(o_orderkey % 50 as string)) as source_session_id", "date_format(o_orderdate, 'yyyy-MM-dd') as created_at", "split_part(o_orderpriority, '-', 2) as priority", "concat('部门：D', cast(o_custkey % 9 as string), '\\n项目：P', cast(o_custkey % 40 as string), '\\nbody ', cast(o_orderkey as string), '\\n优先级：', o_orderpriority) as description", "o_custkey")


TASKS = """
tasks AS (SELECT 'T' || CAST(o_orderkey AS VARCHAR) AS task_id, 'P' || CAST(o_custkey AS VARCHAR) AS project_id, o_orderpriority || ' ' || CAST(o_custkey AS VARCHAR) AS title,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS is_deleted,
  'M' || CAST(o_orderkey % 50 AS VARCHAR) AS source_session_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, split_part(o_orderpriority, '-', 2) AS priority,
  '部门：D' || CAST(o_custkey % 9 AS VARCHAR) || chr(10) || '项目：P' || CAST(o_custkey % 40 AS VARCHAR) || chr(10) || 'body ' || CAST(o_orderkey AS VARCHAR) || chr(10) || '优先级：' || o_orderpriority AS description, o_custkey FROM orders)"""

#: SQL: the bigrams of a key, and Dice of two such lists.
BIGRAMS = "CASE WHEN length({0}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substring({0}, i, 2))) END"
DICE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
STRICT = r"lower(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}]+', '', 'g'))"
LOOSE = r"""lower(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}，。；、：:（）()《》“”"''_-]+', '', 'g'))"""
