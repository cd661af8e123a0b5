"""Labelled records through matching and the rule client to events."""

from pyspark.sql import functions as F

from minutary.operators import classify, commands, service

TASKS = [("T000001", "提交7号泵房应急方案", "维修组提交7号泵房应急方案。", "维修组", "open"), ("T000002", "完成西门岗亭检查", "保卫科完成西门岗亭检查。", "保卫科", "in_progress"), ("T000003", "整理去年档案目录", "档案室整理去年档案目录。", "档案室", "open")]


def test_four_actions(spark):
    tasks = spark.createDataFrame(TASKS, "task_id string, title string, description string, assignee_raw string, status string")
    rows = [(1, 1, "通风队下周一前提交新风量测定方案。", "task"), (2, 2, "原定周五提交7号泵房应急方案延期到月底", "task_update"), (3, 3, "完成西门岗亭检查这项任务已经全部完成。", "task_update"), (4, 4, "整理去年档案目录这项任务取消，不再执行。", "task_update"), (5, 5, "汇报", "report")]
    made = service.to_commands(spark.createDataFrame(rows, "record_id long, seq long, text string, task_category string"), tasks)
    got = {r.record_id: (r.db_action, r.target_task_id) for r in made.collect()}
    assert got == {1: ("CREATE", None), 2: ("UPDATE_FIELDS", "T000001"), 3: ("UPDATE_STATUS", "T000002"), 4: ("SOFT_DELETE", "T000003")}
    events = {r.seq: (r.execution_status, r.version_after, r.status) for r in service.to_events(made, tasks).collect()}
    assert events == {1: ("applied", 1, "open"), 2: ("applied", 2, "open"), 3: ("applied", 2, "completed"), 4: ("applied", 2, "cancelled")}


def test_update_without_target_is_a_noop(spark):
    tasks = spark.createDataFrame(TASKS, "task_id string, title string, description string, assignee_raw string, status string")
    rows = spark.createDataFrame([(1, 1, "这项工作继续推进", "task_update")], "record_id long, seq long, text string, task_category string")
    assert [r.db_action for r in service.to_commands(rows, tasks).collect()] == ["NOOP"]


def test_a_faulty_command_is_made_once_more_and_then_given_up(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "mended"), (3, "hopeless")], "record_id long, text string")
    client = lambda: {"db_action": F.lit("CREATE"), "title": F.when(F.col("text") == "good", F.lit("t"))}
    retry = lambda: {"db_action": F.lit("CREATE"), "title": F.when(F.col("text") == "mended", F.col("fault"))}
    got = {r.record_id: (r.db_action, r.title, r.attempts, r.fault) for r in service.corrected(rows, client, F.when(F.col("title").isNull(), F.lit("no_title")), retry).collect()}
    assert got == {1: ("CREATE", "t", 1, None), 2: ("CREATE", "no_title", 2, None), 3: ("NOOP", None, 2, "no_title")}


def test_faults_of_a_batch(spark):
    rows = spark.createDataFrame([("a", k, "bad" if k % 2 else None) for k in range(20)] + [("b", 1, None)], "batch string, path long, fault string")
    got = {r.batch: (r.n_rows, r.n_faults, r.first_faults) for r in classify.batch_faults(rows, "batch", "path").collect()}
    assert got == {"a": (20, 10, [f"{k}: bad" for k in (1, 3, 5, 7, 9)]), "b": (1, 0, [])}


def test_command_choice_prefers_status(spark):
    rows = spark.createDataFrame([("UPDATE", "已完成", "open"), ("UPDATE", "待执行", "open"), ("CREATE", "进行中", None), ("REVIEW", "x", None)], "decision string, status string, task_status string")
    assert [(r.db_action, r.new_status) for r in commands.choose(rows).collect()] == [("UPDATE_STATUS", "completed"), ("UPDATE_FIELDS", None), ("CREATE", "in_progress"), ("NOOP", None)]
