"""Fixtures of the task domain with known results."""

from pyspark.sql import functions as F

from minutary.operators import candidates as K, classify, commands, documents, matching, projects, store

CAND = "ord long, department string, project string, title string, description string, work_items array<string>, assignee string, deadline string, priority string, status string, evidence string, confidence double"


def cand(ord, project="P", title="t", evidence="e", **kw):
    base = dict(department="d", description="x", work_items=[], assignee="", deadline="", priority="中", status="待执行", confidence=None)
    r = base | dict(ord=ord, project=project, title=title, evidence=evidence) | kw
    return tuple(r[f.split(" ")[0]] for f in CAND.split(", "))


def spans(spark, text, **kw):
    return [(r.st, r.en) for r in documents.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("chunk_no").collect()]


def test_chunks(spark):
    assert spans(spark, "甲" * 1500 + "。" + "乙" * 2000 + "！" + "丙" * 1700) == [(0, 1501), (1341, 3502), (3342, 5202)]
    assert spans(spark, "x" * 5000) == [(0, 2400), (2240, 4640), (4480, 5000)]
    assert spans(spark, " \n ") == [] and spans(spark, None) == [] and spans(spark, "") == []
    assert spans(spark, "a" + " " * 30 + "b", size=8, overlap=2) == [(0, 8), (24, 32)]  # blank stretches give no row
    assert spans(spark, "\u3000x\r\ny.\r", size=3, overlap=1) == [(0, 2), (1, 4)]
    long = "abc. " * 400_000
    assert len(spans(spark, long)) == len(list(documents.spans(len(long) - 1, lambda i, j: -1, 2400, 160)))


def test_merge_folds_in_order(spark):
    rows = [cand(0, evidence="ab", confidence=None, priority="低", status="已完成", description="one"), cand(1, title="u", evidence="b", confidence=0.7, priority="高", status="进行中", description="two", assignee="a1"), cand(2, project="", title="P", evidence="c")]
    (r,) = K.merge(spark.createDataFrame(rows, CAND)).collect()
    assert (r.title, r.evidence, r.confidence, r.priority, r.status, r.assignee, r.work_items) == ("t", "ab\nc", 0.7, "高", "进行中", "a1", ["one", "two", "x"])


def test_gate_names_the_first_fault(spark):
    rows = [cand(0, evidence="", department=""), cand(1, status="已完成"), cand(2, confidence=0.79), cand(3, confidence=0.8), cand(4)]
    got = [(r.candidate_id, r.reason) for r in K.gate(spark.createDataFrame(rows, CAND)).orderBy("ord").collect()]
    assert got == [("c-001", "missing_department_evidence"), ("c-002", "non_active_initial_status"), ("c-003", "low_model_confidence"), ("c-004", None), ("c-005", None)]


def test_context_stays_within_a_session(spark):
    rows = spark.createDataFrame([(0, "会议A", "s1", "甲"), (1, "会议B", "s2", "乙"), (2, "会议B", "s3", "丙")], "ord long, session_title string, segment_id string, clean_text string").withColumn("file", F.lit(1))
    got = {r.segment_id: (r.prev_context, r.next_context) for r in documents.with_context(rows, by=("file",)).collect()}
    assert got == {"s1": ("", ""), "s2": ("", "丙"), "s3": ("乙", "")}


def test_safety_and_recall(spark):
    rows = spark.createDataFrame([("现场存在瓦斯隐患", "non_task", "DISCARD"), ("x", "task", "DISCARD")], "text string, primary_label string, route string").select("*", *(F.lit(False).alias(s) for s in classify.SIGNALS))
    got = {r.primary_label: (r.final_route, r.overrides) for r in classify.guard_routes(rows).collect()}
    assert got == {"non_task": ("HUMAN_REVIEW", ["safety_keyword_signal", "safety_candidate_review"]), "task": ("EXTRACT", ["candidate_label_recalled"])}


def test_catalogue_growth(spark):
    none = spark.createDataFrame([], "project_id string, canonical_name string"), spark.createDataFrame([], "project_id string, alias_name string")
    wanted = spark.createDataFrame([(0, "CRM二期项目", "CRM二期项目"), (1, "CRM 二期项目", "CRM 二期"), (2, "别的项目", "CRM二期")], "ord long, canonical string, alias string")
    new, aliases, conflicts = projects.grow(*none, wanted)
    assert sorted(r.canonical_name for r in new.collect()) == ["CRM二期项目", "别的项目"]
    assert sorted(r.alias_name for r in aliases.collect()) == ["CRM 二期", "CRM二期项目"] and [r.ord for r in conflicts.collect()] == [2]


TASKS = [("T000001", "提交3125设备应急方案", "机电队提交3125设备应急方案。", "机电队"), ("T000002", "完成主井设备检查", "运输队完成主井设备检查。", "运输队"), ("T000003", "整理上月培训台账", "培训科整理上月培训台账。", "培训科")]


def test_match_over_all_tasks(spark):
    tasks = spark.createDataFrame(TASKS, "task_id string, title string, description string, assignee_raw string")
    texts = spark.createDataFrame([(1, "T000002 这项任务取消"), (2, "原定周五提交3125设备应急方案延期到月底"), (3, "这项工作继续推进"), (4, "通风队下周一前提交新风量测定方案。")], "text_id long, text string")
    got = {r.text_id: (r.decision, r.task_id) for r in matching.decide_all(texts, matching.score_all(texts, tasks)).collect()}
    assert got == {1: ("explicit", "T000002"), 2: ("exact_title", "T000001"), 3: ("unmatched", None), 4: ("ambiguous", None)}


def test_rules_and_granularity(spark):
    rows = spark.createDataFrame([("s", 0, "CREATE", "智能综合管控平台建模", "做甲。", None, "a", "智能综合管控平台：建模和联调"), ("s", 1, "CREATE", "智能综合管控平台联调", "做乙", None, "a", "智能综合管控平台：建模和联调")], "source_key string, command_index int, db_action string, title string, description string, work_items array<string>, assignee_raw string, source_text string")
    (r,) = commands.merge_granularity(rows).collect()
    assert (r.merged, r.title, r.work_items) == (True, "构建智能综合管控平台", ["做甲", "做乙"])


def test_log_is_idempotent_and_versioned(spark):
    schema = "seq long, task_id string, event_key string, db_action string, expected_version long, title string, status string"
    rows = [(1, "T1", "k1", "CREATE", None, "a", None), (2, "T1", "k1", "CREATE", None, "b", None), (3, "T1", "k2", "UPDATE_FIELDS", 1, "c", None), (4, "T1", "k3", "UPDATE_STATUS", 1, None, "blocked"), (5, "T1", "k4", "SOFT_DELETE", 2, None, None), (6, "T1", "k5", "UPDATE_FIELDS", None, "d", None), (7, "T2", "k6", "UPDATE_FIELDS", None, "d", None)]
    got = [(r.execution_status, r.failure_reason, r.version_after, r.title, r.status) for r in store.apply_commands(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]
    assert got == [("applied", None, 1, "a", "open"), ("duplicate", None, 1, "a", "open"), ("applied", None, 2, "c", "open"), ("failed", "version_conflict", 2, "c", "open"), ("applied", None, 3, "c", "cancelled"), ("failed", "task_deleted", 3, "c", "cancelled"), ("failed", "task_not_found", 0, None, None)]


def test_resolve_counts_the_first_answer(spark):
    queue = spark.createDataFrame([("a", "pending"), ("b", "approved")], "candidate_id string, status string")
    answers = spark.createDataFrame([("a", 2, "approved"), ("a", 1, "rejected"), ("b", 1, "rejected")], "candidate_id string, seq long, verdict string")
    assert {r.candidate_id: r.status for r in store.resolve_reviews(queue, answers).collect()} == {"a": "rejected", "b": "approved"}


def test_patches_overlay_all_fields_and_source_keys_are_made_once(spark):
    schema = "seq long, task_id string, event_key string, db_action string, expected_version long, title string, description string, work_items array<string>, assignee_raw string, deadline_raw string, status string, source_key string"
    rows = [
        (1, "T1", "a", "CREATE", None, "t", "d", ["w"], "x", None, None, "s1"),
        (2, "T1", "b", "UPDATE_FIELDS", 1, None, None, None, None, "friday", None, None),
        (3, "T1", "c", "UPDATE_FIELDS", 2, None, "new", ["v", "w"], None, None, None, None),
        (4, "T1", "d", "UPDATE_FIELDS", 3, None, None, None, None, None, "completed", None),
        (5, "T2", "e", "CREATE", None, "again", None, None, None, None, None, "s1"),
        (6, "T2", "f", "UPDATE_STATUS", None, None, None, None, None, None, "completed", None),
        (7, "T3", "g", "CREATE", None, "no key", None, None, None, None, "blocked", None),
    ]
    got = {r.seq: (r.execution_status, r.failure_reason, r.version_after, r.title, r.description, r.work_items, r.assignee_raw, r.deadline_raw, r.status) for r in store.apply_commands(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("applied", None, 1, "t", "d", ["w"], "x", None, "open"),
        2: ("applied", None, 2, "t", "d", ["w"], "x", "friday", "open"),
        3: ("applied", None, 3, "t", "new", ["v", "w"], "x", "friday", "open"),
        4: ("failed", "ineffective_update", 3, "t", "new", ["v", "w"], "x", "friday", "open"),
        5: ("noop", None, 0, None, None, None, None, None, None),
        6: ("failed", "task_not_found", 0, None, None, None, None, None, None),
        7: ("applied", None, 1, "no key", None, None, None, None, "blocked"),
    }
    assert store.apply_commands(spark.createDataFrame([], schema)).count() == 0


def test_context_is_that_of_the_neighbour_in_the_file(spark):
    rows = spark.createDataFrame([("f", "A", 1, "first A"), ("f", "B", 2, "only B"), ("f", "A", 3, "second A"), ("f", "A", 4, "third A")], "file string, session_title string, ord int, clean_text string")
    got = [(r.prev_context, r.next_context) for r in documents.with_context(rows).orderBy("ord").collect()]
    assert got == [("", ""), ("", ""), ("", "third A"), ("second A", "")]


def test_project_matches_say_why(spark):
    side = "{0} string, project_id string, {1} string, title string, description string, work_items array<string>, department string, assignee string"
    cands = spark.createDataFrame([("c", "P", "M2", "检查主泵", "检查主泵并记录", ["检查主泵"], "机修组", "李")], side.format("candidate_id", "session_id"))
    tasks = spark.createDataFrame([("T1", "P", "M1", "检查主泵", "检查主泵", ["检查主泵"], "机修组", "王", 0, "open"), ("T2", "P", "M1", "别的事情", "", [], "", "", 0, "open")], side.format("task_id", "source_session_id") + ", is_deleted int, status string")
    (r,) = matching.reviewed(matching.with_reasons(matching.score_project(cands, tasks, k=5), cands, tasks), tasks).collect()
    first, second = r.candidates
    assert first.task_id == "T1" and first.match_reasons == ["title_similarity:1.000", "work_item_similarity:1.000", f"description_similarity:{2 * 3 / (6 + 3):.3f}", "same_project", "same_department", "different_assignee"]
    assert second.match_reasons == ["title_similarity:0.000", "work_item_similarity:0.000", "description_similarity:0.000", "same_project"]
