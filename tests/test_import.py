"""Imports, manual edits, approvals, migrations and model edges."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from minutary.operators import importer, manual, models, projects
from minutary.sources.config import Settings, require_sections

CAND = "candidate_id string, project_id string, session_id string, ord long, allow_continuity boolean, title string, description string, work_items array<string>, department string, assignee string"
TASK = "task_id string, project_id string, source_session_id string, version long, is_deleted int, status string, title string, description string, work_items array<string>, department string, assignee string"


def cand(i, title, session, project="P", cont=False, work=(), desc="", dept="信息部", who=""):
    return (f"c{i}", project, session, i, cont, title, desc, list(work), dept, who)


def run(spark, cands, tasks=()):
    rows = importer.import_batch(spark.createDataFrame(cands, CAND), spark.createDataFrame(list(tasks), TASK))
    return {r.candidate_id: (r.decision, r.reason, r.task_id, r.version) for r in rows.collect()}


def test_later_sessions_update_one_task(spark):
    titles = ["ERP系统选型与招标准备", "ERP系统选型与招标准备工作", "ERP系统选型招标准备工作推进"]
    got = run(spark, [cand(k, t, f"M{k}", work=["选型调研", "招标准备"]) for k, t in enumerate(titles)])
    assert [got[f"c{k}"][0] for k in range(3)] == ["CREATE", "UPDATE", "UPDATE"]
    assert {got[f"c{k}"][2] for k in range(3)} == {"Nc0"} and got["c2"][3] == 3


def test_one_session_never_updates_its_own_task(spark):
    got = run(spark, [cand(0, "红沙泉项目建设", "M"), cand(1, "红沙泉项目建设", "M"), cand(2, "x", "M", project="")])
    assert [v[0] for _, v in sorted(got.items())] == ["CREATE"] * 3 and got["c2"][1] == "no_project"


def test_ambiguous_and_continuity(spark):
    task = lambda k, title: (f"T{k}", "P", "OLD", 1, 0, "open", title, "", [], "信息部", "")
    two = [task(1, "平台建设方案编制"), task(2, "平台建设方案编制")]
    assert run(spark, [cand(0, "平台建设方案编制", "M")], two)["c0"][:2] == ("REVIEW", "ambiguous_project_task")
    assert run(spark, [cand(0, "哈拉沟项目系统升级", "M", cont=True)], [task(1, "哈拉沟项目网络改造")])["c0"][1] == "unique_project_continuity"
    assert run(spark, [cand(0, "完全不同", "M", cont=True)], [task(1, "哈拉沟项目网络改造")])["c0"][1] == "project_continuity_requires_review"


KEY = re.compile(r"[\W_]+")


def grams(x):
    k = KEY.sub("", x or "").lower()
    return {k[i : i + 2] for i in range(max(1, len(k) - 1))} if k else set()


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def likeness(c, t):
    work = [max((dice(grams(x), grams(y)) for y in t["work"]), default=0.0) for x in c["work"]]
    s = 0.55 * dice(grams(c["title"]), grams(t["title"])) + 0.35 * (sum(work) / len(work) if work and t["work"] else 0.0) + 0.10 * dice(grams(c["desc"]), grams(t["desc"]))
    for f, gain, loss in (("dept", 0.08, 0.03), ("who", 0.10, 0.05)):
        x, y = (KEY.sub("", v[f] or "").lower() for v in (c, t))
        s += 0.0 if not x or not y else gain if x == y else -loss
    return max(0.0, min(1.0, s))


def one_after_another(cands, tasks):
    """{candidate: (decision, reason, action, task, version)}: a plain loop over candidates and all tasks."""
    mapped = {"待执行": "open", "进行中": "in_progress", "已完成": "completed", "已延期": "blocked"}
    names = ("id", "project", "session", "version", "del", "status", "title", "desc", "work", "dept", "who")
    there = {t[0]: dict(zip(names, t)) for t in tasks if not t[4]}
    out = {}
    for i, project, session, _, cont, title, desc, work, dept, who, status, about in sorted(cands, key=lambda c: c[3]):
        c = dict(title=title, desc=desc, work=work, dept=dept, who=who)
        new = dict(project=project, session=session, version=1, status=mapped.get(status, "open"), title=title, desc=about, work=work, dept=dept, who=who)
        if not project:
            out[i] = ("CREATE", "no_project", "CREATE", "N" + i, 1)
            continue
        seen = {k: t for k, t in there.items() if t["project"] == project and t["status"] not in ("completed", "cancelled") and (session is None or t["session"] != session)}
        found = sorted((-likeness(c, t), k) for k, t in seen.items())
        top, second = -found[0][0] if found else None, -found[1][0] if len(found) > 1 else 0.0
        if not found:
            said = "CREATE", "no_project_tasks"
        elif cont and len(found) == 1:
            said = ("UPDATE", "unique_project_continuity") if top >= 0.25 else ("REVIEW", "project_continuity_requires_review")
        elif top >= 0.55 and top - second >= 0.10:
            said = "UPDATE", "unique_project_task"
        else:
            said = ("REVIEW", "ambiguous_project_task") if top >= 0.42 else ("CREATE", "distinct_project_task")
        if said[0] == "CREATE":
            there["N" + i] = new
            out[i] = (*said, "CREATE", "N" + i, 1)
        elif said[0] == "REVIEW":
            out[i] = (*said, "NOOP", None, None)
        else:
            t = there[found[0][1]]
            t["version"] += 1
            if t["status"] != new["status"]:
                t["status"], action = new["status"], "UPDATE_STATUS"
            else:
                t.update({k: new[k] for k in ("title", "desc", "work", "dept")}, who=who or t["who"])
                action = "UPDATE_FIELDS"
            out[i] = (*said, action, found[0][1], t["version"])
    return out


def compare(spark, cands, tasks):
    rows = importer.import_batch(spark.createDataFrame(cands, CAND + ", status string, task_description string").repartition(3), spark.createDataFrame(tasks, TASK))
    got = {r.candidate_id: (r.decision, r.reason, r.db_action, r.task_id, r.version) for r in rows.collect()}
    want = one_after_another(cands, tasks)
    assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want)
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_import_equals_one_candidate_after_another(spark, seed):
    r = random.Random(seed)
    heads = ["ERP系统选型", "数据中心施工", "Pump check", "智能分选测试", "安全检查", "平台研发"]
    say = lambda: r.choice(heads) + r.choice(["", "", "工作", "准备", "推进 2", "二期"])
    cands = []
    for k in range(150):
        title, desc = say(), say() + say()
        cands.append((f"c{k:03d}", r.choice(["P", "P", "P", "Q", "R", "", None]), r.choice(["M1", "M2", "M3", None]), k, False, title, desc, [say() for _ in range(r.randint(0, 2))], r.choice(["A", "B", ""]), r.choice(["x", "y", "", ""]), r.choice(["待执行", "待执行", "进行中", "已完成"]), "部门：A\n" + desc))
    tasks = [(f"T{k}", r.choice(["P", "Q", "S"]), r.choice(["M1", "M0", None]), r.randint(1, 5), int(k % 7 == 0), r.choice(["open", "in_progress", "completed"]), say(), say(), [say()], r.choice(["A", "B"]), r.choice(["x", ""])) for k in range(12)]
    want = compare(spark, cands, tasks)
    assert {v[0] for v in want.values()} == {"CREATE", "UPDATE", "REVIEW"} and {"UPDATE_STATUS", "UPDATE_FIELDS"} <= {v[2] for v in want.values()} and {"no_project_tasks", "distinct_project_task"} <= {v[1] for v in want.values()}


def test_import_with_tasks_that_end_and_continuity(spark):
    c = lambda i, project, session, title, cont=False, status="待执行": (f"c{i}", project, session, i, cont, title, title, [title], "A", "", status, title)
    cands = [c(1, "P", "M1", "水泵检修"), c(2, "P", "M2", "水泵检修", status="已完成"), c(3, "P", "M3", "水泵检修"), c(4, "Q", "M1", "完全不同的事情", True), c(5, "R", "M9", "哈拉沟项目系统升级", True), c(6, "S", "M1", "独自一个", True)]
    tasks = [("T1", "Q", "M0", 3, 0, "open", "abc", "", [], "A", ""), ("T2", "R", "M0", 1, 0, "open", "哈拉沟项目网络改造", "", [], "A", ""), ("T3", "R", "M9", 1, 0, "open", "哈拉沟项目系统升级", "", [], "A", "")]
    want = compare(spark, cands, tasks)
    assert [want[f"c{i}"][1] for i in range(1, 7)] == ["no_project_tasks", "unique_project_task", "no_project_tasks", "project_continuity_requires_review", "unique_project_continuity", "no_project_tasks"]
    assert compare(spark, cands[:1], []) and compare(spark, cands[:1], tasks)


def test_a_crowd_of_copies_makes_one_pair(spark, monkeypatch):
    """Copies of one text in three sessions: pairs stand between texts, not rows."""
    made = {}
    real = importer.settle

    def counted(df, name, bin_):
        out = real(df, name, bin_)
        made[name] = out.count()
        return out

    monkeypatch.setattr(importer, "settle", counted)
    cands = [(f"c{k:03d}", "P", f"M{k // 60}", k, False, "水泵检修", "水泵检修", ["水泵"], "A", "", "待执行", "水泵检修") for k in range(180)]
    compare(spark, cands, [])
    assert made["pairs"] == 1 and made["folded"] == 180


@pytest.mark.parametrize("first, kept, more", [(5, 1, 64), (40, 3, 4)])
def test_an_import_in_several_runs_equals_one_candidate_after_another(spark, monkeypatch, first, kept, more):
    """Small heads, few kept pairs and small tiles: texts that act join in later runs, and what a decision lacked is fetched."""
    for name, value in {"FIRST": first, "KEPT": kept, "TEXTS": 1, "MORE": more, "CHUNKS": (17, 9), "LINKS": 5}.items():
        monkeypatch.setattr(importer, name, value)
    runs, real = [], importer._held
    monkeypatch.setattr(importer, "_held", lambda *a: runs.append(a) or real(*a))
    r = random.Random(first)
    heads = ["ERP系统选型", "数据中心施工", "Pump check", "智能分选测试", "安全检查"]
    say = lambda: r.choice(heads) + r.choice(["", "", "工作", "推进 2", "二期", "abc", "第三批"])
    cands = []
    for k in range(120):
        title, desc = say(), say() + say()
        cands.append((f"c{k:03d}", r.choice("PPPQ"), r.choice(["M1", "M2", "M3", None]), k, False, title, desc, [say() for _ in range(r.randint(0, 2))], r.choice(["A", "B", ""]), r.choice(["x", "y", "", ""]), r.choice(["待执行", "待执行", "待执行", "已完成"]), desc))
    tasks = [(f"T{k}", r.choice("PQS"), r.choice(["M1", "M0", None]), 1, 0, "open", say(), say(), [say()], r.choice(["A", "B"]), r.choice(["x", ""])) for k in range(20)]
    compare(spark, cands, tasks)
    assert len(runs) > 3


def test_texts_that_never_become_tasks_are_held_against_nothing(spark, monkeypatch):
    """All candidates go to review, so that beyond the head of the project their texts are not paired with each other."""
    monkeypatch.setattr(importer, "FIRST", 10)
    made, real = [], importer.settle

    def counted(df, name, bin_):
        out = real(df, name, bin_)
        if name == "pairs":
            made.append(out.selectExpr("coalesce(sum(length(vs)), 0) div 8 as n").first()["n"])
        return out

    monkeypatch.setattr(importer, "settle", counted)
    cands = [(f"c{k:03d}", "P", f"M{k % 3}", k, False, f"水泵检修计划{k}", f"水泵检修{k}", ["水泵"], "A", "", "待执行", f"水泵检修{k}") for k in range(150)]
    tasks = [(f"T{k}", "P", "M9", 1, 0, "open", "水泵检修计划", f"水泵检修第{k}", ["水泵"], "A", "") for k in range(2)]
    want = compare(spark, cands, tasks)
    assert {v[0] for v in want.values()} == {"REVIEW"}
    assert made[-1] == 300 and max(made) < 350  # each with the two tasks; between all there would be 11,175 more


def test_report_and_reviews(spark):
    done = importer.import_batch(spark.createDataFrame([cand(0, "平台建设方案编制", "M"), cand(1, "x", "M", project="")], CAND), spark.createDataFrame([(f"T{k}", "P", "OLD", 1, 0, "open", "平台建设方案编制", "", [], "信息部", "") for k in (1, 2)], TASK))
    cands = spark.createDataFrame([cand(0, "平台建设方案编制", "M"), cand(1, "x", "M", project="")], CAND)
    assert importer.report(done, cands).first().asDict() == {"session_id": "M", "extract_count": 2, "created": 1, "field_updates": 0, "status_updates": 0, "review_count": 1, "linked_count": 0}
    (r,) = importer.reviews(done, cands, "RUN").collect()
    assert r.candidate_id == "M8" + hashlib.sha256(b"RUN\0c0").hexdigest()[:16].upper() and r.status == "pending"


def test_manual_edits(spark):
    tasks = spark.createDataFrame([("T1", "a", "p", "open", 0, 1), ("T2", "b", "p", "open", 1, 4)], "task_id string, title string, priority string, status string, is_deleted int, version int")
    edits = spark.createDataFrame([("T1", 1, "edit", "new", None), ("T1", 2, "edit", None, " "), ("T1", 3, "delete", None, None), ("T1", 4, "edit", "late", None), ("T2", 1, "edit", "x", None)], "task_id string, seq long, action string, title string, priority string")
    out, events = manual.update(tasks, edits)
    assert {r.task_id: (r.title, r.priority, r.status, r.is_deleted, r.version) for r in out.collect()} == {"T1": ("new", None, "cancelled", 1, 4), "T2": ("b", "p", "open", 1, 4)}
    assert [(r.seq, r.db_action, r.version) for r in events.orderBy("seq").collect()] == [(1, "HUMAN_UPDATE", 2), (2, "HUMAN_UPDATE", 3), (3, "HUMAN_SOFT_DELETE", 4)]


def test_manual_payloads(spark):
    cols = [*manual.FIELDS, "evidence_text", "source_session_id"]
    rows = [{"title": "t", "evidence_text": "e", "priority": " "}, {"title": " ", "evidence_text": "e"}, {"title": "t"}, {"title": "t", "evidence_text": "e", "status": "odd"}]
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols))
    assert [r.f for r in df.select(manual.payload_fault().alias("f")).collect()] == [None, "title_required", "evidence_required", "unknown_status"]
    (r,) = manual.create(df).collect()
    assert (r.priority, r.status, r.source_session_id, r.version) == (None, "open", "MANUAL", 1)


def test_reviews_are_approved_once_and_only_with_title_and_evidence(spark):
    full = '{"title":"","description":"d","work_items":["w"],"assignee":"a","deadline":"soon","evidence":" E ","department":"D","project":"P"}'
    queue = [("full", full, "pending"), ("nested", '{"candidate":{"title":"T","evidence":"E"}}', "pending"), ("bare", '{"title":"x"}', "pending"), ("old", full, "rejected"), ("src", '{"title":"t","source_text":"S"}', "pending")]
    reviews = spark.createDataFrame([(k, "M", s, j) for k, j, s in queue], "candidate_id string, session_id string, status string, candidate_json string")
    asked = [("full", 1, None), ("full", 2, '{"title":" "}'), ("full", 3, '{"title":"t","status":"completed"}'), ("full", 4, '{"title":"t","work_items":null}'), ("full", 5, '{"title":"t","work_items":"[\\"w\\"]"}'), ("full", 6, '{"title":"t","assignee_raw":" "}'), ("full", 7, '{"title":" t ","project":null,"reviewer_note":"ok"}'), ("full", 8, '{"title":"u"}'), ("nested", 1, "{}"), ("bare", 1, "{}"), ("old", 1, '{"title":"t"}'), ("gone", 1, "{}"), ("src", 1, '{"status":"in_progress","work_items":["v","w"]}')]
    decided = manual.approve(reviews, spark.createDataFrame(asked, "candidate_id string, seq int, payload_json string"))
    got = {(r.candidate_id, r.seq): r for r in decided.collect()}
    assert [got["full", k].fault for k in range(1, 9)] == ["title_required", "title_required", "initial_status", "work_items_not_list", "work_items_not_list", "blank_patch_field", None, "already_resolved"]
    assert [got[k, 1].fault for k in ("nested", "bare", "old", "gone", "src")] == [None, "evidence_required", "already_resolved", "not_found", None]
    r = got["full", 7]
    assert (r.title, r.description, r.work_items, r.assignee_raw, r.deadline_raw, r.status, r.evidence, r.department, r.project, r.version, r.source_key) == ("t", "d", ["w"], "a", "soon", "open", "E", "D", None, 2, "M:review_full:001")
    assert (got["src", 1].status, got["src", 1].work_items, got["src", 1].version, got["src", 1].description) == ("in_progress", ["v", "w"], 1, "t")
    assert sorted(e.db_action for e in manual.approval_events(decided).collect()) == ["CREATE"] * 3 + ["HUMAN_UPDATE"]
    left = {r.candidate_id: (r.status, r.task_id is not None, r.reviewer_note) for r in manual.settled_reviews(reviews, decided).collect()}
    assert left == {"full": ("approved", True, "ok"), "nested": ("approved", True, None), "bare": ("pending", False, None), "old": ("rejected", False, None), "src": ("approved", True, None)}


def test_project_names_go_to_the_model_only_once_they_are_linked(spark):
    there = spark.createDataFrame([("P1", "Alpha"), ("P2", "Beta")], "project_id string, canonical_name string")
    aliases = spark.createDataFrame([("P1", "al")], "project_id string, alias_name string")
    rows = [(1, " "), (2, "AL"), (3, "bee"), (4, "bee"), (5, "bee"), (6, "gam"), (7, "gam"), (8, "bad"), (9, "unnamed"), (10, "silent"), (11, "b"), (12, None)]
    said = [(3, "none", None, None, 0.3), (4, "matched", "P2", None, 0.7), (5, "new", None, "Other", 0.9), (6, "new", None, "Gamma", 0.8), (8, "existing", "P9", None, 1.0), (9, "new", None, " ", 1.0), (11, "create", None, "beta", None)]
    out = projects.resolve(spark.createDataFrame([(k, k, n) for k, n in rows], "record_id long, ord long, source_name string"), there, aliases, spark.createDataFrame(said, "record_id long, resolution string, project_id string, canonical_name string, confidence double"))
    got = {r.record_id: (r.resolution, r.project_id, r.canonical_name, r.confidence, r.fault) for r in out.collect()}
    made = got[6][1]
    none = ("none", None, None, 1.0, None)
    assert made.startswith("P") and len(made) == 11
    assert got == {
        1: none, 2: ("existing", "P1", "Alpha", 1.0, None), 3: none, 4: ("existing", "P2", "Beta", 0.7, None), 5: ("existing", "P2", "Beta", 1.0, None),
        6: ("new", made, "Gamma", 0.8, None), 7: ("existing", made, "Gamma", 1.0, None), 8: (None, None, None, None, "unknown_project"),
        9: (None, None, None, None, "canonical_name_required"), 10: (None, None, None, None, "no_answer"), 11: ("new", "P2", "Beta", 1.0, None), 12: none,
    }


def resolve_in_order(rows, there, aliases, said):
    """Plain version: one row after another, with one catalogue of names and projects."""
    import hashlib

    key = lambda x: re.sub(r"[\s_-]+", "", x or "").lower()
    names, known, answers = dict(there), {}, {a[0]: a for a in said}
    for p, n in sorted([*there, *aliases], reverse=True):
        known[key(n)] = p
    out = {}
    for i, name in rows:
        k = key(name)
        if not (name or "").strip():
            out[i] = ("none", None, None, 1.0, None)
        elif k in known:
            out[i] = ("existing", known[k], names[known[k]], 1.0, None)
        elif i not in answers:
            out[i] = (None, None, None, None, "no_answer")
        else:
            _, kind, p, new, sure = answers[i]
            if kind == "existing" and p not in names:
                out[i] = (None, None, None, None, "unknown_project")
            elif kind == "new" and not (new or "").strip():
                out[i] = (None, None, None, None, "canonical_name_required")
            elif kind == "none":
                out[i] = ("none", None, None, 1.0, None)
            else:
                if kind == "new":
                    p = known.get(key(new)) or "P" + hashlib.sha256(key(new).encode()).hexdigest()[:10]
                    if key(new) not in known:
                        known[key(new)], names[p] = p, new.strip()
                known.setdefault(k, p)
                out[i] = (kind, p, names[p], sure, None)
    return out


@pytest.mark.parametrize("seed, finish", [(1, 50_000), (2, 0), (3, 0), (4, 5)])
def test_a_growing_catalogue_equals_one_row_after_another(spark, seed, finish, monkeypatch):
    import hashlib

    monkeypatch.setattr(projects, "FINISH", finish)
    r = random.Random(seed)
    pool = [f"{c}{d}" for c in "abcdef" for d in "123"] + ["A 1", "b-2", "Alpha", " al"]
    there, aliases = [("P1", "Alpha"), ("P2", "b1")], [("P1", "al"), ("P2", "c3")]
    rows = [(i, r.choice([*pool, " ", None])) for i in range(120)]
    digest = lambda x: "P" + hashlib.sha256(x.encode()).hexdigest()[:10]
    said = [(i, r.choice(["new", "new", "existing", "none"]), r.choice(["P1", "P9", digest(r.choice(pool[:18])), digest("a1")]), r.choice([*pool, " "]), round(r.random(), 2)) for i in range(120) if r.random() < 0.9]
    out = projects.resolve(spark.createDataFrame([(k, k, n) for k, n in rows], "record_id long, ord long, source_name string").repartition(3), spark.createDataFrame(there, "project_id string, canonical_name string"), spark.createDataFrame(aliases, "project_id string, alias_name string"), spark.createDataFrame(said, "record_id long, resolution string, project_id string, canonical_name string, confidence double"))
    got = {x.record_id: (x.resolution, x.project_id, x.canonical_name, x.confidence, x.fault) for x in out.collect()}
    want = resolve_in_order(rows, there, aliases, said)
    assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}
    assert {v[0] for v in want.values()} == {"new", "existing", "none", None} and any(v[1] not in (None, "P1", "P2") and v[0] == "existing" for v in want.values())


def test_a_project_made_in_the_batch_is_known_by_its_own_name(spark):
    rows, said = [(1, "gam"), (2, "Gamma"), (3, "gg")], [(1, "new", None, "Gamma", 0.8), (3, "new", None, "gam", 0.7)]
    empty = spark.createDataFrame([], "project_id string, canonical_name string"), spark.createDataFrame([], "project_id string, alias_name string")
    out = projects.resolve(spark.createDataFrame([(k, k, n) for k, n in rows], "record_id long, ord long, source_name string"), *empty, spark.createDataFrame(said, "record_id long, resolution string, project_id string, canonical_name string, confidence double"))
    got = {x.record_id: (x.resolution, x.canonical_name, x.confidence) for x in out.collect()}
    assert got == {1: ("new", "Gamma", 0.8), 2: ("existing", "Gamma", 1.0), 3: ("new", "Gamma", 0.7)}


def test_prompts(spark):
    import json

    row = spark.createDataFrame([("s:1", "a<b", "bad")], "key string, text string, fault string")
    source = F.struct(F.col("text").alias("text"))
    r = row.select(models.repair_prompt("again", F.col("fault"), F.lit("{}"), F.col("text")).alias("repair"), models.chunk_prompt(F.col("text")).alias("chunk"), models.command_prompt(F.col("key"), source, F.array(source), F.lit(None).cast("string"), F.lit("none")).alias("command"), models.project_prompt(F.col("text"), F.lit(None).cast("string"), F.array(F.lit("P"))).alias("project")).first()
    assert r.repair == "again\n<fault>bad</fault>\n<response>{}</response>\n<request>a&lt;b</request>" and r.chunk == "<chunk>\na<b\n</chunk>"
    command = json.loads(r.command)
    assert command["unique_target_task_id"] is None and command["task_candidates"] == [{"text": "a<b"}] and command["required_commands"][0]["task_patch"]["title"] is None
    assert json.loads(r.project) == {"task_text": "a<b", "source_name": None, "project_catalog": ["P"]}


def test_model_calls_are_repaired_and_retried(spark):
    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "flaky" and seen[prompt] == 1:
                raise models.ModelError("busy", 503)
            if prompt == "down":
                raise models.ModelError("no", 401)
            return "ok" if prompt in ("flaky", "again") else "bad"

        return call

    rows = spark.createDataFrame([("flaky",), ("odd",), ("down",)], "prompt string").withColumn("key", F.col("prompt"))
    out = models.ask_twice(rows, client, F.when(F.col("response") != "ok", F.lit("fault")), F.when(F.col("key") == "odd", F.lit("again")).otherwise(F.col("key")), wait=0.0)
    assert {r.key: (r.response, r.fault, r.calls) for r in out.collect()} == {"flaky": ("ok", None, 1), "odd": ("ok", None, 2), "down": (None, "model_error", 2)}


def test_answered_prompts_are_not_sent_again(spark, tmp_path):
    """A run that dies after some calls, and its repetition: every prompt is sent once."""
    calls = tmp_path / "calls"

    def dying(limit):
        def client():
            def call(prompt):
                if limit is not None and len(calls.read_text().splitlines() if calls.exists() else ()) >= limit:
                    raise RuntimeError("executor lost")
                with calls.open("a") as f:
                    f.write(f"{prompt}\n")
                if prompt == "down":
                    raise models.ModelError("no", 401)
                return f"to {prompt}"

            return call

        return client

    prompts = [f"p{k}" for k in range(30)] + ["p1", "p1", None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "id long, prompt string").coalesce(1)
    folder = f"file://{tmp_path}/answers"
    with pytest.raises(Exception, match="executor lost"):
        models.ask_once(rows, dying(12), folder).count()
    assert len(calls.read_text().splitlines()) == 12
    for _ in range(2):
        got = {r.id: (r.response, r.error) for r in models.ask_once(rows, dying(None), folder).collect()}
        assert got == {k: (f"to {p}", None) for k, p in enumerate(prompts)}
    sent = calls.read_text().splitlines()
    assert len(sent) == len(set(sent)) == 31
    more = models.ask_once(spark.createDataFrame([(1, "down"), (2, "p3")], "id long, prompt string"), dying(None), folder)
    assert {r.id: (r.response, r.error) for r in more.collect()} == {1: (None, "401: no"), 2: ("to p3", None)}
    assert models.ask_once(rows.limit(0), dying(0), folder).count() == 0


def test_settings():
    s = Settings.load({"use_model": "yes", "chunk_size": "100"}, {"MINUTARY_MODEL_KEY": "secret", "MINUTARY_USE_MODEL": "off"})
    assert (s.use_model, s.chunk_size, s.model_key) == (False, 100, "secret") and "secret" not in repr(s)
    s = Settings.load({"model_url": None, "model_name": "own", "model_key_env": "KEY"}, {"KEY": "k", "MINUTARY_MODEL_NAME": ""}, inherited={"model_url": "u", "model_name": "theirs", "model_key": "old"})
    assert (s.model_url, s.model_name, s.model_key) == ("u", "own", "k") and s.with_model() is s
    with pytest.raises(ValueError, match="missing settings: model_key, model_url$"):
        Settings.load({"model_name": "m"}, {}).with_model()
    with pytest.raises(ValueError):
        Settings.load({"upload_bytes": 0}, {})
    with pytest.raises(ValueError):
        require_sections({"model": {}}, ("model", "paths"))


def test_merge_is_idempotent(spark):
    groups = spark.createDataFrame([("g", k, f"T{k}") for k in range(4)], "group_id string, ord long, task_id string")
    first = manual.merge_tasks(groups, spark.createDataFrame([], "event_key string"))
    assert sorted(r.db_action for r in first.collect()) == ["GRANULARITY_MERGE"] + ["MERGED_INTO"] * 3
    assert manual.merge_tasks(groups, first).count() == 0


