"""The event store against a plain executor that runs one command after another."""

import random

import pytest

from minutary.operators import claims, service, store

SCHEMA = "seq long, task_id string, event_key string, db_action string, expected_version long, title string, description string, work_items array<string>, assignee_raw string, deadline_raw string, status string, source_key string"
TASK = "task_id string, version long, status string, is_deleted int, title string, description string, work_items array<string>, assignee_raw string, deadline_raw string, source_key string"


def execute(commands, tasks=(), log=()):
    """{seq: (outcome, reason, version, title, status)}, in order, with one table of tasks and one set of event keys."""
    there, keys, out = {t[0]: dict(zip([c.split(" ")[0] for c in TASK.split(", ")], t)) for t in tasks}, set(log), {}
    for seq, task, key, action, expected, title, desc, work, who, due, status, source in sorted(commands, key=lambda c: c[0]):
        t, patch, why = there.get(task), dict(title=title, description=desc, work_items=work, assignee_raw=who, deadline_raw=due), None
        if key in keys:
            done = "duplicate"
        else:
            keys.add(key)
            done = "applied"
            if action == "NOOP":
                done = "noop"
            elif action == "CREATE":
                if source is not None and any(x["source_key"] == source for x in there.values()):
                    done = "noop"
                elif t:
                    done = "duplicate"
                else:
                    there[task] = dict(patch, version=1, status=status or "open", is_deleted=0, source_key=source)
            elif t is None:
                why = "task_not_found"
            elif t["is_deleted"]:
                why = "task_deleted"
            elif expected is not None and expected != t["version"]:
                why = "version_conflict"
            elif action == "SOFT_DELETE":
                t.update(version=t["version"] + 1, status="cancelled", is_deleted=1)
            elif action == "UPDATE_STATUS" and status is not None:
                t.update(version=t["version"] + 1, status=status)
            elif action == "UPDATE_FIELDS" and any(v is not None for v in patch.values()):
                t.update({k: v for k, v in patch.items() if v is not None}, version=t["version"] + 1)
            else:
                why = "ineffective_update"
        t = there.get(task)
        out[seq] = ("failed" if why else done, why, t["version"] if t else 0, t["title"] if t else None, t["status"] if t else None)
    return out


def got(df):
    return {r.seq: (r.execution_status, r.failure_reason, r.version_after, r.title, r.status) for r in df.collect()}


def command(seq, task, key, action, source=None, expected=None, title=None, status=None):
    return (seq, task, key, action, expected, title, None, None, None, None, status, source)


def test_a_key_counts_once_in_the_whole_store(spark):
    rows = [command(1, "A", "k1", "CREATE", title="a"), command(2, "B", "k1", "CREATE", title="b"), command(3, "B", "k2", "UPDATE_FIELDS", title="x"), command(4, "A", "k2", "UPDATE_FIELDS", title="y")]
    out = got(store.apply_commands(spark.createDataFrame(rows, SCHEMA)))
    assert [out[i][0] for i in (1, 2, 3, 4)] == ["applied", "duplicate", "failed", "duplicate"] and out == execute(rows)


def test_a_refused_creation_claims_nothing(spark):
    rows = [command(1, "C", "a", "CREATE", "s9"), command(2, "C", "b", "CREATE", "s8"), command(3, "D", "c", "CREATE", "s8"), command(4, "E", "d", "CREATE", "s9"), command(5, "E", "e", "CREATE", "s7")]
    out = got(store.apply_commands(spark.createDataFrame(rows, SCHEMA)))
    assert [out[i][0] for i in range(1, 6)] == ["applied", "duplicate", "applied", "noop", "applied"] and out == execute(rows)


@pytest.mark.parametrize("seed, finish", [(1, 50_000), (2, 0), (3, 10)])
def test_any_log_equals_one_command_after_another(spark, seed, finish, monkeypatch):
    monkeypatch.setattr(claims, "FINISH", finish)
    r = random.Random(seed)
    tasks = [(f"T{i}", r.randint(1, 4), "open", int(r.random() < 0.2), f"old {i}", None, None, "who", None, f"s{i}" if i % 2 else None) for i in range(0, 12, 2)] + [("S9", 3, "open", 0, "t", None, None, None, None, "s9")]
    rows = []
    for seq in range(1, 300):
        action = r.choice(["CREATE", "CREATE", "CREATE", "UPDATE_FIELDS", "UPDATE_STATUS", "SOFT_DELETE", "NOOP"] if seq % 3 else ["CREATE", "UPDATE_FIELDS"])
        rows.append(command(seq, f"T{r.randrange(60)}", f"k{r.randrange(240)}", action, f"s{r.randrange(40)}" if r.random() < 0.8 else None, r.choice([None, None, 1, 2]), r.choice([None, f"n{seq}"]), r.choice([None, "completed"])))
    log = ["k3", "k4", "elsewhere"]
    r.shuffle(rows)
    out = store.apply_commands(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(tasks, TASK), spark.createDataFrame([(k,) for k in log], "event_key string"))
    assert got(out) == execute(rows, tasks, log)


def test_events_of_a_service_keep_what_is_stored(spark):
    tasks = spark.createDataFrame([("T1", 7, "open", 0, "title", "desc", ["w"], "who", None, "s1")], TASK)
    made = spark.createDataFrame([(1, 1, "new text", "T1", "UPDATE_FIELDS", None), (2, 2, "x", "T1", "UPDATE_STATUS", "blocked"), (3, 3, "made", None, "CREATE", None), (4, 4, "y", "T9", "SOFT_DELETE", None)], "record_id long, seq long, text string, target_task_id string, db_action string, status string")
    out = {r.seq: r for r in service.to_events(made, tasks).collect()}
    r = out[1]
    assert (r.version_before, r.version_after, r.title, r.description, r.work_items, r.assignee_raw, r.status) == (7, 8, "new text", "desc", ["w"], "who", "open")
    assert (out[2].version_after, out[2].status, out[2].title) == (9, "blocked", "new text") and out[3].version_after == 1 and out[4].failure_reason == "task_not_found"
    again = service.to_events(made, tasks, spark.createDataFrame([("3:1",)], "event_key string"))
    assert {r.seq: r.execution_status for r in again.collect()}[3] == "duplicate"
