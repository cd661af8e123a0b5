"""A stream of commands over stored tasks against one batch and against a plain executor."""

import random

import pytest
from test_store import SCHEMA, command, execute

from minutary.operators import store
from minutary.streaming.state import TaskStore


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    out = []
    for seq in range(1, 241):
        action = r.choice(["CREATE", "CREATE", "UPDATE_FIELDS", "UPDATE_STATUS", "SOFT_DELETE", "NOOP"])
        out.append(command(seq, f"T{r.randrange(40)}", f"k{r.randrange(200)}", action, f"s{r.randrange(30)}" if r.random() < 0.8 else None, r.choice([None, None, 1, 2]), r.choice([None, f"n{seq}"]), r.choice([None, "completed"])))
    return out


def state(df):
    return sorted((r.task_id, r.version, r.status, r.is_deleted, r.title, r.source_key) for r in df.collect())


def test_micro_batches_and_a_restart_equal_one_batch(spark, tmp_path, rows):
    keeper, landing = TaskStore(f"file://{tmp_path}/store", 8), f"{tmp_path}/in"
    for first in range(0, 160, 80):
        spark.createDataFrame(rows[first : first + 80], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    keeper.follow(spark, landing, SCHEMA, f"file://{tmp_path}/check", files=1).awaitTermination()
    assert keeper.manifest(spark)["batch"] == 1
    spark.createDataFrame(rows[160:], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    keeper.follow(spark, landing, SCHEMA, f"file://{tmp_path}/check", files=1).awaitTermination()  # a new query on the old checkpoint
    assert keeper.manifest(spark)["batch"] == 2
    got = {r.seq: (r.execution_status, r.failure_reason, r.version_after, r.title, r.status) for r in keeper.events(spark).collect()}
    assert got == execute(rows)
    whole = TaskStore(f"file://{tmp_path}/whole", 8)
    whole.apply(spark.createDataFrame(rows, SCHEMA), 0)
    assert state(keeper.tasks(spark)) == state(whole.tasks(spark)) != []


def test_only_buckets_with_commands_are_written(spark, tmp_path):
    keeper = TaskStore(f"file://{tmp_path}/store", 16)
    make = lambda ids, at: spark.createDataFrame([command(at + i, f"T{i}", f"{at}:{i}", "CREATE" if at == 0 else "UPDATE_FIELDS", title=f"t{at}") for i in ids], SCHEMA)
    keeper.apply(make(range(40), 0), 0)
    before = keeper.manifest(spark)["tasks"]
    keeper.apply(make([3], 1000), 1)
    after = keeper.manifest(spark)["tasks"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(moved) == 1 and len(after) == len(before) > 5
    titles = {r.task_id: (r.title, r.version) for r in keeper.tasks(spark).collect()}
    assert titles["T3"] == ("t1000", 2) and len(titles) == 40 and titles["T4"] == ("t0", 1)


def test_a_batch_counts_once_and_a_broken_one_is_repeated(spark, tmp_path, rows, monkeypatch):
    keeper = TaskStore(f"file://{tmp_path}/store", 4)
    keeper.apply(spark.createDataFrame(rows[:100], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(TaskStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keeper.apply(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert keeper.manifest(spark)["batch"] == 0 and keeper.events(spark).count() == 100
    for _ in range(2):
        keeper.apply(spark.createDataFrame(rows[100:], SCHEMA), 1)
    got = {r.seq: (r.execution_status, r.failure_reason, r.version_after, r.title, r.status) for r in keeper.events(spark).collect()}
    assert got == execute(rows)


def test_an_empty_store_and_batch(spark, tmp_path):
    keeper = TaskStore(f"file://{tmp_path}/store", 4)
    assert keeper.tasks(spark).count() == 0 and keeper.events(spark).count() == 0
    keeper.apply(spark.createDataFrame([], SCHEMA), 0)
    assert keeper.manifest(spark)["batch"] == 0 and keeper.tasks(spark).count() == 0
    assert store.apply_commands(spark.createDataFrame([], SCHEMA)).count() == 0
