"""Numbers, neighbours and running sums in blocks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from minutary.operators import candidates, documents, ordered, projects, records, store


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    out = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, 0.1, 0.2, 0.9])) for i in range(600)]
    out += [(f"k{i}", 0, 0.5) for i in range(60)]
    r.shuffle(out)
    return spark.createDataFrame(out, "g string, ord long, v double").repartition(5), out


def groups(out):
    by = {}
    for row in sorted(out, key=lambda x: (str(x[0]), x[1])):
        by.setdefault(row[0], []).append(row)
    return by


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 18])
def test_numbers_and_sums(rows, block):
    df, out = rows
    want = {(g, row[1]): k for g, of in groups(out).items() for k, row in enumerate(of, 1)}
    assert {(r.g, r.ord): r.place for r in ordered.numbered(df, ["g"], ["ord"], block=block).collect()} == want
    everywhere = sorted((r.place, r.ord, r.g or "") for r in ordered.numbered(df, [], ["ord", "g"], block=block).collect())
    assert [x[0] for x in everywhere] == list(range(1, len(out) + 1)) and [x[1] for x in everywhere] == sorted(x[1] for x in out)
    got = {(r.g, r.ord): r.cluster for r in projects.clusters(df, "g", ["ord"], "v", 0.2, block).collect()}
    want = {}
    for g, of in groups(out).items():
        n = 0
        for row in of:
            n += row[2] is None or row[2] < 0.2
            want[g, row[1]] = n
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 18])
def test_neighbours(rows, block):
    df, out = rows
    made = lambda w: {"near": F.collect_list("ord").over(w.rowsBetween(-3, 2)), "prev": F.lag("ord").over(w)}
    got = ordered.neighbours(df, ["g"], [F.desc("ord")], 3, made, "at", block).collect()
    want = {}
    for g, of in groups(out).items():
        of = of[::-1]
        for k, row in enumerate(of):
            want[g, row[1]] = ([x[1] for x in of[max(0, k - 3) : k + 3]], of[k - 1][1] if k else None, k + 1)
    assert len(got) == len(out) and {(r.g, r.ord): (r.near, r.prev, r.at) for r in got} == want


def test_a_large_group_is_held_by_no_task(spark):
    df = spark.range(5000).selectExpr("'hot' as g", "id as ord")
    made = lambda w: {"before": F.lag("ord").over(w)}
    out = ordered.neighbours(df, ["g"], ["ord"], 1, made, block=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g" in plan and "_block" in plan
    assert out.filter("before <=> ord - 1 or ord = 0").count() == 5000


def test_the_operators_are_the_same_in_blocks(spark, rows):
    df, out = rows
    segs = df.selectExpr("g as file", "ord", "if(ord % 11 < 7, 'x', null) as session_title", "concat('t', ord) as clean_text")
    tasks = df.selectExpr("concat('T', ord, g) as task_id", "g as source_session_id", "concat('c-', ord) as source_key", "concat(repeat('e', 300), ord) as evidence_text")
    cands = df.selectExpr("g as department", "'p' as project", "concat('t', ord % 5) as title", "ord", "element_at(array('高', '中', '低'), cast(ord % 3 + 1 as int)) as priority")
    for whole, cut in (
        (documents.with_context(segs), documents.with_context(segs, block=9)),
        (store.training_rows(tasks), store.training_rows(tasks, block=9)),
        (candidates.sorted_rank(cands, "department"), candidates.sorted_rank(cands, "department", 9)),
        (candidates.sorted_rank(cands.filter("department is not null")), candidates.sorted_rank(cands.filter("department is not null"), block=9)),
        (records.page(df.filter("g = 'hot'"), ["ord"], 3, 20), records.page(df.filter("g = 'hot'"), ["ord"], 3, 20, block=9)),
        (records.page(df, ["ord"], 2, 5, "g"), records.page(df, ["ord"], 2, 5, "g", 9)),
    ):
        assert whole.columns == cut.columns
        want = sorted(map(str, whole.collect()))
        assert want and want == sorted(map(str, cut.collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, ord long, v double")
    assert ordered.numbered(df, ["g"], ["ord"]).count() == ordered.numbered(df, [], ["ord"]).count() == ordered._numbered(df, ["g"], ["ord"], "n").count() == 0
    assert projects.clusters(df, "g", ["ord"], "v", 0.2).count() == 0
