"""Operators over vectors against brute force, with nulls, copies, ties, repeated ids and other lengths."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from minutary.llm import hard_negatives, hnsw, segments

SCHEMA = "vec_id long, embedding array<float>, label int, score string, vector string, node string"


def f32(x):
    return None if x is None else [None if v is None else float(np.float32(v)) for v in x]


@pytest.fixture(scope="module")
def rows():
    """(vec_id, embedding, label); a third of them are copies of one vector, and a third more resemble it."""
    r = random.Random(3)
    hot = [r.gauss(0, 0.3) for _ in range(9)]
    out = []
    for i in range(400):
        kind = i % 3
        out.append((i, hot if kind == 0 else [x + r.gauss(0, 0.02) for x in hot] if kind == 1 else [r.gauss(0, 0.3) for _ in range(9)], r.randrange(4)))
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 9, 1), (503, [float("nan")] + [0.1] * 8, 1), (504, [float("inf")] + [0.1] * 8, 1), (505, [None] + [0.1] * 8, 1), (None, hot, 1), (506, hot, None)]
    odd += [(600, [0.5, -0.5, 0.25], 1), (601, [0.5, -0.5, 0.2], 1), (602, [0.1, -0.5, 0.2], 2), (700, [-x for x in hot], 9)]
    out += odd + [out[0], out[100], (100, hot[::-1], 3)]  # repeated rows, and one id with another vector
    return [(i, f32(v), k) for i, v, k in out]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "x", "x") for i, v, k in rows], SCHEMA).repartition(3)


def kept(rows, label=True):
    ok = [(i, v, k) for i, v, k in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (k is not None or not label)]
    found = {}
    for i, v, k in ok:
        k = (k + 1) % 10 if label and i % 7 == 0 else k
        found[i] = min(found.get(i, (k, v)), (k, v)) if label else (0, min(found.get(i, (0, v))[1], v))
    return found


def test_hard_negatives(vectors, rows):
    there = {i: (k, [math.floor(256 * x) for x in v]) for i, (k, v) in kept(rows).items()}
    want = []
    for a, (label, x) in there.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in there.items() if i != a and len(y) == len(x)}
        for p in sorted((i for i in score if there[i][0] == label), key=lambda i: (-score[i], i))[:5]:
            fit = sorted((i for i in score if there[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]), key=lambda i: (-score[i], i))
            want += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fit[:10])]
    out = hard_negatives.mine(vectors, label=hard_negatives.shifted_label())
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 40


def test_hard_negatives_over_many_segments(vectors, monkeypatch):
    whole = sorted(map(tuple, hard_negatives.mine(vectors).collect()))
    for name, n in (("SEGMENT_ROWS", 37), ("SEGMENT_ANCHORS", 2), ("ROWS", 11), ("ANCHORS", 1), ("SPARSE", 0.9)):
        monkeypatch.setattr(hard_negatives, name, n)
    assert sorted(map(tuple, hard_negatives.mine(vectors).collect())) == whole


def test_hard_negatives_of_nothing(vectors):
    assert hard_negatives.mine(vectors.limit(0)).count() == 0
    assert hard_negatives.mine(vectors.filter("vec_id % 100 <> 0")).count() == 0


def test_planes_drop_pairs_early_and_lose_none():
    r = np.random.default_rng(1)
    x, a = r.integers(-90, 90, (500, 33)), r.integers(-90, 90, (7, 33))
    n = max(1, int(np.maximum(x, -x - 1).max()).bit_length())
    planes = np.stack([np.packbits((x >> b) & 1, axis=1) for b in range(n, -1, -1)])
    full, asked = x @ a.T, []

    def fits(low, high, row, col):
        asked.append(high.size)
        assert (low <= full[row, col]).all() and (full[row, col] <= high).all()
        return high >= 40_000

    row, col, score = hard_negatives.survivors(planes, 33, a, fits)
    assert sorted(zip(row, col)) == sorted(zip(*np.nonzero(full >= 40_000))) and (full[row, col] == score).all()
    assert len(asked) == n + 1 and asked[-1] < asked[0] / 5


def cosines(there):
    """{query: {id: cosine}} for ids divisible by 50, in double precision."""
    out = {}
    for q, (_, a) in there.items():
        if q % 50 == 0:
            out[q] = {i: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) for i, (_, b) in there.items() if i != q and len(a) == len(b)}
    return out


def test_nearest_neighbours(vectors, rows):
    there = {i: (k, np.array(v)) for i, (k, v) in kept(rows, label=False).items() if any(v)}
    out = hnsw.nearest(vectors)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for q, rank, i, score in sorted(map(tuple, out.collect())):
        got.setdefault(q, []).append((i, score))
        assert rank == len(got[q])
    want = cosines(there)
    assert got.keys() == {q for q in want if want[q]} and 600 in got and len(got[600]) == 2  # two others of its length
    for q, found in got.items():
        best = sorted(want[q].items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert [i for i, _ in found] == [i for i, _ in best]
        assert np.allclose([s for _, s in found], [s for _, s in best], atol=1e-12, rtol=0)


def test_nearest_neighbours_of_nothing(vectors):
    assert hnsw.nearest(vectors.limit(0)).count() == 0
    assert hnsw.nearest(vectors.filter("vec_id % 50 <> 0")).count() == 0
    assert hnsw.nearest(vectors.filter("vec_id = 50")).count() == 0


def recall(x, shards, width):
    ids = np.arange(len(x))
    table = pa.table({"vec_id": ids, "vector": list(x)})
    graphs = [hnsw.pack_graph(table.filter(pa.array(ids % shards == s))) for s in range(shards)]
    (b,) = hnsw.searcher(5, width)(hnsw.pack_queries(table.filter(pa.array(ids % 50 == 0))), iter(graphs))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    across = unit[::50] @ unit.T
    across[np.arange(len(across)), ids[::50]] = -2
    want = {(50 * q, int(i)) for q, row in enumerate(np.argsort(-across, axis=1)[:, :5]) for i in row}
    return len(want & set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))) / len(want)


@pytest.mark.parametrize("kind", ["even", "groups", "crowd"])
def test_recall(kind):
    """Random vectors, groups of near copies, and one crowd of near copies that holds half of all."""
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 48))
    if kind == "groups":
        x = x[r.integers(0, 60, 3000)] + 0.2 * r.normal(size=x.shape)
    if kind == "crowd":
        x[::2] = x[0] + 0.05 * r.normal(size=(1500, 48))
    assert recall(x, 2, hnsw.BEAM) >= 0.97


def test_copies_give_the_smallest_ids():
    x = np.tile(np.random.default_rng(2).normal(size=(1, 8)), (2000, 1))
    table = pa.table({"vec_id": np.arange(2000)[::-1], "vector": list(x)})
    graphs = [hnsw.pack_graph(table.filter(pa.array(np.arange(2000) % 3 == s))) for s in range(3)]
    assert all(len(g["0.vectors"]) == 1 for g in graphs)
    (b,) = hnsw.searcher(5, 64)(hnsw.pack_queries(table.slice(1949, 1)), iter(graphs))
    assert b.column(1).to_pylist() == [0, 1, 2, 3, 4] and set(b.column(0).to_pylist()) == {50}


def test_links_are_flat_bounded_and_name_nodes_of_their_layer():
    x = np.random.default_rng(4).normal(size=(900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    level = np.repeat([2, 1, 0], [5, 60, 835])
    layers = hnsw.build(x, level)
    assert [a.shape for a in layers] == [(900, hnsw.BASE_LINKS), (65, hnsw.LINKS), (5, hnsw.LINKS)]
    for links in layers:
        assert (links < len(links)).all() and (links != np.arange(len(links))[:, None]).all()
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() > 0 for row in links)


def test_very_large_and_small_components():
    table = pa.table({"vec_id": [0, 1, 2, 3], "vector": [[1e300, 1e300], [1e-300, 1e-300], [1.0, 0.0], [5e-324, 0.0]]})
    (b,) = hnsw.searcher(5, 64)(hnsw.pack_queries(table.slice(0, 1)), iter([hnsw.pack_graph(table)]))
    assert b.column(1).to_pylist() == [1, 2, 3] and np.allclose(b.column(2).to_numpy(), [1, 0.5**0.5, 0.5**0.5])


def test_segments_hold_all_rows_in_bounded_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id").repartition(3)
    names = segments.write(df, f"file://{tmp_path}/s", lambda t: {"id": t.column("id").to_numpy()}, 64)
    parts = [segments.read(f"file://{tmp_path}/s", n)["id"] for n in names]
    assert sorted(np.concatenate(parts)) == list(range(1000)) and max(map(len, parts)) == 64
    out = segments.tiles(spark, (f"file://{tmp_path}/s", names[:3]), (f"file://{tmp_path}/s", names), lambda a, bs: (pa.RecordBatch.from_arrays([pa.array([len(a["id"]) * len(b["id"])])], ["n"]) for b in bs), "n long")
    assert out.agg({"n": "sum"}).first()[0] == 1000 * sum(map(len, parts[:3]))
