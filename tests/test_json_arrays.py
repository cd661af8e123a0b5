"""JSON arrays read in ranges against json.loads, for every way a range can begin."""

import io
import json
import random

import pytest
from minutary.sources import json_arrays, readers

WORDS = ["a", '"', "\\", '\\"', "[", "]", "{", "}", ",", "é", " ", "😀", " ", "\n", '\\\\"', "\\\\\\"]


def value(r, deep=0):
    k = r.randrange(7 if deep < 4 else 4)
    if k < 2:
        return "".join(r.choice(WORDS) for _ in range(r.randrange(8)))
    if k < 4:
        return r.choice([None, True, -1.5, 7, ""])
    return [value(r, deep + 1) for _ in range(r.randrange(4))] if k < 6 else {value_key(r): value(r, deep + 1) for _ in range(r.randrange(4))}


def value_key(r):
    return "".join(r.choice(WORDS) for _ in range(3))


@pytest.mark.parametrize("seed", range(12))
def test_ranges_of_every_size(seed):
    r = random.Random(seed)
    rows = [value(r) for _ in range(r.randrange(12))]
    data = (" " * r.randrange(3) + json.dumps(rows, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2])) + "\n").encode()
    for size in (1, 2, 3, 7, 20, 1000):
        for piece in (1, 5, 1 << 20):
            state, depth, ord_, got, f = 0, 0, 0, [], io.BytesIO(data)
            for start in range(0, len(data), size):
                end = min(len(data), start + size)
                got += json_arrays.items(f, start, end, len(data), state, depth, ord_, piece)
                went = json_arrays.describe(json_arrays.pieces(f, start, end, piece))[state]
                ord_ += went["commas"].get(1 - depth, 0)
                state, depth = went["state"], depth + went["depth"]
            assert (state, depth) == (0, 0)
            assert [k for k, _ in got] == list(range(len(rows))) and [json.loads(x) for _, x in got] == rows


def test_files(spark, tmp_path):
    r = random.Random(3)
    want = {}
    for name, n in (("a.json", 200), ("b c+é%20.json", 1), ("none.json", 0)):
        want[name] = [{"k": value(r), "no": i} for i in range(n)]
        (tmp_path / name).write_text(json.dumps(want[name], ensure_ascii=False))
    (tmp_path / "long.json").write_text(json.dumps([{"x": "y" * 5000}, {"x": 1}]))
    want["long.json"] = [{"x": "y" * 5000}, {"x": 1}]
    for name, text in (("object.json", '{"segments": [1, 2]}'), ("open.json", '[1, 2, "x'), ("two.json", "[1]\n[2]"), ("empty.json", ""), ("blank.json", "  \n")):
        (tmp_path / name).write_text(text)
    for size in (64, 1 << 25):
        rows = json_arrays.array_items(spark, str(tmp_path), size).collect()
        got = {}
        for row in sorted(rows, key=lambda x: (x.file, x.ord)):
            got.setdefault(row.file.rsplit("/", 1)[-1], []).append((row.ord, json.loads(row.value)))
        assert {k: [x for _, x in v] for k, v in got.items()} == {k: v for k, v in want.items() if v}
        assert all([k for k, _ in v] == list(range(len(v))) for v in got.values())
    with pytest.raises(Exception, match="no closed JSON array"):
        json_arrays.array_items(spark, str(tmp_path / "open.json"), strict=True).collect()


def test_a_long_array_takes_several_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"segment_id": f"s{i}", "clean_text": "t" * 50} for i in range(3000)]))
    known = json_arrays.chained(spark, str(tmp_path), 8192).collect()
    assert len(known) > 20 and len({r.ord for r in known}) == len(known)
    rows = readers.segments(spark, str(tmp_path))
    assert [(r.ord, r.segment_id) for r in rows.orderBy("ord").collect()] == [(i, f"s{i}") for i in range(3000)]
