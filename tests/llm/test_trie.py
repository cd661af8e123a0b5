"""The prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from minutary.llm import common, prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string, keys string, path string, kind string"


@pytest.fixture(scope="module")
def rows():
    """Conversations with nulls, shared starts, copies, repeated rows, a hundred without its first, and a long one."""
    r = random.Random(11)
    say = ["a", "b", "é😀", "", None, "hello there"]
    out = []
    for c in [*range(0, 60), *range(100, 160), *range(301, 340), 100_000, 1_000_003]:
        turns = [("user", "a"), ("assistant", "b"), ("user", "é😀")][: r.randint(0, 3)] + [(r.choice(["user", "assistant", None]), r.choice(say)) for _ in range(r.randint(0 if c else 3, 5))]
        for i, (role, text) in enumerate(turns or [("user", "a")]):
            out.append((c, i if r.random() < 0.95 or i else None, role, text))
    out += [(c, i, "user", t) for c in range(400, 440) for i, t in enumerate("abcdefg")]  # copies, whatever they borrow
    out += [(500, i, "user", "again") for i in range(90)]
    out += [(None, 0, "user", "nobody"), (None, None, None, None), (33, 90, "user", "twice"), (33, 90, "user", "twice")]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def nodes(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or "")[:32], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def wanted(rows):
    return nodes(rows)


def got(df):
    assert df.columns == list(P.RESULT)
    return sorted(map(tuple, df.collect()))


def test_trie(conversations, wanted):
    assert got(P.trie(conversations)) == wanted
    assert any(n[1] == 90 for n in wanted) and any(n[3] >= 30 and n[4] == 0 for n in wanted)


@pytest.mark.parametrize("bytes_", [1000, 5000])
def test_nodes_that_span_many_ranges(conversations, wanted, monkeypatch, bytes_):
    monkeypatch.setattr(P, "PART_BYTES", bytes_)
    monkeypatch.setattr(common, "small", lambda df: df)  # and names are joined in salted parts
    assert got(P.trie(conversations)) == wanted


def test_empty_and_single(spark, conversations):
    assert P.trie(conversations.limit(0)).count() == 0
    one = spark.createDataFrame([(7, None, None, None)], "conv_id long, turn int, role string, text string")
    assert got(P.trie(one)) == nodes([(7, None, None, None)])


def sequence(*turns):
    return b"".join(hashlib.md5(t.encode()).digest() for t in turns)


def runs_of(items, sizes):
    out, at = [], 0
    for n in sizes:
        rows = sorted(items[at : at + n])
        out.append([(k, c, [1] * (len(k) // 16), P.shared(rows[i - 1][0], k) if i else 0) for i, (k, c) in enumerate(rows)])
        at += n
    return out


@pytest.mark.parametrize("sizes", [[40], [10, 30], [1, 2, 3, 34], [5] * 8, [3] * 13 + [1]])
def test_merge_gives_order_and_lcps(sizes):
    r = random.Random(len(sizes))
    items = [(sequence(*(r.choice("ab") for _ in range(r.randint(0, 6)))), i) for i in range(40)]
    merged = list(P.merge(runs_of(items, sizes)))
    assert [m[:2] for m in merged] == sorted(items)
    assert [m[3] for m in merged][1:] == [P.shared(a[0], b[0]) for a, b in zip(merged, merged[1:])]


def test_shared_turns_are_not_compared_again(monkeypatch):
    """16 runs of sequences that share their first 200 turns: each is read over that part about once, not once a comparison."""
    start = sequence(*map(str, range(200)))
    items = [(start + sequence(f"x{i}"), i) for i in range(160)]
    runs, read, plain = runs_of(items, [10] * 16), [], P.shared
    monkeypatch.setattr(P, "shared", lambda x, y, at=0: read.append(plain(x, y, at) - at) or plain(x, y, at))
    assert len(list(P.merge(runs))) == 160 and sum(read) < 200 * 16 * 2


def test_fragments_of_any_cut_make_the_same_nodes(monkeypatch):
    r = random.Random(5)
    items = sorted((sequence(*(r.choice("ab") for _ in range(r.randint(0, 5)))), i) for i in range(120))
    monkeypatch.setattr(P, "CHUNK", 2)
    found = set()
    for cuts in ([], [60], [1, 2, 3, 50, 51], list(range(1, 120))):
        done, fragments, loose = [], [], []
        for part, (i, j) in enumerate(zip([0, *cuts], [*cuts, 120])):
            rows = list(P.trie_rows(P.merge(runs_of(items[i:j], [j - i])), part))
            done += [r for r in rows if r[0] == P.DONE]
            loose += [r for r in rows if r[0] == P.LOOSE]
            fragments += [r for r in rows if r[0] == P.FRAGMENT]
        border = [row for b in P.join_fragments(P._batches(iter(fragments), P._PART)) for row in zip(*(c.to_pylist() for c in b.columns))]
        name = {b[0]: b[2] for b in border}
        all_ = [(r[4], r[5], r[6], *r[7:12]) for r in done] + [(r[4], r[5], name[r[3]], *r[7:12]) for r in loose] + [(b[2], b[3], name.get(b[1]), *b[4:]) for b in border]
        found.add(tuple(sorted(all_, key=str)))
    assert len(found) == 1
