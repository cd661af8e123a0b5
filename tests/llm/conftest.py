"""A small table with nulls, empty and long texts, copies, near copies, repeated rows, shared passages and clashing columns."""

import random

import pytest

CLASH = ("_text", "sha", "node", "size", "kept", "n_words", "shard", "pid", "block", "_row", "class_id")


def texts(seed=5):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(pool) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    passage, base, long = make(60), make(120).split(" "), make(6000)
    out = [None, "", " ", "\n\n", "one", "two words", "<|endoftext|> x", "a  b\tc \x00d", "😀 é é İ Σ.", make(3), make(4), make(5)]
    out += [make(r.choice([8, 30, 90, 200])) for _ in range(25)] + [long, long + " end", make(900)]
    for k in range(12):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = r.choice(pool)
        out.append(" ".join(w))
    out += [" ".join(base)] * 4 + [make(20) + " " + passage + " " + make(20) for _ in range(5)] + ["no no no no no no no no no no no no no no"] * 2
    return out, passage


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) rows; ids descend, and the last row stands twice."""
    t, _ = texts()
    rows = [(10_000 - 7 * i, x) for i, x in enumerate(t)]
    return [*rows, rows[-1]]


@pytest.fixture(scope="session")
def docs(spark, sample):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, *CLASH) for i, t in sample], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def passage():
    return texts()[1]
