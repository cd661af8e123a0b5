"""Operator 6: benchmark decontamination over a distributed positional inverted index.

The documents are indexed in segments (one Arrow batch each): for every test term its sorted
word positions in the segment, stored as Parquet in the shared folder. Matching reads segments
back; for each test window it starts from the term with the shortest list in that segment and
intersects the others' lists, shifted by their offsets. Proximity matches allow each later term
to stand up to ``slop`` words off its place.

Words: A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics. A window is
``size`` consecutive words of an item; an item of fewer (not none) is one window. Documents lie
apart in the position space, so that no match crosses from one to the next.

Null texts have no words; repeated rows give repeated results; repeated items count once; extra
columns are ignored; with no items nothing is hit; without documents there are no rows. The
test vocabulary is broadcast only up to ``MAX_VOCABULARY`` words: beyond it every word is
indexed by its hash. Windows are dealt out in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

#: Windows in a broadcast block, and words in the broadcast vocabulary.
BLOCK_WINDOWS, MAX_VOCABULARY = 200_000, 1_000_000
GAP = 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1  # never 0


class Windows:
    """A block of test windows: term hashes (0 beyond the end), lengths, and the items of each."""

    def __init__(self, rows: dict[tuple[bytes, ...], set]):
        width = max((len(w) for w in rows), default=1)
        self.terms = np.zeros((len(rows), width), np.uint64)
        for i, w in enumerate(rows):
            self.terms[i, : len(w)] = [term_hash(x) for x in w]
        self.length = np.array([len(w) for w in rows], np.int64)
        self.items = [sorted(v, key=str) for v in rows.values()]


def window_blocks(items, size: int):
    """Blocks of windows from (item_id, text) rows; a window met in several blocks is matched in each."""
    block: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            block.setdefault(tuple(w[i : i + size]), set()).add(item)
        if len(block) >= BLOCK_WINDOWS:
            yield Windows(block)
            block = {}
    if block:
        yield Windows(block)


def index_documents(docs: DataFrame, vocabulary, bin_: list[str] | None = None) -> DataFrame:
    """Segments of postings; vocabulary: a broadcast dict from word to hash, or None for all words."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        class All(dict):
            def __missing__(self, w):
                if len(self) > 500_000:
                    self.clear()
                self[w] = h = term_hash(w)
                return h

        known = All() if vocabulary is None else None
        for b in common.batches(batches):
            counts, hashes = [], []
            for text in b.column("text").to_pylist():
                w = words(text)
                counts.append(len(w))
                hashes.append(np.fromiter(map(known.__getitem__, w) if known is not None else map(vocabulary.value.get, w, repeat(0)), np.uint64, len(w)))
            n = np.array(counts, np.int64)
            starts = np.concatenate(([0], np.cumsum(n + GAP)))[:-1] if len(n) else n
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            place = np.repeat(starts - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(every)) if len(n) else n
            kept = np.flatnonzero(every)
            terms, inverse = np.unique(every[kept], return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), b.column("doc_id")),
                    pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n)),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([np.bincount(inverse, minlength=len(terms)).astype("<u4").tobytes()], pa.binary()),
                    pa.array([place[kept][order].astype("<u4").tobytes()], pa.binary()),
                ],
                ["doc_ids", "n_words", "terms", "frequency", "positions"],
            )

    return common.settle(docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, n_words array<long>, terms binary, frequency binary, positions binary"), "postings", bin_)


def positions_of(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    return keys[at] & 0xFFFFFFFF


def _occurrences(win: Windows, terms, frequency, positions, slop: int):
    """(window, first position, reach) of each occurrence in a segment."""
    if not len(terms) or not len(win.length):
        return np.zeros((3, 0), np.int64)
    begins = np.concatenate(([0], np.cumsum(frequency)))
    at = np.searchsorted(terms, win.terms)
    at[at == len(terms)] = 0
    used = np.arange(win.terms.shape[1]) < win.length[:, None]
    live = np.flatnonzero(((terms[at] == win.terms) | ~used).all(axis=1))
    at, used = at[live], used[live]
    rarest = np.where(used, frequency[at], np.iinfo(np.int64).max).argmin(axis=1)
    lead = at[np.arange(len(live)), rarest]
    n = frequency[lead]
    w = np.repeat(np.arange(len(live)), n)
    p = positions[np.repeat(begins[lead], n) + np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)]
    # one sorted list of (term, position) serves every list of the segment
    keys = np.repeat(np.arange(len(terms)), frequency) << 32 | positions
    first = p - rarest[w]
    ok = first >= 0
    w, p, first = w[ok], p[ok], first[ok]
    low, high = first.copy(), first + win.length[live][w] - 1
    for j in range(win.terms.shape[1]):
        want = np.where(used[w, j], at[w, j] << 32 | (first + j - slop).clip(0), 0)
        found = np.searchsorted(keys, want)
        found[found == len(keys)] = len(keys) - 1
        near = keys[found] - want
        ok = ~used[w, j] | (near >= 0) & (near <= 2 * slop) if slop else ~used[w, j] | (near == 0)
        w, first, low, high = w[ok], first[ok], low[ok], high[ok]
        if slop:  # the words between the first and the last place at which a term was met are hit
            place = np.where(used[w, j], positions_of(keys, found[ok]), first + j)
            low, high = (place, place) if j == 0 else (np.minimum(low, place), np.where(used[w, j], np.maximum(high, place), high))
    return np.stack([live[w], low, high - low + 1])


def match(segments: DataFrame, blocks: list, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each indexed document."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in common.batches(batches, 8):
            out = [[] for _ in range(4)]
            ids = pa.concat_arrays([b.column("doc_ids").flatten()])
            for i in range(b.num_rows):
                n = np.array(b.column("n_words")[i].as_py(), np.int64)
                terms, frequency, positions = (np.frombuffer(b.column(c)[i].as_py(), d) for c, d in (("terms", "<u8"), ("frequency", "<u4"), ("positions", "<u4")))
                frequency, positions = frequency.astype(np.int64), positions.astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(n + GAP)))
                cover, items = np.zeros(starts[-1] + 1, np.int64), {}
                for block in blocks:
                    win = block.value
                    w, first, reach = _occurrences(win, terms, frequency, positions, slop)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + reach, -1)
                    for d, k in set(zip((np.searchsorted(starts, first, side="right") - 1).tolist(), w.tolist())):
                        items.setdefault(d, set()).update(win.items[k])
                hit = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
                hits = (hit[starts[1:]] - hit[starts[:-1]]).tolist()
                for d in range(len(n)):
                    own = sorted(map(str, items.get(d, ())))
                    for col, v in zip(out, (int(n[d]), hits[d], len(own), hashlib.sha256(",".join(own).encode()).hexdigest())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return segments.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Index docs(doc_id, text) for the terms of benchmark(item_id, text) and match them."""
    sc = docs.sparkSession.sparkContext
    blocks, vocabulary = [], {}
    for win_rows in window_blocks(((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator()), size):
        blocks.append(sc.broadcast(win_rows))
    for r in benchmark.select("text").toLocalIterator():
        if vocabulary is not None:
            vocabulary.update((w, term_hash(w)) for w in words(r[0]))
            if len(vocabulary) > MAX_VOCABULARY:
                vocabulary = None
    bin_: list[str] = []
    return common.final(match(index_documents(docs, None if vocabulary is None else sc.broadcast(vocabulary), bin_), blocks, slop), "hits", bin_)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs that hold no benchmark window, with their own columns."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = scan(docs.select(sha.alias("doc_id"), "text"), benchmark, size).filter("contaminated").select(F.col("doc_id").alias("__sha")).distinct()
    wide = docs.select(F.struct("*").alias("_row"), sha.alias("__sha"))
    return wide.join(bad, "__sha", "left_anti").select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, sizes.n, array_to_string(w[i:i+sizes.n-1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) u(i) WHERE len(w) >= sizes.n),
hit AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.n = win.n AND occ.s = win.s),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
