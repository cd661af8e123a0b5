"""Operator 7: packing by shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of at most ``size`` tokens. The histogram of piece
lengths (at most ``size`` rows, whatever the corpus) goes to the driver, which places lengths
longest first, each into the pack with the fewest tokens so far, and keeps packs only as
patterns with counts. A piece finds its sequence by its rank among pieces of its length: rank
within its task, plus the count of that length in the tasks before it.

Null text is empty: it gives one piece holding only the end id. Repeated rows are packed like
any other; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .units import WordUnits, public_path


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, largest first) with how many packs follow each."""
    open_packs: dict[tuple[int, tuple[tuple[int, int], ...]], int] = {}
    heap: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    closed: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)

    def put(used: int, pattern, n: int) -> None:
        if used == size:
            closed[pattern] += n
            return
        key = (used, pattern)
        if key not in open_packs:
            open_packs[key] = 0
            heapq.heappush(heap, key)
        open_packs[key] += n

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            if heap and heap[0][0] + length <= size:
                used, pattern = key = heap[0]
                have = open_packs[key]
                # as many of this length as each pack takes before it stops being the shortest
                n = min(left, have)
                heapq.heappop(heap)
                del open_packs[key]
                if have > n:
                    put(used, pattern, have - n)
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern and pattern[-1][0] == length else (*pattern, (length, 1))
                put(used + length, grown, n)
                left -= n
            else:
                fit = size // length
                whole, rest = divmod(left, fit)
                # the shortest pack has no room: each new pack is then the shortest until it is full
                if whole:
                    put(length * fit, ((length, fit),), whole)
                if rest:
                    put(length * rest, ((length, rest),), 1)
                left = 0
    for key, n in open_packs.items():
        closed[key[1]] += n
    return [(tuple(x for x, k in pattern for _ in range(k)), n) for pattern, n in sorted(closed.items(), reverse=True)]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), sorted by first rank."""
    rank: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, path: str, size: int, end_id: int, bin_: list[str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, pid, local_rank; settled in the shared folder."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "local_rank"]

    def run(batches):
        cache = WordUnits.of_worker(path, 4)
        pid, seen, end = TaskContext.get().partitionId(), defaultdict(int), end_id.to_bytes(4, "little")
        for b in common.batches(batches):
            keys, where, cols = b.column("doc_id"), [], [[] for _ in names[1:]]
            for i, units in enumerate(cache.documents(b.column("text").to_pylist())):
                raw = b"".join(units) + end
                total = len(raw) // 4
                for start in range(0, total, size):
                    n = min(size, total - start)
                    where.append(i)
                    for col, v in zip(cols, (start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, pid, seen[n])):
                        col.append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(where, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    return common.settle(out, "pieces", bin_)


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bin_: list[str] = []
    cut = pieces(docs, path or public_path("word_bpe_49k.json"), size, end_id, bin_)
    per_task = cut.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(slot_table(pack_histogram(histogram, size)))
    before = per_task.select("pid", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("rank_before"))
    ranked = cut.join(before, ["pid", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank_before") + F.col("local_rank")).alias("rank"))

    def place(batches):
        tables = slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                t = tables[int(length[own[0]])]
                at = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                seq[own], off[own] = t[at, 1] + rank[own] - t[at, 0], t[at, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return common.final(placed, "packed", bin_)
