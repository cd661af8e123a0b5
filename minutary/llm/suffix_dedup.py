"""Operator 5: repeated passages by a run-length index.

1. Anchors: from every window of ``length`` bytes the least hash of its 64-byte strings is
   taken (winnowing), so equal windows have equal anchors; windows in a row with one anchor are
   one row. An anchor that stands at two or more places makes its windows candidates.
2. Blocks: candidates of all anchors with the same first text go to one block, where the
   windows of a text are joined to segments. Equal windows share their anchor, and so meet in
   one block. Blocks over ``BLOCK_BYTES`` are split by anchor. An anchor whose places alone have
   more bytes is not indexed: equal places are counted and, where there are several, marked
   whole; of one of each the windows are dealt by a 128-bit hash, so that equal ones still meet,
   and those that stand at two places are marked. That streams, whatever the number of places.
3. Index: a block's segments are suffix-sorted (prefix doubling over ties, a terminator of its
   own for each segment); the Burrows-Wheeler transform is kept as runs with the text places
   sampled at both ends of each run. At a run's head the match with the suffix before it is
   measured; within runs a match is its left neighbour's less one byte, so streaming the
   samples over the text gives every place's matching statistic. Places with ``length`` or more
   mark the bytes that they match.
4. Marked bytes of each text are removed. Texts that occur twice or more and have ``length``
   bytes are removed whole; only one copy of them takes part in steps 1 to 3.

Texts have numbers of 60 bits of their SHA-256; texts that share one are found and numbered anew, so that none is left out.
Anchors are 64-bit hashes (a clash only makes more candidates), windows of wide anchors have 128 bits.

Null text is empty; null ids are kept. Rows with equal texts, repeated rows among them, count as documents that
repeat each other. Extra columns are ignored (kept by ``strip_documents``); an empty table
gives no rows. Memory of a task: one block (at most about 4 x ``BLOCK_BYTES``) and its suffix array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

LENGTH, GRAM = 200, 64
#: Bytes of a block before it is split, and of text taken at a time when anchors are chosen.
BLOCK_BYTES, CHUNK = 1 << 20, 1 << 20
_SEEN = 200_000


def _table() -> np.ndarray:
    return common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first window, last window, several) runs over the texts that end at ``ends`` in data.

    A run is of windows with one least hash; several: it stands at more than one place, as in periodic text.
    """
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if n < length:
        return none
    h, span, mul = _table()[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while span < gram:  # gram is a power of two
        h = h[: len(h) - span] * mul + h[span:]
        with np.errstate(over="ignore"):
            mul = mul * mul
        span *= 2
    h = common.mix64(h)
    width = length - gram + 1
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
    # least of every `width` neighbours: minima from both ends of fixed stretches
    pad = -len(key) % width
    full = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: n - length + 1], head[width - 1 : width - 1 + n - length + 1])
    pick = (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)
    # windows that cross the end of a text don't count
    inside = np.zeros(n - length + 1, bool)
    start = 0
    for end in ends.tolist():
        if end - start >= length:
            inside[start : end - length + 1] = True
        start = end
    value = h[pick]  # a function of the window's bytes alone
    change = np.ones(len(pick), bool)
    change[1:] = (value[1:] != value[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    if not len(first):
        return none
    stop = np.ones(len(pick), bool)
    stop[:-1] = (value[1:] != value[:-1]) | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    return value[first], first, last, pick[first] != pick[last]


class RunIndex:
    """Run-length Burrows-Wheeler transform of segments, with text places sampled at run ends."""

    def __init__(self, segments: list[bytes]):
        self.lengths = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        n = len(self.text)
        left = np.zeros(n, np.int64)  # bytes to the terminator
        for s, k in zip(self.starts.tolist(), self.lengths.tolist()):
            left[s : s + k + 1] = np.arange(k, -1, -1)
        self.left = left
        order = self._sort(n)
        before = np.where(order == 0, 0, self.text[order - 1].astype(np.int64))
        opens = np.zeros(n, bool)
        opens[self.starts] = True
        first = opens[order]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | first[1:] | first[:-1]
        #: runs: their symbols, lengths, and the text places of their first and last suffixes
        at = np.flatnonzero(head)
        self.symbols, self.run_lengths = before[at], np.diff(np.concatenate((at, [n])))
        self.head_place, self.end_place = order[at], order[np.concatenate((at[1:], [n])) - 1]

    def _sort(self, n: int) -> np.ndarray:
        """Suffix array; a suffix ends with its segment's own terminator, which is less than any byte."""
        text, left = np.concatenate((self.text, np.zeros(7, np.uint8))), self.left
        key = np.zeros(n, np.uint64)
        for j in range(7):
            key |= np.where(left > j, text[j : j + n], 0).astype(np.uint64) << np.uint64(8 * (7 - j))
        key |= np.minimum(left, 7).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < 7)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head
        alone = new & np.concatenate((new[1:], [True]))
        tied, depth = np.flatnonzero(~alone), 7
        while len(tied):
            own = order[tied]
            pair = rank[own] << 32 | rank[own + depth]
            by = np.argsort(pair, kind="stable")
            own, pair = own[by], pair[by]
            order[tied] = own
            new = np.ones(len(tied), bool)
            new[1:] = pair[1:] != pair[:-1]
            rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            alone = new & np.concatenate((new[1:], [True]))
            tied, depth = tied[~alone], depth * 2
        return order

    def matching_statistics(self) -> np.ndarray:
        """For each text place the longest match of what follows with another place, where it reaches a sample's."""
        reach = np.zeros(len(self.text), np.int64)
        p, q = self.end_place[:-1], self.head_place[1:]
        most, got = np.minimum(self.left[p], self.left[q]), np.zeros(len(p), np.int64)
        wide = np.concatenate((self.text, np.zeros(8, np.uint8)))
        words = np.lib.stride_tricks.sliding_window_view(wide, 8).copy().view(np.uint64).ravel()
        live = np.flatnonzero(most > 0)
        while len(live):
            at = got[live]
            same = (words[p[live] + at] == words[q[live] + at]) & (at + 8 <= most[live])
            got[live[same]] += 8
            live = live[same]
        # up to seven bytes more
        for _ in range(7):
            ok = got < most
            ok[ok] = self.text[p[ok] + got[ok]] == self.text[q[ok] + got[ok]]
            got[ok] += 1
        np.maximum.at(reach, p, got + p)
        np.maximum.at(reach, q, got + q)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)

    def marked(self, length: int) -> list[list[tuple[int, int]]]:
        """For each segment the maximal stretches covered by matches of ``length`` or more."""
        found = self.matching_statistics() >= length
        cover = np.zeros(len(self.text) + 1, np.int64)
        at = np.flatnonzero(found)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        on = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0]))
        begin, end = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        own = np.searchsorted(self.starts, begin, side="right") - 1
        for s, b, e in zip(own.tolist(), (begin - self.starts[own]).tolist(), (end - self.starts[own]).tolist()):
            out[s].append((b, e))
        return out


def _anchor_rows(batches, length: int, gram: int):
    seen: set = set()
    width = 1 << 20

    def emit(buffer, sizes, owners, offsets):
        ends = np.cumsum(np.array(sizes, np.int64))
        h, a, b, several = anchors(np.frombuffer(b"".join(buffer), np.uint8), ends, length, gram)
        d = np.searchsorted(ends, a, side="right")
        shift = np.array(offsets, np.int64) - np.concatenate(([0], ends))[:-1]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(owners, np.int64)[d]), pa.array(a + shift[d]), pa.array(b + shift[d]), pa.array(several.astype(np.int64))], ["anchor", "own", "a", "b", "many"])

    buffer, sizes, owners, offsets, held = [], [], [], [], 0
    for batch in common.batches(batches):
        for own, text in zip(batch.column("_own").to_pylist(), batch.column("_text").to_pylist()):
            if own in seen:
                continue
            if len(seen) < _SEEN:
                seen.add(own)
            raw = text.encode("utf-8")
            if len(raw) < length:
                continue
            for at in range(0, len(raw) - length + 1, width):
                part = raw[at : at + width + length - 1]
                buffer.append(part)
                sizes.append(len(part))
                owners.append(own)
                offsets.append(at)
                held += len(part)
                if held >= CHUNK:
                    yield emit(buffer, sizes, owners, offsets)
                    buffer, sizes, owners, offsets, held = [], [], [], [], 0
    if held:
        yield emit(buffer, sizes, owners, offsets)


def _shared(batches):
    """Of rows sorted by anchor, own, a: those whose anchor stands at two or more places, and the anchor's first text."""
    last = None  # the last row of an anchor, which waits for the anchor's next place
    lead_anchor = lead = None  # an anchor with rows sent on already, and its first text
    names = ("anchor", "own", "a", "b", "many")
    for batch in batches:
        if not batch.num_rows:
            continue
        h, own, a, b, many = (batch.column(c).to_numpy() for c in names)
        if last is not None:
            h, own, a, b, many = (np.concatenate(([x], y)) for x, y in zip(last, (h, own, a, b, many)))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1]) | (a[1:] != a[:-1])
        h, own, a, b, many = h[fresh], own[fresh], a[fresh], b[fresh], many[fresh]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        leads = own[begin].copy()
        several = many > 0
        several[1:] |= ~first[1:]
        several[:-1] |= ~first[1:]
        if lead_anchor is not None and h[0] == lead_anchor:
            run = h == lead_anchor
            leads[run], several[run] = lead, True
        lead_anchor, lead = (h[-1], leads[-1]) if several[-1] else (None, None)
        last = (h[-1], own[-1], a[-1], b[-1], many[-1])
        several[-1] = False
        keep = np.flatnonzero(several)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (leads, h, own, a, b)], ["lead", *names[:4]])
    if lead_anchor is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (lead, *last[:4])], ["lead", *names[:4]])


def _windows(batches, length: int):
    """(w1, w2: 128 bits of its hash, own, s, met) of each window of rows of own, s, bytes.

    Of windows that are equal among those taken at a time one goes on under its hash; the others have met it,
    and go under a hash of their place, so that a very frequent window costs few rows in one task.
    """

    def hashed(held):
        counts = np.array([len(x) - length + 1 for _, _, x in held], np.int64)
        w = np.frombuffer(b"".join(hashlib.blake2b(x[k : k + length], digest_size=16).digest() for _, _, x in held for k in range(len(x) - length + 1)), np.int64).reshape(-1, 2)
        step = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
        own, s = (np.repeat(np.array([x[i] for x in held], np.int64), counts) for i in (0, 1))
        s = s + step
        order = np.lexsort((w[:, 1], w[:, 0]))
        w1, w2, own, s = w[order, 0], w[order, 1], own[order], s[order]
        again = np.zeros(len(w1), bool)
        again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        met = again | np.append(again[1:], False)
        w1[again], w2[again] = common.mix64(own[again].view(np.uint64)).view(np.int64), common.mix64((s[again] + 1).view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, own, s, met.astype(np.int64))], ["w1", "w2", "own", "s", "met"])

    held, size = [], 0
    for b in common.batches(batches):
        for row in zip(*(b.column(c).to_pylist() for c in ("own", "s", "bytes"))):
            held.append(row)
            size += len(row[2]) - length + 1
            if size >= 1 << 18:
                yield hashed(held)
                held, size = [], 0
    if held:
        yield hashed(held)


def _met(batches):
    """(own, s) of rows sorted by w1, w2 that have met an equal window or stand beside one."""
    names = ("w1", "w2", "own", "s", "met")
    last, met = None, False  # the last row, which waits for the next, and whether the one before equals it
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy() for c in names]
        if last is not None:
            rows = [np.concatenate(([x], y)) for x, y in zip(last, rows)]
        same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        on = np.concatenate(([met], same)) | np.concatenate((same, [False])) | (rows[4] > 0)
        last, met = [x[-1] for x in rows], bool(on[-1])
        keep = np.flatnonzero(on[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows[2:4]], ["own", "s"])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last[2:4]], ["own", "s"])


def _stretches(batches, length: int):
    """(own, s, e) of windows in a row, of rows sorted by own, s."""
    for b in batches:
        own, s = (b.column(c).to_numpy() for c in ("own", "s"))
        first = np.ones(len(s), bool)
        first[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)
        at = np.flatnonzero(first)
        stop = np.append(at[1:], len(s))[: len(at)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[at], s[at], s[stop] + length)], ["own", "s", "e"])


def _wide_spans(texts: DataFrame, bin_: list[str], length: int) -> DataFrame:
    """(sha, s, e) that the places of wide anchors mark, in any number of tasks; texts(own, sha, _text, cuts)."""
    parts = common.partitions(texts.sparkSession)

    def places(batches):
        for b in common.batches(batches):
            for own, text, cuts in zip(*(b.column(c).to_pylist() for c in ("own", "_text", "cuts"))):
                raw = text.encode("utf-8")
                at = [(c["a"], min(c["e"], len(raw))) for c in cuts if c["wide"]]
                found = [raw[s:e] for s, e in at]
                columns = [hashlib.blake2b(x, digest_size=16).digest() for x in found], [own] * len(at), [s for s, _ in at], [e for _, e in at], found
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "own", "s", "e", "bytes"])

    wide = texts.filter(F.exists("cuts", lambda c: c["wide"]))
    each = common.settle(wide.select("own", "_text", "cuts").mapInArrow(places, "h binary, own long, s long, e long, bytes binary"), "places", bin_)
    kinds = common.settle(each.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("own", "s", "bytes")).alias("one")), "place-kinds", bin_)
    whole = each.select("h", "own", "s", "e").join(kinds.filter("n > 1").select("h"), "h").select("own", "s", "e")
    windows = kinds.select("one.own", "one.s", "one.bytes").mapInArrow(lambda x: _windows(x, length), "w1 long, w2 long, own long, s long, met long")
    met = windows.repartition(parts, "w1", "w2").sortWithinPartitions("w1", "w2").mapInArrow(_met, "own long, s long")
    some = met.repartition(parts, "own").sortWithinPartitions("own", "s").mapInArrow(lambda x: _stretches(x, length), "own long, s long, e long")
    return whole.union(some).join(wide.select("own", "sha"), "own").select("sha", "s", "e")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds _text, _sha (SHA-256 of the text, hexadecimal) and _own (64 bits of it)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_text", text).withColumn("_sha", F.sha2(text, 256)).withColumn("_own", number(F.col("_sha")))


def number(sha):
    """64 bits of a digest; texts that share them are told apart by ``apart``."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def apart(rows: DataFrame, kinds: DataFrame, bin_: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows and kinds, in which different texts of one number (a few pairs in 10^10 texts) have numbers of their own: other 60 bits, negative."""
    twins = kinds.join(kinds.groupBy("own").agg(F.count("*").alias("k")).filter("k > 1").select("own"), "own", "left_semi").select("sha")
    twins = common.settle(twins, "twins", bin_)
    if not twins.limit(1).count():
        return rows, kinds
    mark, other = common.small(twins.withColumn("_twin", F.lit(True))), -1 - F.conv(F.substring(F.col("sha"), 40, 15), 16, 10).cast("long")
    kinds = kinds.join(mark, "sha", "left").withColumn("own", F.when(F.col("_twin"), other).otherwise(F.col("own"))).drop("_twin")
    rows = rows.withColumn("sha", F.col("_sha")).join(mark, "sha", "left").withColumn("_own", F.when(F.col("_twin"), other).otherwise(F.col("_own"))).drop("_twin", "sha")
    return rows, kinds


def repeated_spans(docs: DataFrame, bin_: list[str], length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(sha, n: rows with the text, n_bytes) of each different text, and (sha, spans, text) of those with marked bytes."""
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", "text"))
    kinds = common.settle(rows.groupBy(F.col("_sha").alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.first("_own").alias("own"), F.first(F.octet_length("_text")).alias("n_bytes")), "texts", bin_)
    rows, kinds = apart(rows, kinds, bin_)
    found = rows.select("_own", "_text").filter(F.octet_length("_text") >= length).mapInArrow(lambda x: _anchor_rows(x, length, gram), "anchor long, own long, a long, b long, many long")
    dealt = found.repartition(common.partitions(spark), "anchor").sortWithinPartitions("anchor", "own", "a")
    hits = common.settle(dealt.mapInArrow(_shared, "lead long, anchor long, own long, a long, b long"), "hits", bin_)

    # a block for each lead; a lead with too many bytes is split by anchor, and an anchor with too many is wide
    windows, bytes_ = F.sum(F.col("b") - F.col("a") + 1), F.sum(F.col("b") - F.col("a") + length)
    each = hits.groupBy("lead", "anchor").agg(windows.alias("w"), bytes_.alias("size"))
    big = common.settle(each.filter(F.col("size") > BLOCK_BYTES).select("lead", "anchor", F.lit(True).alias("big")), "wide-anchors", bin_)
    split = common.settle(each.groupBy("lead").agg(F.sum("w").alias("w"), F.sum("size").alias("size")).filter((F.col("w") > BLOCK_BYTES) | (F.col("size") > 4 * BLOCK_BYTES)).select("lead", F.lit(True).alias("split")), "split-leads", bin_)
    # a row of either stands for BLOCK_BYTES of places; beyond a checked size they are joined as any table
    sized = hits.join(common.small(split), "lead", "left").join(common.small(big), ["lead", "anchor"], "left")
    blocked = sized.select(F.when(F.col("split").isNotNull(), F.xxhash64("lead", "anchor")).otherwise(F.xxhash64("lead")).alias("block"), "own", "a", (F.col("b") + length).alias("e"), (F.col("split").isNotNull() & F.col("big").isNotNull()).alias("wide"))
    wanted = blocked.groupBy("own").agg(F.collect_list(F.struct("block", "a", "e", "wide")).alias("cuts"))  # bounded by the text's own length
    lone = kinds.select("own", "doc_id", "sha").join(wanted, "own")
    lone = lone.select(F.col("sha").alias("_s"), F.col("doc_id").alias("_i"), "own", "cuts")
    one = rows.select("doc_id", F.col("_sha").alias("sha"), "_text")  # of rows with one text, those with its least id
    texts = one.join(lone, (F.col("sha") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_i"))).select("sha", "own", "_text", "cuts").dropDuplicates(["sha"])
    texts = common.settle(texts, "hit-texts", bin_)

    def segments(batches):
        for b in common.batches(batches):
            out: list[list] = [[], [], [], []]
            for sha, text, cuts in zip(*(b.column(c).to_pylist() for c in ("sha", "_text", "cuts"))):
                raw = text.encode("utf-8")
                own: dict = {}
                for block, s, e in sorted((c["block"], c["a"], min(c["e"], len(raw))) for c in cuts if not c["wide"]):
                    spans = own.setdefault(block, [])
                    if spans and s <= spans[-1][1] - length + 1:  # windows follow on; no window lies in two segments
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                for block, spans in own.items():
                    for s, e in spans:
                        for col, v in zip(out, (block, sha, s, raw[s:e])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["block", "sha", "s", "bytes"])

    dealt = texts.mapInArrow(segments, "block long, sha string, s long, bytes binary").repartition(common.partitions(spark), "block").sortWithinPartitions("block", "sha", "s")

    def mark(batches):
        held: list = []

        def done():
            index = RunIndex([x[2] for x in held])
            found = [(sha, s + b, s + e) for (sha, s, _), spans in zip(held, index.marked(length)) for b, e in spans]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["sha", "s", "e"])

        block, size = None, 0
        for b in common.batches(batches):
            for own, sha, s, raw in zip(*(b.column(c).to_pylist() for c in ("block", "sha", "s", "bytes"))):
                # small blocks share an index: a match found across them is a match as well
                if own != block and size >= BLOCK_BYTES // 2:
                    yield done()
                    held, size = [], 0
                block = own
                held.append((sha, s, raw))
                size += len(raw)
        if held:
            yield done()

    marks = dealt.mapInArrow(mark, "sha string, s long, e long")
    if not big.isEmpty():
        marks = marks.union(_wide_spans(texts, bin_, length))
    spans = marks.groupBy("sha").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return kinds, texts.select("sha", "_text").join(spans, "sha")


def _stripped(marked: DataFrame) -> DataFrame:
    """sha, n_removed, n_spans, kept_sha256, kept_text of each text with marked bytes."""

    def run(batches):
        for b in common.batches(batches):
            out: list[list] = [[] for _ in range(5)]
            for sha, text, spans in zip(*(b.column(c).to_pylist() for c in ("sha", "_text", "spans"))):
                raw, kept, at, removed, n = text.encode("utf-8"), [], 0, 0, 0
                end = -1
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    if s > end:
                        n += 1
                        kept.append(raw[at:s])
                        removed += e - s
                        at = end = e
                    elif e > end:
                        removed += e - end
                        at = end = e
                kept.append(raw[at:])
                rest = b"".join(kept)
                for col, v in zip(out, (sha, removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["sha", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return marked.mapInArrow(run, "sha string, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    bin_: list[str] = []
    kinds, marked = repeated_spans(docs, bin_, length)
    found = _stripped(marked).drop("kept_text")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    each = kinds.join(found, "sha", "left").select(
        "sha",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    each = common.settle(each, "removals")
    common.discard(bin_)
    ids = keyed(docs.select("doc_id", "text")).select("doc_id", F.col("_sha").alias("sha"))
    return ids.join(each, "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with repeated bytes taken out of their texts; rows left without a word go.

    A character that loses some of its bytes goes whole.
    """
    bin_: list[str] = []
    kinds, marked = repeated_spans(docs, bin_, length)
    rest = _stripped(marked).filter("n_removed > 0").select("sha", "kept_text")
    many = kinds.filter((F.col("n") > 1) & (F.col("n_bytes") >= length)).select("sha", F.lit("").alias("kept_text"))
    new = common.settle(rest.join(many.select("sha"), "sha", "left_anti").union(many), "stripped")
    common.discard(bin_)
    wide = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(new.select(F.col("sha").alias("__sha"), F.col("kept_text").alias("__kept")), "__sha", "left")
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.col("__kept"))
    names = docs.columns
    out = wide.withColumn("text", text).withColumn("n_chars", F.length("text")) if "n_chars" in names else wide.withColumn("text", text)
    return out.filter(F.col("__kept").isNull() | F.col("text").rlike(r"[^\s]")).select(*names)
