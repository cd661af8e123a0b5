"""Operator 1: stupid-backoff language-model scores, computed relationally.

Documents are coded once into blocks (words as numbers of the block's vocabulary). Each block
sends its distinct n-grams of all orders, with their counts, to the partitions of the n-gram
count table, which is dealt by hash; a partition sums the counts of each n-gram over blocks and
joins the totals back to the n-grams of each block. Blocks then score their positions and sum
them up by document. A block names an n-gram once however often it occurs, so that a very
frequent n-gram costs one row a block.

The model that scores a document is that of all other documents: the document's own counts are
taken off every count. For a word with up to ``order`` - 1 words before it in its document, the
score is count(history, word) / count(history) for the longest history for which that is more
than 0, times ``backoff`` for each word by which the history was cut; a word that no other
document has counts as if seen once.

Words are runs of anything but space and \\t..\\r. Null and empty texts have no words: 0
tokens, score 0, mean null. Repeated rows score each other like any copies; extra columns are
ignored; an empty table gives no rows. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

ORDER, BACKOFF = 2, 0.4
#: Bytes of text in a block.
BLOCK_BYTES = 4_000_000
#: N-grams (distinct ones of each block, at most) that a bucket of the count table is sized for: some 200 MB in a task.
BUCKET_GRAMS = 4_000_000


def code_blocks(docs: DataFrame, bin_: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, n_words, uri of the file with vocabulary (8 bytes a word) and words (4 bytes each), settled.

    A failed attempt may leave files that no row names. Table and files go to bin_.
    """
    folder = common.scratch(docs.sparkSession, "word-blocks")
    bin_.append(folder)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made, base = 0, TaskContext.get().partitionId() << 32
        ids, lens, coded, vocabulary, held = [], [], [], {}, 0

        def done():
            raw = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], np.uint64).tobytes()
            at = pa.array([0, sum(map(len, ids))], pa.int32())
            uri = f"{folder}/{uuid.uuid4().hex}.blk"
            if not made:
                fs, path = common.filesystem(folder)
                fs.create_dir(path, recursive=True)
            _write_block(uri, raw, _pack_words(coded))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.ListArray.from_arrays(at, pa.concat_arrays(ids)), pa.ListArray.from_arrays(at, pa.array(lens, pa.int64())), pa.array([uri])],
                ["block", "doc_ids", "n_words", "uri"],
            )

        for b in common.batches(batches):
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = text.encode("utf-8") if text else b""
                words = raw.split()
                for w in set(words).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                ids.append(b.column("doc_id").slice(i, 1))
                lens.append(len(words))
                coded.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                held += len(raw) + 16
                if held >= block_bytes:
                    yield done()
                    made += 1
                    ids, lens, coded, vocabulary, held = [], [], [], {}, 0
        if ids:
            yield done()

    return common.settle(docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, n_words array<long>, uri string"), "blocks", bin_)


def _pack_words(coded: list[np.ndarray]) -> bytes:
    """Word numbers as their low two bytes, then their high two bytes: like lies by like and compresses."""
    every = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    return every.astype("<u2").tobytes() + (every >> 16).astype("<u2").tobytes()


def _unpack_words(raw: bytes) -> np.ndarray:
    low, high = np.split(np.frombuffer(raw, "<u2").astype(np.int64), 2)
    return low | high << 16


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: the first, then the steps in 6 bytes each where they fit, in 8 otherwise."""
    steps = np.diff(values)
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[0], wide[1:, :width] = np.frombuffer(raw, np.uint8, 8, 1), steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(values: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in 8 bytes."""
    low = np.minimum(values, 255).astype("u1")
    return len(low).to_bytes(8, "little") + low.tobytes() + values[low == 255].astype("<u8").tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    low = np.frombuffer(raw, "u1", n, 8)
    out = low.astype(np.int64)
    out[low == 255] = np.frombuffer(raw, "<u8", offset=8 + n)
    return out


def _write_block(uri: str, vocabulary: bytes, words: bytes) -> None:
    """A block's file: three sizes, then vocabulary and words, compressed together."""
    fs, path = common.filesystem(uri)
    body = vocabulary + words
    with fs.open_output_stream(path) as out:
        out.write(len(vocabulary).to_bytes(8, "little") + len(body).to_bytes(8, "little") + (pa.compress(body, "zstd", asbytes=True) if body else b""))


def _read_block(uri: str) -> tuple[bytes, bytes]:
    fs, path = common.filesystem(uri)
    with fs.open_input_stream(path) as f:
        raw = f.read()
    size, whole = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    body = pa.decompress(raw[16:], whole, "zstd", asbytes=True) if whole else b""
    return body[:size], body[size:]


class Grams:
    """The n-grams of a block: for each order and position a number among the block's distinct n-grams."""

    def __init__(self, n_words: np.ndarray, vocabulary: bytes, words: bytes, order: int):
        h = np.frombuffer(vocabulary, "<u8")[_unpack_words(words)]
        self.doc = np.repeat(np.arange(len(n_words)), n_words)
        ends = np.cumsum(n_words)
        self.place = np.arange(len(h)) - np.repeat(ends - n_words, n_words)  # within the document
        parts, self.at = [], []
        rolled = np.zeros(len(h), np.uint64)
        for n in range(1, order + 1):
            # the n-gram that ends at each position with n - 1 words before it
            if n > 1:
                rolled = np.concatenate((rolled[:1], rolled[:-1]))
            rolled = common.mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h)
            at = np.flatnonzero(self.place >= n - 1)
            self.at.append(at)
            parts.append(common.mix64(rolled[at] ^ np.uint64(n)))
        self.hashes, inverse, self.counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        self.number = np.split(inverse, np.cumsum([len(x) for x in parts])[:-1])

    def own(self, n: int) -> np.ndarray:
        """How often the document of each n-gram position holds that n-gram."""
        key = self.doc[self.at[n - 1]] << 32 | self.number[n - 1]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[inverse]


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Parts of the hash range, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def totals(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """block, bucket, totals: the corpus count of each n-gram that the block sent to the bucket, in its order."""

    def ask(batches):
        for b in common.batches(batches):
            for block, n_words, uri in zip(*(b.column(c).to_pylist() for c in ("block", "n_words", "uri"))):
                g = Grams(np.array(n_words, np.int64), *_read_block(uri), order)
                cut = np.searchsorted(_bucket(g.hashes, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                for part in np.array_split(some, max(1, len(some) // 8)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([_pack_sorted(g.hashes[cut[k] : cut[k + 1]]) for k in part], pa.binary()), pa.array([_pack_counts(g.counts[cut[k] : cut[k + 1]]) for k in part], pa.binary())],
                        ["block", "bucket", "grams", "counts"],
                    )

    spark = blocks.sparkSession
    asked = blocks.repartition(common.partitions(spark)).mapInArrow(ask, "block long, bucket long, grams binary, counts binary")
    # numbers that repartition() deals to one partition each, so that all get one bucket
    deal = spark.range(40 * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("at")).agg(F.min("id").alias("id")).orderBy("at")
    numbers = [r["id"] for r in deal.collect()]  # one row a bucket
    key = F.element_at(F.lit(numbers if len(numbers) == buckets else list(range(buckets))), F.col("bucket").cast("int") + 1)

    def add(batches):
        held: list = []

        def done():
            each = [_unpack_sorted(x[1]) for x in held]
            grams, counts = np.concatenate(each), np.concatenate([_unpack_counts(x[2]) for x in held])
            order = np.argsort(grams, kind="stable")
            grams = grams[order]
            first = np.ones(len(grams), bool)
            first[1:] = grams[1:] != grams[:-1]
            at = np.flatnonzero(first)
            total = np.empty(len(grams), np.int64)
            total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.concatenate((at, [len(grams)]))))
            parts = np.split(total, np.cumsum([len(x) for x in each])[:-1])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([bucket] * len(held), pa.int64()), pa.array([_pack_counts(x) for x in parts], pa.binary())], ["block", "bucket", "totals"])

        bucket = None
        for b in common.batches(batches):
            for block, own, grams, counts in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "grams", "counts"))):
                if own != bucket and held:
                    yield done()
                    held = []
                bucket = own
                held.append((block, grams, counts))
        if held:
            yield done()

    return asked.repartition(buckets, key).sortWithinPartitions("bucket", "block").mapInArrow(add, "block long, bucket long, totals binary")


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms), mean_log_score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    bin_: list[str] = []
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = code_blocks(docs, bin_)
    all_words = blocks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(common.partitions(spark), -(-order * all_words // BUCKET_GRAMS))
    told = totals(blocks, order, buckets).groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("told"))  # as large as the block's own n-grams

    def run(batches):
        for b in common.batches(batches, 8):
            for row in range(b.num_rows):
                n_words = np.array(b.column("n_words")[row].as_py(), np.int64)
                g = Grams(n_words, *_read_block(b.column("uri")[row].as_py()), order)
                parts = sorted(((x["bucket"], x["totals"]) for x in (b.column("told")[row].as_py() or ())), key=lambda x: x[0])
                cut = np.searchsorted(_bucket(g.hashes, buckets), np.arange(buckets + 1))
                total = np.zeros(len(g.hashes), np.int64)
                for k, raw in parts:
                    total[cut[k] : cut[k + 1]] = _unpack_counts(raw)
                size = len(g.doc)
                others = []  # by order: count in other documents of the n-gram that ends here
                for n in range(1, order + 1):
                    c = np.zeros(size, np.int64)
                    c[g.at[n - 1]] = total[g.number[n - 1]] - g.own(n)
                    others.append(c)
                rest = all_words - n_words[g.doc]
                log = np.zeros(size)
                open_ = np.ones(size, bool)
                for n in range(order, 1, -1):
                    history = np.concatenate(([0], others[n - 2][:-1])) if size else others[n - 2]
                    use = open_ & (g.place >= n - 1) & (others[n - 1] > 0)
                    log[use] += np.log(others[n - 1][use] / history[use])
                    open_ &= ~use
                    log[open_ & (g.place >= n - 1)] += np.log(backoff)
                log[open_] += np.log(np.maximum(others[0][open_], 1) / np.maximum(rest[open_], 1))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("doc_ids")]).slice(row, 1).flatten(), pa.array(n_words), pa.array(np.bincount(g.doc, log, len(n_words)).astype(np.float64))], ["doc_id", "n_tokens", "log_score"])

    # told comes from a small table of blocks, so that Spark takes it for small as well and would broadcast all totals
    scored = blocks.join(told.hint("merge"), "block", "left").select("doc_ids", "n_words", "uri", "told").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_score double")
    scored = scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.nullif(F.col("n_tokens"), F.lit(0)), 4).alias("mean_log_score"))
    if not all_words:  # nothing was coded, and there may be no files
        return scored
    return common.final(scored, "scores", bin_)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS w2, CASE WHEN i > 1 THEN w[i-1] END AS w1 FROM d, unnest(range(1, len(w) + 1)) u(i)),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT w2, count(*) AS c FROM t GROUP BY w2),
uo AS (SELECT doc_id, w2, count(*) AS c FROM t GROUP BY doc_id, w2),
b AS (SELECT w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY w1, w2),
bo AS (SELECT doc_id, w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY doc_id, w1, w2),
x AS (SELECT t.doc_id, t.w1, u.c - uo.c AS cu, b.c - bo.c AS cb, h.c - ho.c AS ch, n.n - len(d.w) AS rest
      FROM t JOIN d USING (doc_id) CROSS JOIN n JOIN u ON t.w2 = u.w2 JOIN uo ON uo.doc_id = t.doc_id AND uo.w2 = t.w2
      LEFT JOIN b ON b.w1 = t.w1 AND b.w2 = t.w2 LEFT JOIN bo ON bo.doc_id = t.doc_id AND bo.w1 = t.w1 AND bo.w2 = t.w2
      LEFT JOIN u h ON h.w2 = t.w1 LEFT JOIN uo ho ON ho.doc_id = t.doc_id AND ho.w2 = t.w1),
s AS (SELECT doc_id, sum(CASE WHEN cb > 0 THEN ln(cb / ch) ELSE CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(cu, 1) / greatest(rest, 1)) END) AS ls FROM x GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_tokens, round(coalesce(ls, 0), 4) AS log_score, round(ls / nullif(len(d.w), 0), 4) AS mean_log_score FROM d LEFT JOIN s USING (doc_id)
"""
